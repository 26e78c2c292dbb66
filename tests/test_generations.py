"""Stored versions: what readers see while others write, fail, roll back, compact and clean."""

import pytest
from pyspark.sql import functions as F

from lutrin.operators import index
from lutrin.sources import generations as G

SCHEMA = "passage_id string, collection_id string, n int"


def made(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def ids(df):
    return sorted(r["passage_id"] for r in df.collect())


def test_replace_merge_remove_and_schema(spark, tmp_path):
    root = str(tmp_path / "t")
    assert G.version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        G.read(spark, root)
    G.commit(spark, root, made(spark, ("a1", "a", 1), ("a2", "a", 2), ("b1", "b", 1), ("x", None, 0)))
    G.replaced(spark, root, made(spark, ("a3", "a", 3)), ["collection_id"])
    assert ids(G.read(spark, root)) == ["a3", "b1", "x"]
    G.replaced(spark, root, made(spark, ("b1", "b", 9), ("b2", "b", 2)), ["passage_id"])  # merge by id
    assert sorted((r["passage_id"], r["n"]) for r in G.read(spark, root).collect()) == [("a3", 3), ("b1", 9), ("b2", 2), ("x", 0)]
    G.commit(spark, root, gone=spark.createDataFrame([("b",), (None,)], "collection_id string"))
    G.commit(spark, root, spark.createDataFrame([("c1", "c", "more")], "passage_id string, collection_id string, other string"))
    assert ids(G.read(spark, root)) == ["a3", "c1"] and G.read(spark, root).columns == ["passage_id", "collection_id", "n"]
    G.replaced(spark, root, made(spark), ["collection_id"])  # a run that made nothing changes nothing
    assert ids(G.read(spark, root)) == ["a3", "c1"]
    assert [len(ids(G.read(spark, root, n))) for n in G.numbers(spark, root)] == [4, 3, 4, 1, 2, 2]


def test_a_failing_run_leaves_the_version_and_a_reader_keeps_its_own(spark, tmp_path):
    root = str(tmp_path / "t")
    G.commit(spark, root, made(spark, *[(f"p{i}", "a", i) for i in range(50)]))
    before = G.read(spark, root)  # not read yet
    broken = made(spark, *[(f"q{i}", "a", i) for i in range(50)]).repartition(5).withColumn(
        "n", F.when(F.col("n") == 31, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        G.replaced(spark, root, broken, ["collection_id"])
    assert len(ids(G.read(spark, root))) == 50 and G.numbers(spark, root) == [1]
    G.replaced(spark, root, made(spark, ("q", "a", 1)), ["collection_id"])
    assert ids(G.read(spark, root)) == ["q"] and len(ids(before)) == 50
    G.restore(spark, root, 1)
    assert ids(G.read(spark, root)) == ids(before) and G.numbers(spark, root) == [1, 2, 3]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    G.commit(spark, root, made(spark, ("a", "a", 1)))
    old = G.version(spark, root)
    G.commit(spark, root, made(spark, ("b", "a", 1)))
    monkeypatch.setattr(G, "version", lambda *a: old)  # the other writer began before
    with pytest.raises(G.Conflict):
        G.commit(spark, root, made(spark, ("c", "a", 1)))
    monkeypatch.undo()
    assert ids(G.read(spark, root)) == ["a", "b"]


def test_compaction_and_cleaning(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    monkeypatch.setattr(G, "SEGMENTS", 6)
    for i in range(5):
        G.replaced(spark, root, made(spark, (f"p{i}", "a" if i % 2 else "b", i), (f"r{i}", "c", i)), ["collection_id"])
    assert ids(G.read(spark, root)) == ["p3", "p4", "r4"]
    assert len(G.version(spark, root).segments) < 5
    stray = tmp_path / "t" / "data" / "seq=99" / "run=dead"
    stray.mkdir(parents=True)
    assert G.clean(spark, root) == 0 and stray.exists()  # all within the grace time
    assert G.clean(spark, root, 0) > 0 and not stray.exists()
    assert ids(G.read(spark, root)) == ["p3", "p4", "r4"] and len(G.numbers(spark, root)) == 1


def test_postings_kept_by_segments_equal_a_rebuild(spark, tmp_path):
    """Three updates write only their passages; the index is that of a rebuild before and after compaction."""
    form = "passage_id string, collection_id string, title string, hierarchy_path string, text string, mechanics array<string>"
    text = {f"p{i}": f"le roi numero{i} joue la carte" for i in range(40)}
    passages = lambda t: spark.createDataFrame([(p, "g", f"Titre {p}", "", x, []) for p, x in sorted(t.items())], form)
    rows = lambda df: sorted(map(str, df.collect()))
    root = str(tmp_path / "postings")
    index.store_postings(passages(text), root)
    for turn, changed in enumerate((["p1", "p2"], ["p2", "p39"], ["p7"])):
        for p in changed:
            text[p] = f"la reine{turn} tire"
        if turn == 2:
            del text["p0"]
        now = passages(text)
        at = index.update_postings(now, spark.createDataFrame([(p,) for p in [*changed, *(["p0"] if turn == 2 else [])]], "passage_id string"), root)
        written = spark.read.parquet(f"{root}/{at.segments[-1]}").select("passage_id").distinct()
        assert ids(written) == sorted(changed)
        assert rows(G.read(spark, root)) == rows(index.postings(now))
    G.compact(spark, root)
    assert rows(G.read(spark, root)) == rows(index.postings(passages(text)))
    assert len(G.version(spark, root).segments) == 1 and not G.version(spark, root).marks
