"""Files in and out, staged re-index, request rate and streams on small fixtures."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lutrin.functions.guarded import halved
from lutrin.operators import activity as V
from lutrin.operators import index
from lutrin.operators import maintain as M
from lutrin.operators import passages as P
from lutrin.sources import catalog, files, generations, sinks
from lutrin.streaming import jobs as J


def test_documents_from_files(spark, tmp_path):
    books = tmp_path / "jeu-a"
    books.mkdir()
    (books / "livret.pdf").write_bytes(b"%PDF-text\nPage une.\x0c\x0cPage trois.")
    (books / "notes.md").write_text("# Notes\n\nTexte")
    (books / "vide.txt").write_text("")
    (books / "page.txt").write_text("<!DOCTYPE html><html></html>")
    (books / "image.png").write_bytes(b"\x89PNG")
    documents, rejected = files.read_documents(spark, str(tmp_path))
    got = {r["doc_id"]: [tuple(p) for p in r["pages"]] for r in documents.collect()}
    assert got == {"livret.pdf": [(1, "%PDF-text\nPage une."), (3, "Page trois.")], "notes.md": [(1, "# Notes\n\nTexte")]}
    assert {r["path"].split("/")[-1]: r["reason"] for r in rejected.collect()} == {
        "page.txt": "format", "image.png": "extension"}
    listed = files.list_files(spark, str(tmp_path))
    assert {r["relative_path"] for r in listed.collect()} >= {"jeu-a/livret.pdf", "jeu-a/notes.md"}
    summary = V.files_by_collection(listed).collect()[0]
    assert (summary["collection_id"], summary["n_files"]) == ("jeu-a", 4)


def test_texts_become_one_file_each_in_few_folders(spark, tmp_path):
    rows = [(("a/b, c", "", None)[i % 3], i, (f" Texte {i}\n", None)[i % 7 == 0]) for i in range(40)]
    path = str(tmp_path / "out")
    files.write_texts(spark.createDataFrame(rows, "collection_id string, doc_id long, text string").repartition(4), path)
    documents, rejected = files.read_documents(spark, path)
    got = {(r["c"], r["doc_id"], "".join(p["text"] for p in r["pages"])) for r in documents.withColumn(
        "c", files.collection_of(F.col("collection_id"))).collect()}
    assert got == {(c, f"{i}.txt", (t or "").strip()) for c, i, t in rows} and not rejected.count()
    assert len(list((tmp_path / "out").iterdir())) == 3  # one a collection, before: one a document


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The rows of Spark's own listing, hidden names and odd ones included, without an index of files in the driver."""
    root = tmp_path / "b x"
    for folder in ("a", "a/deep,é", "_hid", ".h", "_k=1", "empty"):
        (root / folder).mkdir(parents=True)
        for i in range(3):
            (root / folder / f"f {i}%20é.txt").write_text("x" * i)
    for name in ("top.md", "_SUCCESS", "_metadata", "z._COPYING_"):
        (root / name).write_text("# t")
    monkeypatch.setattr(files, "TASK_FILES", 2)
    monkeypatch.setattr(files, "BATCH_BYTES", 2)
    for path in (str(root), f"file://{root}/", f"{root}/top.md", f"{root}/*"):  # the last two are left to Spark
        want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
        listed, with_content = files.scanned(spark, path)
        got = with_content(listed).select("path", "modificationTime", "length", "content").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    plan = files.list_files(spark, str(root))._jdf.queryExecution().executedPlan().toString() + files.read_documents(spark, str(root))[0]._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and str(root) not in plan
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.list_files(spark, f"{root}/none")


def test_evaluation_set(spark, tmp_path):
    path = tmp_path / "questions.json"
    path.write_text(json.dumps({
        "games": [{"name": "A", "files": ["a.pdf"]}],
        "questions": [{"game": "A", "question": "Combien ?", "expected": ["x"], "answer": ["3|trois"]}, {"game": "A", "question": "Hors livret"}]},
        indent=1))
    collections, questions = files.read_evaluation(spark, str(path))
    assert collections.count() == 1
    got = {r["question"]: (r["expected"], r["facts"], r["history"]) for r in questions.collect()}
    assert got == {"Combien ?": (["x"], ["3|trois"], []), "Hors livret": ([], [], [])}
    assert files.read_evaluation(spark, str(path), "HORS")[1].count() == 1
    with pytest.raises(ValueError):
        files.read_evaluation(spark, str(path), "absent")
    sinks.write_results(questions, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def rows(spark, ids, collection="a"):
    return spark.createDataFrame([(i, collection, None, [0.5]) for i in ids],
                                 "passage_id string, collection_id string, mechanics array<string>, embedding array<double>")


def stored(spark, root):
    return sorted(r["passage_id"] for r in generations.read(spark, root).collect())


def test_snapshots_have_arrays_and_float_vectors(spark, tmp_path):
    target = str(tmp_path / "t")
    M.write_snapshot(rows(spark, ["old-1", "old-2"]).unionByName(rows(spark, ["b-1"], "b")), target)
    assert dict(spark.read.parquet(target).dtypes)["embedding"] == "array<float>"
    assert spark.read.parquet(target).filter("mechanics IS NULL").count() == 0
    assert M.read_snapshot(rows(spark, []), target).count() == 3


def test_reindex_replaces_merges_and_keeps(spark, tmp_path):
    root = str(tmp_path / "t")
    M.reindex(rows(spark, ["old-1", "old-2"]).unionByName(rows(spark, ["b-1"], "b")), root)
    assert dict(generations.read(spark, root).dtypes)["embedding"] == "array<float>"
    assert generations.read(spark, root).filter("mechanics IS NULL").count() == 0
    assert list(map(tuple, M.reindex(rows(spark, ["new-1"]), root).collect())) == [("a", 1)]
    assert stored(spark, root) == ["b-1", "new-1"]
    M.reindex(rows(spark, ["new-2", "new-1"]), root, replace=False)
    assert stored(spark, root) == ["b-1", "new-1", "new-2"]
    # a run that made nothing leaves everything as it was
    M.reindex(rows(spark, []), root)
    assert stored(spark, root) == ["b-1", "new-1", "new-2"]
    # a run that fails while it writes its rows leaves everything as it was
    broken = rows(spark, ["x"]).withColumn("passage_id", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        M.reindex(broken, root)
    assert stored(spark, root) == ["b-1", "new-1", "new-2"]


def test_named_changes(spark):
    changes = spark.createDataFrame([("L'île du Roi 2",), ("  ",), (None,)], "name string")
    ok, rejected = M.named_changes(changes)
    assert [r["id"] for r in ok.collect()] == ["lle-du-roi-2"]
    assert rejected.count() == 2


def test_postings_table(spark, tmp_path):
    passages = spark.createDataFrame([("p", "a", "Titre", "", "le roi", []), ("q", "b", "", "", "la mer", [])],
                                     "passage_id string, collection_id string, title string, hierarchy_path string, text string, mechanics array<string>")
    sinks.write_postings(index.postings(passages), str(tmp_path / "p"), files=2)
    read = spark.read.parquet(str(tmp_path / "p"))
    assert {(r["collection_id"], r["stem"]) for r in read.collect()} == {("a", "titr"), ("a", "roi"), ("b", "mer")}


def test_bounded_query_refuses_commands(spark):
    spark.range(5).createOrReplaceTempView("five")
    short = catalog.bounded_query(spark, "SELECT id FROM five ORDER BY id;", 3).collect()
    assert [(r["id"], r["truncated"]) for r in short] == [(0, True), (1, True), (2, True)]
    assert [r["truncated"] for r in catalog.bounded_query(spark, "SELECT id FROM five").collect()] == [False] * 5
    for statement in ("DROP VIEW five", "SELECT 1; SELECT 2", "CREATE TABLE x AS SELECT 1"):
        with pytest.raises(Exception):
            catalog.bounded_query(spark, statement).collect()
    assert spark.catalog.tableExists("five")
    listed = {r["table_name"] for r in catalog.catalog_profile(spark).collect()}
    assert "five" in listed


def test_statement_over_its_time_ends_with_its_jobs(spark):
    import time

    held = catalog.bounded_result(spark, "SELECT id FROM range(5) ORDER BY id", 3, seconds=120)
    assert [(r["id"], r["truncated"]) for r in held.collect()] == [(0, True), (1, True), (2, True)]
    slow = "SELECT sum(xxhash64(id) % 7) AS n FROM range(0, 1000000000000000, 1, 8)"
    start = time.monotonic()
    with pytest.raises(TimeoutError):
        catalog.bounded_result(spark, slow, seconds=3)
    assert time.monotonic() - start < 60
    tracker = spark.sparkContext.statusTracker()
    for _ in range(100):
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds()
    assert spark.range(10).count() == 10 and not spark.sparkContext.getJobTags()
    with pytest.raises(Exception, match="missing_table"):  # other errors pass as they are
        catalog.bounded_result(spark, "SELECT * FROM missing_table", seconds=60)


def bucket_loop(requests, per_minute):
    buckets, out = {}, {}
    for key, rid, at in sorted(requests, key=lambda r: (r[2], r[1])):
        tokens, last = buckets.get(key, (per_minute, at))
        tokens = min(per_minute, tokens + (at - last) * per_minute / 60)
        out[rid] = tokens >= 1
        buckets[key] = (tokens - 1 if tokens >= 1 else tokens, at)
    return out


def test_request_rate(spark):
    six = [("a", i, float(i) / 10) for i in range(7)] + [("b", 8, 0.7), ("a", 9, 11.0)]
    got = {r["request_id"]: (r["allowed"], r["wait"]) for r in V.rate_limited(
        spark.createDataFrame(six, "key string, request_id bigint, at double"), 6).collect()}
    assert [got[i][0] for i in range(7)] == [True] * 6 + [False]
    assert 0 < got[6][1] <= 10 and got[8][0] and got[9][0]
    assert V.rate_limited(spark.createDataFrame(six, "key string, request_id bigint, at double"), 0).filter("NOT allowed").count() == 0


def test_request_rate_against_a_loop(spark):
    # one key holds most requests; bursts cross the borders of the time spans
    rng = random.Random(2)
    at, requests = 0.0, []
    for i in range(1500):
        at += rng.choice([0.5, 1, 3, 20, 65, 400])
        requests.append(("hot" if rng.random() < 0.6 else f"k{i % 7}", i, at))
    df = spark.createDataFrame(requests, "key string, request_id bigint, at double").repartition(5)
    got = {r["request_id"]: r["allowed"] for r in V.rate_limited(df, 3, span=50.0).collect()}
    assert got == bucket_loop(requests, 3)


def test_log_append(spark, tmp_path):
    logged = spark.createDataFrame([("ask_question", "m", "{}", "2024-01-01 10:00:00")], "event_type string, message string, metadata string, t string")
    ready = logged.select("event_type", "message", "metadata", F.to_timestamp("t").alias("created_at"))
    for _ in range(2):
        sinks.append_log(ready, str(tmp_path / "logs"))
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 2


def test_import_stream_in_two_steps(spark, tmp_path):
    """Documents that arrive later are merged in; what a finished run did is not done again."""
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "collection_id string, doc_id bigint, pages array<struct<page_no:int,text:string>>"
    text = "Chaque joueur reçoit un plateau et cinq jetons de sa couleur au début. " * 5
    for doc in (1, 2):
        spark.createDataFrame([("a", doc, [(1, text + f"Fin {doc}.")])], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        J.run_available(J.import_stream(stream, target, str(tmp_path / f"stage{doc}")), check)
        got = generations.read(spark, target).select("doc_id").distinct().collect()
        assert {r["doc_id"] for r in got} == set(range(1, doc + 1))


def test_documents_are_added_or_renewed(spark, tmp_path):
    schema = "passage_id string, collection_id string, doc_id int"
    target = str(tmp_path / "t")

    def table(*rows):
        return spark.createDataFrame(list(rows), schema)

    M.add_documents(table(("a1/0", "a", 1), ("a1/1", "a", 1), ("b2/0", "b", 2)), target)
    M.add_documents(table(("a3/0", "a", 3), ("c4/0", "c", 4)), target)
    assert stored(spark, target) == ["a1/0", "a1/1", "a3/0", "b2/0", "c4/0"]
    for _ in range(2):  # run twice: document 1 got shorter, document 5 is new
        M.add_documents(table(("a1/0", "a", 1), ("b5/0", "b", 5)), target)
        assert stored(spark, target) == ["a1/0", "a3/0", "b2/0", "b5/0", "c4/0"]


def test_outcome_of_a_run(spark):
    docs = spark.createDataFrame([("a", 1, [(1, "Les joueurs posent leurs jetons sur le grand plateau. " * 5)]), ("a", 2, [(1, "")]), ("b", 3, [(1, "12 34 56")])],
                                 "collection_id string, doc_id int, pages array<struct<page_no:int,text:string>>")
    outcome = M.outcome(docs, P.passages(docs))
    assert {r["doc_id"]: r["status"] for r in outcome.collect()} == {1: "indexed", 2: "no text", 3: "no passage"}
    assert {r["collection_id"]: r["success"] for r in M.run_summary(outcome).collect()} == {"a": True, "b": False}


def test_rows_on_which_the_embedder_raises_do_not_end_the_run(spark):
    seen = []

    def embed(texts):
        seen.extend(texts)
        if texts.str.contains("bad").any():
            raise RuntimeError("no vector")
        return [[float(len(t))] * (2 if t == "long" else 1) for t in texts]

    texts = pd.Series([f"t{i}" if i % 100 != 7 else f"bad{i}" for i in range(256)])
    values, errors = halved(embed, texts)
    assert [i for i, e in enumerate(errors) if e] == [7, 107, 207] and errors[7] == "RuntimeError: no vector"
    assert all((v is None) == (e is not None) for v, e in zip(values, errors, strict=True))
    assert max(seen.count(t) for t in texts) <= 1 + 8
    assert halved(embed, texts.iloc[:0]) == ([], []) and halved(lambda t: [1], texts.iloc[:2]) == ([1, 1], [None, None])
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "long"), (5, "")], "id int, v string")
    rows = index.with_guarded_embedding(df, F.col("v"), embed, dimensions=1).orderBy("id").collect()
    assert [(r["embedding"], r["embedding_error"]) for r in rows] == [([1.0], None), (None, None), (None, "RuntimeError: no vector"), (None, "size 2"), ([0.0], None)]
