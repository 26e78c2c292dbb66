"""Fusion, expansion, follow-ups and the two ways of vector scoring on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lutrin.operators import cells
from lutrin.operators import evaluate as E
from lutrin.operators import index
from lutrin.operators import names as N
from lutrin.operators import retrieve as R
from lutrin.operators import skew, textblocks
from lutrin.operators.skew import top_per
from lutrin.session import written

PASSAGES = ("passage_id string, collection_id string, source_file string, hierarchy_path string, chunk_index int, title string,"
            " text string, page_start int, page_end int")


def ranked(spark, items, pages=None):
    rows = [("q", i, (pages or {}).get(i), r) for r, i in enumerate(items, 1)]
    return spark.createDataFrame(rows, "query_id string, passage_id string, page_start int, rank int")


def fused(spark, by_vector, by_text, pages=None, limit=10):
    out = R.fuse(ranked(spark, by_vector, pages), ranked(spark, by_text, pages), limit).orderBy("rank").collect()
    return [(r["passage_id"], r["score"]) for r in out]


def test_fusion(spark):
    got = fused(spark, ["a", "b"], ["b", "c", "a"])
    assert [g[0] for g in got] == ["b", "a", "c"]
    assert fused(spark, ["a"], ["a"]) == [("a", 1.0)]
    tied = fused(spark, ["a", "b"], ["b", "a"])
    assert tied[0][1] == tied[1][1] and [t[0] for t in tied] == ["a", "b"]
    assert [g[0] for g in fused(spark, [], ["x", "y", "z"], limit=2)] == ["x", "y"]


def test_early_pages_break_close_ranks(spark):
    assert [g[0] for g in fused(spark, ["late", "early"], [], {"late": 20, "early": 3})] == ["early", "late"]
    far = ["top", *[f"m{i}" for i in range(30)], "early"]
    assert fused(spark, far, [], {"top": 5, "early": 1}, limit=40)[0][0] != "early"


def chapter(spark, path="TOUR DE JEU"):
    rows = [(f"c{i}", "g", "f", path, i, f"t{i}", f"Phase {i}", i, i) for i in range(1, 6)]
    rows.append(("other", "g", "f", "", 9, "t", "Combat", 9, 9))
    return spark.createDataFrame(rows, PASSAGES)


def test_expansion_absorbs_neighbours(spark):
    hits = spark.createDataFrame([("q", i, r, 1.0 / r) for r, i in enumerate(["c2", "c3", "c5", "other"], 1)],
                                 "query_id string, passage_id string, rank int, score double")
    (row,) = R.expand_top(hits, chapter(spark)).collect()
    assert [s["text"] for s in row["sections"]] == ["Phase 1\n\nPhase 2\n\nPhase 3\n\nPhase 4", "Phase 5", "Combat"]
    assert (row["sections"][0]["page_start"], row["sections"][0]["page_end"]) == (1, 4)
    (row,) = R.expand_top(hits.filter("rank = 1"), chapter(spark, "")).collect()
    assert [s["text"] for s in row["sections"]] == ["Phase 2"]


def test_variants_and_interleaving(spark):
    history = "array<struct<question:string,answer:string>>"
    asked = spark.createDataFrame([("1", "g", "Et la fin ?", [("Q1", "A1"), ("Q2", "A2")]), ("2", "g", "Seule", [])],
                                  f"query_id string, collection_id string, question string, history {history}")
    got = {r["search_id"]: r["question"] for r in R.search_variants(asked).collect()}
    assert got == {"1#0": "Et la fin ?", "1#1": "Et la fin ? Q2 Q1", "2#0": "Seule"}
    lists = spark.createDataFrame([([("a",), ("b",), ("c",)], [("b",), ("d",), ("a",), ("e",)])],
                                  "x array<struct<passage_id:string>>, y array<struct<passage_id:string>>")
    (row,) = lists.select(R.interleaved(F.col("x"), F.col("y"), 4)).collect()
    assert [s["passage_id"] for s in row[0]] == ["a", "b", "d", "c"]


def vectors(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [round(rng.uniform(-1, 1), 1) for _ in range(4)]
        rows.append((f"p{i:03d}", "hot" if rng.random() < 0.7 else f"c{i % 5}", i % 9, v if i % 11 else None))
    rows += [("bad", "hot", 1, [1.0, 2.0]), ("zero", "hot", 1, [0.0] * 4)]
    return spark.createDataFrame(rows, "passage_id string, collection_id string, page_start int, embedding array<double>")


@pytest.mark.parametrize("min_score", [0.3, -1])
def test_vector_search_equals_brute_force_over_any_cells(spark, min_score, monkeypatch):
    passages = vectors(spark, 400).unionByName(spark.createDataFrame(
        [("nan", "hot", 1, [float("nan")] * 4), ("inf", "hot", 1, [float("inf"), 0.0, 0.0, 0.0])],
        "passage_id string, collection_id string, page_start int, embedding array<double>")).repartition(6)
    asked = [("q1", "hot", [1.0, 0.5, 0.0, -0.2]), ("q2", "c1", [0.3, 0.3, 0.1, 0.9]), ("q3", "hot", None), ("q4", "none", [1.0, 0.0, 0.0, 0.0]),
             ("q5", "hot", [0.0] * 4), ("q6", "hot", [float("nan"), 1.0, 0.0, 0.0]), ("q7", "hot", [1.0, 0.0])]
    queries = spark.createDataFrame(asked, "query_id string, collection_id string, vector array<double>")
    one = R.vector_candidates(queries, passages, 7, min_score).orderBy("query_id", "rank").collect()
    for name, value in (("CELL_ROWS", 6), ("PIVOT_ROWS", 3), ("PIVOTS", 4), ("PART_ROWS", 3), ("SPLIT_ROWS", 20), ("QUERY_ROWS", 1), ("BLOCK_SCORES", 8)):
        monkeypatch.setattr(cells, name, value)
    many = R.vector_candidates(queries, cells.build(passages), 7, min_score).orderBy("query_id", "rank").collect()  # lists longer than a cell, two waves
    assert one == many
    assert one == R.vector_candidates(queries, passages, 7, min_score).orderBy("query_id", "rank").collect()  # in parts
    want = []
    for q, collection, v in asked:
        if v is None or not any(v) or any(x != x for x in v):
            continue
        near = []
        for p in passages.collect():
            e = p["embedding"]
            if p["collection_id"] == collection and e is not None and len(e) == len(v) and all(abs(x) < 9 for x in e) and any(e):
                cosine = round(sum(a * b for a, b in zip(e, v, strict=True)) / (sum(a * a for a in e) * sum(b * b for b in v)) ** 0.5, 9)
                if min_score < 0 or cosine >= min_score:
                    near.append((-cosine, p["passage_id"], p["page_start"]))
        want += [(q, p, page, r) for r, (_, p, page) in enumerate(sorted(near)[:7], 1)]
    assert [(r["query_id"], r["passage_id"], r["page_start"], r["rank"]) for r in one] == want


def test_search_reads_few_cells_of_clustered_vectors(spark):
    """Forty clusters and a third of all rows equal: exact lists from under a fifth of the rows, no query through the driver."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(40, size=9000)] + 0.05 * rng.standard_normal((9000, 16))
    x[::3] = x[0]
    rows = spark.createDataFrame([(f"p{i:05d}", "one", 1, v.tolist()) for i, v in enumerate(x)],
                                 "passage_id string, collection_id string, page_start int, embedding array<double>")
    asked = [(f"q{i}", "one", (centres[i] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(40)]
    queries = spark.createDataFrame(asked, "query_id string, collection_id string, vector array<double>")
    stored = cells.build(rows)
    assert stored.cells.agg(F.sum("n")).first()[0] == 9000 and stored.members.count() == 9000
    found, first, second = cells.waves(queries, stored, 10, None, "query_id")
    read = first.unionByName(second).join(stored.cells, cells.PLACE).agg(F.sum("n")).first()[0]
    crowd = stored.cells.agg(F.max("n")).first()[0]  # the equal rows stand in one cell, which the queries near it must read
    assert crowd >= 3000 and read - crowd * 2 < 40 * 9000 / 5
    units = x / np.linalg.norm(x, axis=1)[:, None]
    for q, _, v in asked:
        v = np.array(v)
        cosines = np.round(units @ (v / np.linalg.norm(v)), 9)
        want = sorted(zip(-cosines, (f"p{i:05d}" for i in range(9000)), strict=True))[:10]
        got = R.vector_candidates(queries.filter(F.col("query_id") == q), stored, 10, -1).orderBy("rank").collect() if q in ("q0", "q7") else None
        if got:
            assert [r["passage_id"] for r in got] == [p for _, p in want]
    lists = {r["query_id"]: r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert len(lists) == 40 and min(lists.values()) >= 10


def test_text_search_modes(spark):
    rows = [("a", "g", "f", "", 0, "Titre", "le roi va à la mer", 1, 1), ("b", "g", "f", "", 1, "", "ax et by", 1, 1),
            ("c", "g", "f", "", 2, "", "ax seul", 1, 1)]
    passages = spark.createDataFrame(rows, PASSAGES).withColumn("mechanics", F.array().cast("array<string>"))
    postings = index.postings(passages)
    asked = spark.createDataFrame([("any", "g", "les rois ou ax ?"), ("all", "g", "ax et by"), ("other", "h", "roi")],
                                  "query_id string, collection_id string, question string")
    got = {(r["query_id"], r["passage_id"]) for r in R.text_candidates(asked, postings, 40).collect()}
    assert got == {("any", "a"), ("all", "b")}


def topical(spark, documents=60, chunks=20):
    """Documents that speak of one thing each, in words of their own and of all."""
    rng, rows = random.Random(6), []
    for d in range(documents):
        for c in range(chunks):
            own = " ".join(f"sujet{d}x{rng.randrange(4)}" for _ in range(rng.randrange(1, 6)))
            rows.append((f"d{d:03d}-{c:03d}", "g" if d % 3 else "h", f"f{d}", "", c, f"sujet{d}x0" if c == 0 else "", f"{own} regle joueur carte" if c % 2 else own, c, c))
    return spark.createDataFrame(rows, PASSAGES).withColumn("mechanics", F.array().cast("array<string>"))


@pytest.mark.parametrize("depth", [1, 5, 1000])
def test_blocks_of_postings_give_the_lists_of_full_scoring(spark, depth):
    postings = written(index.postings(topical(spark)))
    stored = textblocks.build(postings)
    asked = [(f"q{d}", "g" if d % 3 else "h", f"sujet{d}x1 sujet{d}x2 regle joueur") for d in range(0, 60, 7)]
    asked += [("all", "g", "a le"), ("none", "g", "inconnu"), ("other", "missing", "regle"), ("blank", "g", "")]
    queries = spark.createDataFrame(asked, "query_id string, collection_id string, question string")
    plain = R.text_candidates(queries, postings, depth).orderBy("query_id", "rank").collect()
    assert R.text_candidates(queries, stored, depth).orderBy("query_id", "rank").collect() == plain and plain
    needed = R.query_stems(queries).withColumn("needed", F.lit(3))  # a query that needs three of its stems
    full = textblocks.scores(needed, needed.join(stored.maxima, ["collection_id", "stem"]).select("query_id", "collection_id", "block").distinct(),
                             stored.postings, "query_id")
    rank = lambda df: sorted(map(str, top_per(df, ["query_id"], [F.desc("score"), F.col("passage_id")], depth).collect()))
    found, first, second = textblocks.waves(needed, stored, depth, "query_id")
    assert rank(found) == rank(full)
    if depth == 5:
        stems = written(R.query_stems(queries))
        _, first, second = textblocks.waves(stems, stored, depth, "query_id")
        read = first.select("query_id", "collection_id", "block").unionByName(second).join(stems, ["query_id", "collection_id"]).join(stored.postings, textblocks.KEY)
        every = stems.join(stored.postings, ["collection_id", "stem"])
        assert read.count() < every.count() / 3


def test_large_batches_are_scored_in_bundles_and_blocks(spark, monkeypatch):
    """Queries that would visit very many cells meet bundles, postings meet groups of queries in blocks: the same lists, ties included."""
    rng = np.random.default_rng(5)
    rows = [(f"p{i:03d}", "ab"[i % 3 == 0], i, rng.integers(0, 2, 3).astype(float).tolist()) for i in range(90)]
    passages = spark.createDataFrame(rows, "passage_id string, collection_id string, page_start int, embedding array<double>")
    asked = [(f"q{i}", "ab"[i % 2], "roi reine mer terre".split()[i % 4] + " ciel", rng.integers(1, 3, 3).astype(float).tolist()) for i in range(9)]
    queries = spark.createDataFrame(asked, "query_id string, collection_id string, question string, vector array<double>")
    texts = passages.withColumn("title", F.lit("")).withColumn("hierarchy_path", F.lit("")).withColumn("mechanics", F.array().cast("array<string>")).withColumn(
        "text", F.element_at(F.array(*map(F.lit, ("roi", "mer ciel", "terre terre", "ciel", "reine"))), F.col("page_start") % 5 + 1))
    postings, stored = written(index.postings(texts)), cells.build(passages)
    rank = lambda df: [tuple(r) for r in df.select("query_id", "rank", "passage_id", "score").orderBy("query_id", "rank").collect()]
    by_vector, by_text = rank(R.vector_candidates(queries, stored, 6, -1)), rank(R.text_candidates(queries, postings, 6))
    for module, name, value in ((cells, "MOST_VISITS", 0), (cells, "BUNDLE_ROWS", 7), (cells, "BUNDLE_QUERIES", 2), (R, "BLOCK_POSTINGS", 9), (R, "GROUP_STEMS", 3)):
        monkeypatch.setattr(module, name, value)
    assert rank(R.vector_candidates(queries, stored, 6, -1)) == by_vector and rank(R.text_candidates(queries, postings, 6)) == by_text
    assert len(by_vector) == len(by_text) == 54


def test_very_large_batches_read_the_stored_rows(spark, monkeypatch):
    """A batch whose lists by block would be too many reads vectors and blocks in the tasks of its groups: the same lists, one row a place of a list."""
    rng = np.random.default_rng(8)
    rows = [(f"p{i:03d}", "ab"[i % 3 == 0], i if i % 4 else None, rng.integers(0, 2, 3).astype(float).tolist(), rng.choice(["roi", "mer ciel", "roi mer", "ciel"]).item())
            for i in range(90)]
    passages = spark.createDataFrame(rows, "passage_id string, collection_id string, page_start int, embedding array<double>, text string")
    asked = [(f"q{i}", "abc"[i % 3], ["roi ciel", "mer", "inconnu", "a ciel le"][i % 4], rng.integers(1, 3, 3).astype(float).tolist()) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id string, collection_id string, question string, vector array<double>")
    texts = passages.withColumn("title", F.lit("")).withColumn("hierarchy_path", F.lit("")).withColumn("mechanics", F.array().cast("array<string>"))
    postings, stored = written(index.postings(texts)), cells.build(passages)
    needed = written(R.query_stems(queries).withColumn("needed", F.when(F.col("query_id") == "q0", 2).otherwise(0)))
    rank = lambda df: [tuple(r) for r in top_per(df, ["query_id"], [F.desc("score"), F.col("passage_id")], 6)
                       .select("query_id", "rank", "passage_id", "page_start", "score").orderBy("query_id", "rank").collect()]
    vectors = lambda: cells.waves(queries, stored, 6, 0.9, "query_id")[0]
    by_vector, by_text = rank(vectors()), rank(R.text_scores(needed, postings, 6))
    for module, name, value in ((cells, "MOST_VISITS", 0), (cells, "BUNDLE_ROWS", 7), (cells, "BUNDLE_QUERIES", 2), (R, "BLOCK_POSTINGS", 9),
                                (R, "MOST_LISTED", 0), (R, "READER_STEMS", 3), (skew, "LIST_ROWS", 4)):
        monkeypatch.setattr(module, name, value)
    again = vectors(), R.text_scores(needed, postings, 6)
    assert (rank(again[0]), rank(again[1])) == (by_vector, by_text) and by_vector and by_text
    assert (again[0].count(), again[1].count()) == (len(by_vector), len(by_text))  # before: as many rows a block


def test_block_search_shuffles_postings_of_its_stems_only(spark, monkeypatch):
    """The waves score what is left of the stored postings after the stems of the batch, not all of them."""
    rows = [(f"p{i}", "g", f"f{i}", "", 0, "", f"roi mot{i} autre{i} encore{i}", 1, 1) for i in range(40)]
    passages = spark.createDataFrame(rows, PASSAGES).withColumn("mechanics", F.array().cast("array<string>"))
    stored = textblocks.build(index.postings(passages))
    queries = spark.createDataFrame([("q", "g", "roi")], "query_id string, collection_id string, question string")
    read, scores = [], textblocks.scores
    monkeypatch.setattr(textblocks, "scores", lambda s, b, postings, key: read.append(postings.count()) or scores(s, b, postings, key))
    assert R.text_candidates(queries, stored, 5).count() == 5
    assert read == [40, 40] and stored.postings.count() == 160
    assert stored.maxima.agg(F.sum("n")).first()[0] == 160


def test_blocks_are_made_where_the_postings_lie(spark, monkeypatch):
    """Postings in the order of their passages are not shuffled, but for passages at the edges of tasks; in any other order the lists are the same.
    The second wave gives only passages that reach a list."""
    postings = written(index.postings(topical(spark, 20)))
    made = []
    monkeypatch.setattr(textblocks, "written", lambda df: made.append(df) or written(df))
    monkeypatch.setattr(textblocks, "CHUNK_POSTINGS", 50)
    queries = spark.createDataFrame([(f"q{d}", "g" if d % 3 else "h", f"sujet{d}x1 regle") for d in range(5)], "query_id string, collection_id string, question string")
    plain = R.text_candidates(queries, postings, 5).orderBy("query_id", "rank").collect()
    mixed = postings.orderBy(F.xxhash64("passage_id", "stem")).repartition(3)
    cut = written(postings.orderBy("collection_id", "passage_id", "stem")).repartitionByRange(7, "collection_id", "passage_id", "stem")
    for rows in (postings, mixed, cut):
        made.clear()
        stored = textblocks.build(rows)
        assert sorted(map(str, stored.postings.drop("block").collect())) == sorted(map(str, (
            rows.groupBy("collection_id", "stem", "passage_id").agg(F.max("page_start").alias("page_start"), F.sum("weight").alias("weight"))).collect()))
        assert stored.postings.groupBy("collection_id", "passage_id").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] == 1
        if rows is postings:
            assert "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString() and len(made) == 2
        if rows is not cut:
            assert R.text_candidates(queries, stored, 5).orderBy("query_id", "rank").collect() == plain and len(plain) == 25
    found, first, _ = textblocks.waves(R.query_stems(queries), stored, 5, "query_id")
    opened = {(r["query_id"], r["passage_id"]) for r in first.join(stored.postings, ["collection_id", "block"]).select("query_id", "passage_id").collect()}
    given = [(r["query_id"], r["score"], (r["query_id"], r["passage_id"]) in opened) for r in found.collect()]
    for q in {q for q, _, _ in given}:
        floor = sorted(score for x, score, near in given if x == q and near)[-5]
        assert all(score >= floor for x, score, near in given if x == q and not near)


def test_words_of_texts_are_split_once(spark, monkeypatch):
    """The candidates of excerpts come from one stored table of words; no text is split again for each use of it."""
    texts = spark.createDataFrame([(1, "le roi va loin"), (2, "la mer")], "text_id int, normal string")
    excerpts = spark.createDataFrame([(1, "le roi va"), (2, "mer")], "e int, excerpt string")
    stored = []
    monkeypatch.setattr(E, "written", lambda df: stored.append(written(df)) or stored[-1])
    found = E.candidates(texts, excerpts, [])
    assert sorted((r["e"], r["text_id"]) for r in found.collect()) == [(1, 1), (2, 2)]
    assert [sorted(df.columns) for df in stored] == [["_word", "text_id"]] and stored[0].count() == 6


def test_refreshed_postings(spark):
    old = chapter(spark).withColumn("mechanics", F.array().cast("array<string>"))
    new = old.withColumn("text", F.when(F.col("passage_id") == "c2", "Nouvelle règle").otherwise(F.col("text")))
    changed = spark.createDataFrame([("c2",)], "passage_id string")
    refreshed = index.refresh_postings(index.postings(old), new, changed)
    assert sorted(map(str, refreshed.collect())) == sorted(map(str, index.postings(new).collect()))


def test_backfill_and_failed_embeddings(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert [r["v"] for r in index.backfill(df, "v", F.lit("new")).orderBy("id").collect()] == ["a", "new"]
    embedded = index.with_embedding(df, F.col("v"), lambda t: F.when(t == "a", F.array(F.lit(1.0), F.lit(2.0))), dimensions=2)
    assert [r["embedding"] for r in embedded.orderBy("id").collect()] == [[1.0, 2.0], None]
    fits, other = index.split_by_dimension(embedded, 3)
    assert fits.count() == 0 and other.count() == 1


def test_containing_against_brute_force(spark):
    rng = random.Random(11)
    words = ["roi", "tour", "mer", "carte", "pion", "de", "e", "artefact", "amer"]
    texts = [(i, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    excerpts = [(j, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for j in range(30)]
    t = spark.createDataFrame(texts, "text_id int, g string, normal string")
    e = spark.createDataFrame(excerpts, "e int, g string, excerpt string")
    got = sorted((r["e"], r["text_id"]) for r in E.containing(t, e, ["g"]).collect())
    assert got == sorted((j, i) for i, g, n in texts for j, h, x in excerpts if g == h and x in n)
    anywhere = sorted((r["e"], r["text_id"]) for r in E.containing(t.drop("g"), e.drop("g"), []).collect())
    assert anywhere == sorted((j, i) for i, _, n in texts for j, _, x in excerpts if x in n)
    assert E.containing(t, e.withColumn("excerpt", F.lit("")), ["g"]).collect() == []


def test_names(spark):
    names = spark.createDataFrame([("Catan",), ("Catan Junior",), ("Les Aventuriers du Rail",), ("Azul",)], "name string")
    asked = spark.createDataFrame([(1, "À Catan junior, combien ?"), (2, "aux aventuriers du rail"), (3, "Azul ou Catan ?"), (4, "catane")],
                                  "query_id int, question string")
    got = {r["query_id"]: r["name"] for r in N.detected_names(asked, names).collect()}
    assert got == {1: "Catan Junior", 2: "Les Aventuriers du Rail", 3: None, 4: None}


def test_rarest_words_give_fewer_pairs(spark):
    texts = spark.createDataFrame(
        [(i, f"la manufacture du roi {'abdique' if i == 7 else 'gagne'} toujours") for i in range(40)] + [(99, None), (98, "")], "text_id int, normal string")
    excerpts = spark.createDataFrame([(1, "la manufacture du roi abdique toujours"), (2, "la manufacture du dragon gagne"), (3, None)], "e int, excerpt string")
    pairs = E.candidates(texts, excerpts, []).collect()
    assert [(r["e"], r["text_id"]) for r in pairs] == [(1, 7)]  # the longest word stands in 40 texts, "dragon" in none
    assert [(r["e"], r["text_id"]) for r in E.containing(texts, excerpts, []).collect()] == [(1, 7)]


def test_names_lose_marks_by_decomposition(spark):
    import unicodedata

    from lutrin.functions import text

    for sign in map(chr, range(0x80, 0x110000)):
        base = "".join(c for c in unicodedata.normalize("NFD", sign) if not "\u0300" <= c <= "\u036f")
        plain = base.isascii() and base.isalnum() and base != ""
        assert text.PLAIN_FORMS.get(sign) == (base if plain else None)
    rows = [("Škoda Őr", "skoda or"), ("Ma\u0304ori  \u1ea4n", "maori an"), ("ø łódź", "odz"), ("\u212bland \u0130\u212a", "aland ik"), (" !", ""), (None, None)]
    df = spark.createDataFrame(rows, "name string, want string")
    assert [r["k"] for r in df.select(text.name_key(F.col("name")).alias("k")).collect()] == [w for _, w in rows]


def test_names_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["le", "roi", "Čar", "tour", "d'or", "āme", "junior", "7", "-"]
    names = sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(25)})
    asked = [(i, " ".join(rng.choice([*parts, "xyz", "qui"]) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, None)]

    def key(name):
        plain = {"č": "c", "ā": "a", "'": " ", "-": " "}
        return " ".join("".join(plain.get(c, c) for c in name.lower()).split())

    def short(name):
        head, _, tail = key(name).partition(" ")
        return tail if tail and head in ("le", "la", "les", "l", "the") else key(name)

    def wanted(question):
        found = sorted((n for n in names if short(n) and f" {short(n)} " in f" {key(question or '')} "), key=lambda n: (-len(n), n))
        return found[0] if found and all(short(n) in short(found[0]) for n in found) else None

    got = N.detected_names(spark.createDataFrame(asked, "query_id int, question string"),
                           spark.createDataFrame([(n,) for n in [*names, *names, "", None]], "name string")).collect()
    assert {r["query_id"]: r["name"] for r in got} == {i: wanted(q) for i, q in asked} and len(got) == 61
    nobody = spark.createDataFrame([], "name string")
    assert [r["name"] for r in N.detected_names(spark.createDataFrame(asked[:2], "query_id int, question string"), nobody).collect()] == [None, None]


def test_ask_serves_caches_and_logs(spark):
    from lutrin.operators import ask as K

    passages = (chapter(spark).withColumn("mechanics", F.array().cast("array<string>"))
                .withColumn("embedding", index.hashed_vector(F.col("text"))))
    collections = spark.createDataFrame([("g", "Mon Jeu")], "collection_id string, name string").withColumn(
        "updated_at", F.timestamp_seconds(F.lit(1000)))
    queries = spark.createDataFrame(
        [("1", "mon jeu", "Quel combat ?", []), ("2", "MON JEU", "Et la phase ?", [("Quel combat ?", "Combat")]),
         ("3", "absent", "Quel combat ?", []), ("4", "Mon Jeu", "  ", []), ("5", "Mon Jeu", "zzz", [])],
        f"query_id string, collection string, question string, history {K.HISTORY}")

    def model(rows):
        assert "prompt" in rows.columns
        return (rows.withColumn("answer", F.concat(F.lit("Ok, "), F.col("question"))).withColumn("model", F.lit("m"))
                .withColumn("tokens", F.struct(*[F.lit(1).cast("long").alias(c) for c in ("prompt", "completion", "total")])))

    now = F.timestamp_seconds(F.lit(5000))
    first = K.ask(queries, collections, passages, index.postings(passages), index.hashed_vector, now, model)
    got = {r["query_id"]: (r["answer"], r["cached"], len(r["sections"] or [])) for r in first.answers.collect()}
    assert got["1"][0] == "Quel combat ?" and got["2"][0] == "Et la phase ?" and got["5"] == (None, False, 0)
    assert not any(v[1] for v in got.values()) and got["1"][2] > 0
    assert {(r["query_id"], r["reason"]) for r in first.rejected.collect()} == {("3", "unknown collection"), ("4", "blank")}
    assert first.log.count() == 2
    again = K.ask(queries, collections, passages, index.postings(passages), index.hashed_vector, now, model, cache=first.to_cache)
    assert {r["query_id"] for r in again.answers.filter("cached").collect()} == {"1"}
    # a re-indexed collection has another key
    newer = collections.withColumn("updated_at", F.timestamp_seconds(F.lit(2000)))
    assert K.ask(queries, newer, passages, index.postings(passages), index.hashed_vector, now, model,
                 cache=first.to_cache).answers.filter("cached").count() == 0
    plain = K.ask(queries, collections, passages, index.postings(passages), index.hashed_vector, now)
    assert {r["query_id"]: r["answer"] for r in plain.answers.collect()}["1"].startswith("Section 1: t")


def test_long_excerpts_store_their_inner_words_only(spark, monkeypatch):
    """Without an excerpt of one or two words, no other word of the texts is stored; the pairs are stored for the join with the texts."""
    texts = spark.createDataFrame([(1, "le roi va loin d'ici"), (2, "la mer va et vient"), (3, None)], "text_id int, normal string")
    excerpts = spark.createDataFrame([(1, "roi va loin"), (2, "mer va et"), (3, "un autre mot")], "e int, excerpt string")
    stored = []
    monkeypatch.setattr(E, "written", lambda df: stored.append(written(df)) or stored[-1])
    assert sorted((r["e"], r["text_id"]) for r in E.containing(texts, excerpts, []).collect()) == [(1, 1), (2, 2)]
    assert sorted(r["_word"] for r in stored[0].collect()) == ["va", "va"] and len(stored) == 2


def test_short_excerpts_store_no_words(spark, monkeypatch):
    """Excerpts of one or two words are found while the texts are read, whatever the spaces, keys, repeats and parts; only longer ones store words."""
    rng = random.Random(4)
    pieces = ["de", "la", "e", "mode", "dela", "à", " ", "\u00a0", "\n", "x" * 50]
    texts = [(rng.randrange(60), rng.choice(["a", "b", None]), rng.choice([None, "", " ".join(rng.choices(pieces, k=rng.randrange(1, 9)))])) for _ in range(90)]
    asked = {(rng.choice(["a", "b", "c", None]), rng.choice(["", "\u00a0", " "]).join(rng.choices(pieces[:6], k=rng.randrange(1, 3)))) for _ in range(40)}
    excerpts = [(j, g, x) for j, (g, x) in enumerate(sorted(asked, key=str))] + [(90, "a", None), (91, "a", ""), (92, "b", " la"), (93, "b", "la")]
    t = spark.createDataFrame(texts, "text_id int, g string, normal string")
    e = spark.createDataFrame(excerpts, "e int, g string, excerpt string")
    stored = []
    monkeypatch.setattr(E, "written", lambda df: stored.append(written(df)) or stored[-1])
    want = lambda on: sorted((j, i) for i, g, n in texts for j, h, x in excerpts if n and x and x in n and (not on or g == h and g))
    for held in (E.HELD_EXCERPTS, 7):
        monkeypatch.setattr(E, "HELD_EXCERPTS", held)
        assert sorted((r["e"], r["text_id"]) for r in E.containing(t, e, ["g"]).collect()) == want(True)
        assert sorted((r["e"], r["text_id"]) for r in E.containing(t.drop("g"), e.drop("g"), []).collect()) == want(False) and want(False)
    assert not stored
    longer = e.unionByName(spark.createDataFrame([(99, "a", "mode la de")], e.schema))
    assert E.containing(t, longer, ["g"]).filter("e < 99").count() == len(want(True))
    assert {r["_word"] for r in stored[0].collect()} <= {"la"} and len(stored) == 2


def test_hits_go_to_the_passages(spark, monkeypatch):
    """What is looked up among the passages is stored first, so its size is known and texts are not shuffled for a few hits."""
    rows = [(f"d-{i}", "fr", "d", "Chapitre", i, f"t{i}", f"texte {i}", i + 1, i + 1) for i in range(6)]
    passages = written(spark.createDataFrame(rows, PASSAGES))
    hits = spark.createDataFrame([("q", "d-2", 1, 0.5)], "query_id string, passage_id string, rank int, score double")
    stored = []
    monkeypatch.setattr(R, "written", lambda df: stored.append(written(df)) or stored[-1])
    found = R.expand_top(top_per(hits, ["query_id"], [F.col("score").desc()], 3), passages)
    assert found.first()["sections"][0]["text"] == "\n\n".join(f"texte {i}" for i in range(5))
    assert [(df.count(), "text" in df.columns) for df in stored] == [(1, False), (5, False)]
