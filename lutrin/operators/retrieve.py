"""Hybrid retrieval for all queries at once: vector and text candidates, fusion, expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lutrin.functions import lexicon as L
from lutrin.functions import nlp, scores
from lutrin.functions.text import fold, let
from lutrin.operators import cells, textblocks
from lutrin.operators.cells import SCORE_DIGITS, VectorCells
from lutrin.operators.skew import RunningLists, top_per
from lutrin.operators.textblocks import TextBlocks
from lutrin.session import read_in_task, written

BLOCK_POSTINGS = 1_000_000  # postings of one block of passages
GROUP_STEMS = 500_000  # stems of one group of queries
MOST_LISTED = 20_000_000  # rows of the lists that groups make of blocks; larger batches read the blocks themselves
READER_STEMS = 50_000  # stems of one group of queries that does so

# --- candidates ------------------------------------------------------------------------

def vector_candidates(queries: DataFrame, passages: DataFrame | VectorCells, depth: int, min_score: float = L.MIN_COSINE,
                      key: str = "query_id") -> DataFrame:
    """Top `depth` by cosine; 0 asks for the default threshold, a negative one for none.

    `passages` are the stored cells of the collections' vectors (`cells.build`), of which only those are read whose bound reaches a query's list,
    or passages, which are all read. Filtering before ranking equals cutting the list at the first low score. Vectors that are
    null, zero or not finite have no score, nor have vectors of another size than the query's (`index.split_by_dimension` lists them).
    """
    threshold = L.MIN_COSINE if min_score == 0 else min_score
    stored = passages if isinstance(passages, VectorCells) else cells.whole(passages)
    found, _, _ = cells.waves(queries, stored, depth, threshold if threshold > 0 else None, key)
    return top_per(found, [key], [F.col("score").desc(), F.col("passage_id")], depth)


def query_stems(queries: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per (query, stem); `needed` is how many stems a passage must hold, 0 for any."""
    parsed = let(nlp.query_terms(F.col("question")), lambda q: F.struct(
        q["mode"].alias("mode"),
        F.array_distinct(F.transform(F.filter(
            q["terms"], lambda w: (q["mode"] == "any") | ~nlp.is_one_of(fold(w), L.STOPWORDS)),
            nlp.stem)).alias("stems")))
    return (queries.select(key, "collection_id", parsed.alias("q"))
            .select(key, "collection_id", F.when(F.col("q.mode") == "all", F.size("q.stems")).otherwise(0).alias("needed"),
                    F.explode("q.stems").alias("stem")))


def _block(rows: pa.Table) -> dict:
    """Postings (term, passage_id, page_start, weight, first_field) of a block by term, and its passages in the order of their ids."""
    ids = rows["passage_id"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(ids.dictionary).to_numpy()
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.arange(len(order))
    place, by_term = numbers[ids.indices.to_numpy()], np.argsort(rows["term"].to_numpy(), kind="stable")
    page = rows["page_start"].take(pa.array(np.unique(place, return_index=True)[1]))
    return {"term": rows["term"].to_numpy()[by_term], "place": place[by_term].astype(np.int32), "weight": rows["weight"].to_numpy()[by_term],
            "first": rows["first_field"].to_numpy()[by_term].astype(np.int8), "passage_id": ids.dictionary.take(pa.array(order)), "page_start": page}


NUMBERS = {"term": np.int64, "place": np.int32, "weight": np.float64, "first": np.int8}


def _asked(terms: pa.Table, key: str) -> tuple[pa.Table, np.ndarray]:
    """Stems of a group of queries by query, and where each query begins and the last one ends."""
    terms = terms.sort_by(key)
    queries = terms[key].combine_chunks().dictionary_encode().indices.to_numpy()
    return terms, np.flatnonzero(np.diff(queries, prepend=-1, append=-1)) if len(queries) else np.zeros(1, np.int64)


def _best(terms: pa.Table, cuts: np.ndarray, block: dict, depth: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, passage and score of every query's `depth` best passages of a block that reach its floor, ties to the smaller passage."""
    asked, found, totals = [], [], []
    term, place, weight, first = (block[c] for c in NUMBERS)
    needed, wanted = terms["needed"].to_numpy(), terms["term"].to_numpy()
    starts, ends = np.searchsorted(term, wanted, "left"), np.searchsorted(term, wanted, "right")
    for q, (at, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        spans = [slice(s, e) for s, e in zip(starts[at:end].tolist(), ends[at:end].tolist(), strict=True) if e > s]
        if not spans:
            continue
        met, n = np.concatenate([place[s] for s in spans]), len(block["passage_id"])
        total = np.bincount(met, np.concatenate([weight[s] for s in spans]), n)
        hit = total > max(0, floors[q] - 10.0**-SCORE_DIGITS)
        if needed[at]:
            hit &= np.bincount(met, np.concatenate([first[s] for s in spans]), n) >= needed[at]
        hit = np.flatnonzero(hit)
        score = np.round(total[hit], SCORE_DIGITS)
        if len(hit) > depth:
            last = max(np.partition(score, -depth)[-depth], floors[q])
            above, equal = np.flatnonzero(score > last), np.flatnonzero(score == last)
            best = np.concatenate([above, equal[:depth - len(above)]])
            hit, score = hit[best], score[best]
        asked.append(np.full(len(hit), q))
        found.append(hit)
        totals.append(score)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((asked, np.int64), (found, np.int64), (totals, float)))


def _summed(key: str, depth: int):
    """Of every query the `depth` best passages of a block by summed weight, ties to the smaller passage."""
    def summed(terms: pa.Table, rows: pa.Table) -> pa.Table:
        terms, cuts = _asked(terms, key)
        block = _block(rows)
        q, p, score = _best(terms, cuts, block, depth, np.full(len(cuts) - 1, -np.inf))
        p = pa.array(p)
        return pa.table({key: terms[key].take(pa.array(cuts[q])), "passage_id": block["passage_id"].take(p), "page_start": block["page_start"].take(p),
                         "score": pa.array(score)})
    return summed


def _packed(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """The blocks of postings (collection_id, term, passage_id, page_start, weight, first_field), one row each."""
    fields = [met.schema["collection_id"], *[T.StructField(c, T.BinaryType()) for c in NUMBERS],
              *[T.StructField(c, T.ArrayType(met.schema[c].dataType)) for c in ("passage_id", "page_start")]]

    def pack(rows: pa.Table) -> pa.Table:
        block = _block(rows)
        return pa.table({"collection_id": rows["collection_id"].slice(0, 1), **{c: pa.array([block[c].astype(t).tobytes()]) for c, t in NUMBERS.items()},
                         **{c: pa.ListArray.from_arrays([0, len(block[c])], pa.chunked_array([block[c]] if isinstance(block[c], pa.Array) else block[c]).combine_chunks())
                            for c in ("passage_id", "page_start")}})
    dealt = met.join(sizes.select("collection_id", "_blocks"), "collection_id").withColumn("_block", cells.salt("passage_id", F.col("_blocks"))).drop("_blocks")
    return dealt.groupBy("collection_id", "_block").applyInArrow(pack, T.StructType(fields))


def _read_whole(asked: DataFrame, blocks: DataFrame, met: DataFrame, depth: int, key: str) -> DataFrame:
    """(key, passage_id, page_start, score): every query's list from all stored blocks, which the task of its group reads one after the other."""
    files = blocks.select("collection_id", F.input_file_name().alias("file")).distinct().collect()
    schema = T.StructType([asked.schema[key], met.schema["passage_id"], met.schema["page_start"], T.StructField("score", T.DoubleType())])
    names = blocks.columns
    where: dict = {}
    for row in files:
        where.setdefault(row["collection_id"], []).append(row["file"])

    def summed(terms: pa.Table) -> pa.Table:
        terms, cuts = _asked(terms, key)
        lists, collection = RunningLists(len(cuts) - 1, depth), terms["collection_id"][0].as_py()
        for row in read_in_task(sorted(where.get(collection, [])), names, 1):
            if row.column("collection_id")[0].as_py() != collection:
                continue
            block = {c: np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in NUMBERS.items()} | {c: row.column(c).flatten() for c in ("passage_id", "page_start")}
            q, p, score = _best(terms, cuts, block, depth, lists.floors)
            if len(q):
                lists.add(q, block["passage_id"].take(pa.array(p)), block["page_start"].take(pa.array(p)), score)
        if not lists.parts:
            return to_arrow_schema(schema).empty_table()
        found = lists.cut()
        return pa.table({key: terms[key].take(pa.array(cuts[found["query"].to_numpy()])), **{c: found[c] for c in ("passage_id", "page_start", "score")}})
    return asked.groupBy("collection_id", "_group").applyInArrow(summed, schema)


def text_scores(stems: DataFrame, postings: DataFrame, depth: int, key: str = "query_id") -> DataFrame:
    """(key, passage_id, page_start, score): weighted text score of passages that hold any stem of a query (key, collection_id, needed, stem),
    or all by `needed`; every query's `depth` best are among them.

    Postings of the batch's stems are dealt by passage to blocks of BLOCK_POSTINGS, queries to groups of GROUP_STEMS. A group sums its
    scores over a block in one task and gives `depth` rows a query, so single hits are never shuffled and no stem or collection is hot.
    Batches whose groups would make more than MOST_LISTED rows of that kind store the blocks instead: the task of a smaller group reads them one after
    the other and keeps one list a query, so neither postings nor queries are repeated and what is shuffled grows with either, not with both.
    """
    both, stems = ["collection_id", "stem"], written(stems)
    numbers = written(stems.select(*both).distinct().withColumn("term", F.monotonically_increasing_id()))
    met = written(postings.select(*both, "passage_id", "page_start", "weight", "first_field").join(numbers, both).drop("stem"))
    counts = stems.groupBy("collection_id").agg(F.count("*").alias("_stems"), F.approx_count_distinct(key).alias("_queries"))
    sizes = written(met.groupBy("collection_id").agg(F.ceil(F.count("*") / BLOCK_POSTINGS).cast("int").alias("_blocks")).join(counts, "collection_id"))
    asked = stems.join(numbers, both).join(sizes, "collection_id")
    columns = [key, "collection_id", "needed", "term"]
    if (sizes.agg(F.sum(F.col("_queries") * F.col("_blocks"))).first()[0] or 0) * depth > MOST_LISTED:
        groups = F.ceil(F.col("_stems") / READER_STEMS).cast("int")
        n = 2 * sizes.agg(F.sum(groups)).first()[0]  # groups are few bytes and long work: they are not coalesced
        dealt = asked.select(*columns, cells.salt(key, groups).alias("_group")).repartition(n, "collection_id", "_group")
        return _read_whole(dealt, written(_packed(met, sizes)), met, depth, key)
    sizes = sizes.withColumn("_groups", F.ceil(F.col("_stems") / GROUP_STEMS).cast("int")).drop("_stems", "_queries")
    asked = (stems.join(numbers, both).join(sizes, "collection_id")
             .select(*columns, cells.salt(key, F.col("_groups")).alias("_group"), cells.numbered(F.col("_blocks")).alias("_block")))
    there = (met.join(sizes, "collection_id").withColumn("_block", cells.salt("passage_id", F.col("_blocks")))
             .withColumn("_group", cells.numbered(F.col("_groups"))).drop("_blocks", "_groups"))
    schema = T.StructType([stems.schema[key], met.schema["passage_id"], met.schema["page_start"], T.StructField("score", T.DoubleType())])
    keys = ["collection_id", "_block", "_group"]
    return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(_summed(key, depth), schema)


def text_candidates(queries: DataFrame, postings: DataFrame | TextBlocks, depth: int, key: str = "query_id") -> DataFrame:
    """Top `depth` by text score: of stored blocks only those are read that can reach a query's list, of plain postings all that hold a stem."""
    if isinstance(postings, TextBlocks):
        found, _, _ = textblocks.waves(query_stems(queries, key), postings, depth, key)
    else:
        found = text_scores(query_stems(queries, key), postings, depth, key)
    return top_per(found, [key], [F.col("score").desc(), F.col("passage_id")], depth)


# --- fusion ----------------------------------------------------------------------------

def fuse(by_vector: DataFrame, by_text: DataFrame, limit: int, key: str = "query_id") -> DataFrame:
    """Reciprocal Rank Fusion of two ranked lists (key, passage_id, page_start, rank).

    Early pages have a slight advantage; the lists bring their pages along, so no passage is looked up.
    """
    columns = [key, "passage_id", "page_start", "rank"]
    votes = by_vector.select(*columns).unionByName(by_text.select(*columns))
    summed = (votes.withColumn("vote", scores.rank_vote(F.col("rank")))
              .groupBy(key, "passage_id").agg(F.sum("vote").alias("votes"), F.max("page_start").alias("page_start")))
    score = F.round(scores.scaled(F.col("votes")) * scores.page_factor(F.col("page_start")), SCORE_DIGITS)
    return top_per(summed.select(key, "passage_id", score.alias("score")), [key],
                   [F.col("score").desc(), F.col("passage_id")], limit)


# --- neighbours ------------------------------------------------------------------------

PLACE = ["passage_id", "collection_id", "source_file", "hierarchy_path", "chunk_index"]


def placed(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Hits with the place of their passage. They are stored first: their size is known then, and few hits go to the passages, not these to them."""
    return written(hits).join(passages.select(*PLACE), "passage_id")


def neighbors(hits: DataFrame, passages: DataFrame, reach: int = 2) -> DataFrame:
    """Passages of the same document and chapter within `reach` chunks of each hit, itself included.

    The range becomes exact chunk numbers, so it stays an equi-join; a hit without a
    chapter only meets itself. `hits` needs collection_id, source_file, hierarchy_path and
    chunk_index; the passage's columns come as the struct `near`. What is wanted is stored, so that texts
    are shuffled only for batches whose wanted chunks are too many to send.
    """
    numbers = F.when(F.col("hierarchy_path") != "", F.sequence(
        F.col("chunk_index") - reach, F.col("chunk_index") + reach)).otherwise(F.array("chunk_index"))
    wanted = written(hits.withColumn("_at", F.explode(numbers)))
    near = passages.select(
        "collection_id", "source_file", "hierarchy_path", F.col("chunk_index").alias("_at"),
        F.struct("chunk_index", "passage_id", "title", "text", "page_start", "page_end").alias("near"))
    return wanted.join(near, ["collection_id", "source_file", "hierarchy_path", "_at"]).drop("_at")


def expand_top(hits: DataFrame, passages: DataFrame, top: int = L.EXPAND_TOP, reach: int = 2,
               key: str = "query_id") -> DataFrame:
    """The best results take in their neighbours; what is taken in vanishes from later ranks.

    Input: ranked (key, passage_id, rank, score). Output: one row per query with
    `sections`, an array in rank order. Hits are read once: their own text arrives with
    their neighbours, at most 2*reach+1 per hit, and the used-set fold runs over a handful
    of structs in one row.
    """
    around = neighbors(placed(hits.select(key, "passage_id", "rank", "score"), passages), passages, reach)
    per_query = around.groupBy(key).agg(F.collect_list(F.struct(F.struct(*HIT).alias("hit"), "near")).alias("around"))
    return per_query.select(key, absorb(by_hit(F.col("around")), top).alias("sections"))


HIT = ["rank", "passage_id", "score", "hierarchy_path", "source_file"]


def by_hit(around: Column) -> Column:
    """Neighbours with their hit, in any order, as ranked hits with their neighbours; texts are shuffled once for it, by query."""
    hits = F.sort_array(F.array_distinct(F.transform(around, lambda r: r["hit"])))
    return F.transform(hits, lambda hit: F.struct(*[hit[c].alias(c) for c in HIT], F.sort_array(F.transform(
        F.filter(around, lambda r: r["hit"].eqNullSafe(hit)), lambda r: r["near"])).alias("near")))


SECTION = ("struct<passage_id:string,title:string,text:string,page_start:int,page_end:int,"
           "hierarchy_path:string,source_file:string,chunk_index:int,score:double>")


def absorb(hits: Column, top: int) -> Column:
    """Fold over ranked hits with their neighbours: the first `top` survivors absorb what is near and free."""
    def section(hit: Column, near: Column) -> Column:
        own = F.get(F.filter(near, lambda n: n["passage_id"] == hit["passage_id"]), F.lit(0))
        return let(own, lambda o: F.struct(
            hit["passage_id"].alias("passage_id"), o["title"].alias("title"),
            F.array_join(F.transform(near, lambda n: n["text"]), "\n\n").alias("text"),
            F.get(near, F.lit(0))["page_start"].cast("int").alias("page_start"),
            F.element_at(near, -1)["page_end"].cast("int").alias("page_end"),
            hit["hierarchy_path"].alias("hierarchy_path"), hit["source_file"].alias("source_file"),
            o["chunk_index"].cast("int").alias("chunk_index"), hit["score"].alias("score")).cast(SECTION))

    def state(used: Column, out: Column) -> Column:
        return F.struct(used.alias("used"), out.alias("out"))

    def step(acc: Column, hit: Column) -> Column:
        expands = F.size(acc["out"]) < top
        taken = F.filter(hit["near"], lambda n: (n["passage_id"] == hit["passage_id"]) | (
            expands & ~F.array_contains(acc["used"], n["passage_id"])))
        return F.when(F.array_contains(acc["used"], hit["passage_id"]), acc).otherwise(let(taken, lambda near: state(
            F.concat(acc["used"], F.transform(near, lambda n: n["passage_id"])),
            F.array_append(acc["out"], section(hit, near)))))

    start = state(F.array().cast("array<string>"), F.array().cast(f"array<{SECTION}>"))
    return F.aggregate(hits, start, step, lambda acc: acc["out"])


# --- follow-up questions ---------------------------------------------------------------

def search_variants(queries: DataFrame) -> DataFrame:
    """The question alone and, with a history, also completed by it, newest turn first.

    `history` is array<struct<question, answer>>, oldest first, already trimmed.
    """
    asked = F.transform(F.reverse(F.col("history")), lambda t: t["question"])
    full = F.concat_ws(" ", F.col("question"), F.array_join(asked, " "))
    variants = F.when(F.size("history") > 0, F.array(F.col("question"), full)).otherwise(F.array("question"))
    return (queries.select("query_id", "collection_id", F.posexplode(variants).alias("variant", "question"))
            .withColumn("search_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string"))))


def interleaved(a: Column, b: Column, limit: int) -> Column:
    """a0, b0, a1, b1, ... without repeats of passage_id, at most `limit`."""
    def merge(mixed: Column) -> Column:
        return F.slice(F.filter(mixed, lambda s, i: ~F.exists(
            F.slice(mixed, 1, i), lambda e: e["passage_id"] == s["passage_id"])), 1, limit)
    pairs = F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))
    return let(F.filter(pairs, lambda s: s["passage_id"].isNotNull()), merge)


# --- the whole search ------------------------------------------------------------------

def search(queries: DataFrame, passages: DataFrame, postings: DataFrame | TextBlocks, limit: int = L.DEFAULT_LIMIT,
           min_score: float = L.MIN_COSINE, key: str = "query_id", stored: VectorCells | None = None) -> DataFrame:
    """(key, sections) for queries with key, collection_id, question and vector.

    A query without a vector is answered by text alone; `stored` are the cells of the passages' vectors, built here if they are not given.
    """
    depth = scores.candidate_depth(limit)
    by_vector = vector_candidates(queries, stored or passages, depth, min_score, key)
    by_text = text_candidates(queries, postings, depth, key)
    return expand_top(fuse(by_vector, by_text, limit, key), passages, key=key)


def search_with_history(queries: DataFrame, passages: DataFrame, postings: DataFrame | TextBlocks, embed,
                        limit: int = L.ASK_LIMIT, min_score: float = L.MIN_COSINE, stored: VectorCells | None = None) -> DataFrame:
    """Both variants of every question in one batch, interleaved to (query_id, sections)."""
    variants = written(search_variants(queries).withColumn("vector", embed(F.col("question"))))  # the embedder runs once
    found = (search(variants, passages, postings, limit, min_score, "search_id", stored)
             .withColumn("query_id", F.substring_index("search_id", "#", 1))
             .withColumn("variant", F.substring_index("search_id", "#", -1)))
    empty = F.first(F.slice(F.col("sections"), 1, 0), True)
    lists = found.groupBy("query_id").agg(
        F.first(F.when(F.col("variant") == "0", F.col("sections")), True).alias("own"),
        F.first(F.when(F.col("variant") == "1", F.col("sections")), True).alias("more"),
        empty.alias("none"))
    merged = lists.select("query_id", interleaved(
        F.coalesce("own", "none"), F.coalesce("more", "none"), limit).alias("sections"))
    ids = queries.select(F.col("query_id").cast("string").alias("query_id"), "collection_id", "question", "history")
    return ids.join(merged, "query_id", "left")
