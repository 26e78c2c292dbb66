"""Postings stored by block of passages, and exact text top-k that reads only the blocks that can matter.

Passages are numbered in the order they are stored, BLOCK_PASSAGES of a collection to a block, so neighbours of one document, which tend to
speak of one thing, share one; the blocks are made where the postings lie. A stored row is a stem in a block: the postings, summed to one weight per (stem, passage), beside the largest weight and their number.
The sum of the largest weights over the stems of a query bounds every score in a block. The first wave scores the blocks of highest
bound that hold `depth` passages and gives the query the score its last hit has at least; the second wave reads only blocks
whose bound can pass it and gives only passages that reach it. Blocks that lack a stem of a query which needs all are never read.

Bounds and scores are summed in tasks, a group of queries over a range of blocks, so neither single hits nor bounds by stem are shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from lutrin.operators.cells import SCORE_DIGITS, _apart, numbered, salt
from lutrin.operators.skew import top_per
from lutrin.session import written

BLOCK_PASSAGES = 32
RANGE_POSTINGS = 1_000_000  # postings, or rows of maxima, to one range of blocks
RANGE_PAIRS = 4_000_000  # queries times blocks that one task bounds
CHUNK_POSTINGS = 1_000_000  # postings that are dealt to blocks at a time
BATCH_ROWS = 50_000  # rows handed over at a time
PASSAGE = ["collection_id", "passage_id"]
KEY = ["collection_id", "stem", "block"]


@dataclass(frozen=True)
class TextBlocks:
    """postings (collection_id, stem, block, passage_id, page_start, weight) and maxima (collection_id, stem, block, most, n) are views of `rows`,
    which have them side by side (hits).
    """

    postings: DataFrame
    maxima: DataFrame
    rows: DataFrame


def _laid(rows: DataFrame, side: int, last: bool) -> DataFrame:
    """Rows of postings as rows (collection_id, stem, block, most, n, hits), made in one pass over each task's rows.

    Rows without a stem list the passages of a block. Unless these rows are the `last`, the first and the last passage of a task, which may go on
    in another one, get no block.
    """
    hit = T.StructType([rows.schema["passage_id"], rows.schema["page_start"], T.StructField("weight", T.DoubleType())])
    schema = T.StructType([rows.schema["collection_id"], T.StructField("stem", T.StringType()), T.StructField("block", T.LongType()),
                           T.StructField("most", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("hits", T.ArrayType(hit))])
    target = to_arrow_schema(schema)

    def given(rows: pa.RecordBatch, row: np.ndarray, weight: np.ndarray, starts: np.ndarray, values: dict) -> Iterator[pa.RecordBatch]:
        """Rows of which each has the hits from its start on; `row` and `weight` are those of the hits."""
        hits = pa.StructArray.from_arrays([rows.column(c).take(pa.array(row)) for c in ("passage_id", "page_start")] + [pa.array(weight)],
                                          fields=list(target.field("hits").type.value_type))
        values |= {"collection_id": rows.column("collection_id").take(pa.array(row[starts])),
                   "hits": pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), hits, type=target.field("hits").type)}
        out = pa.RecordBatch.from_arrays([values[f.name] if f.name in values else pa.nulls(len(starts), f.type) for f in target], schema=target)
        for at in range(0, len(out), BATCH_ROWS):
            yield out.slice(at, BATCH_ROWS)

    def edge(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        each = np.arange(len(rows))
        yield from given(rows, each, rows.column("weight").to_numpy(), each, {"stem": rows.column("stem")})

    def blocked(rows: pa.RecordBatch, starts: np.ndarray, following: int) -> Iterator[pa.RecordBatch]:
        passages = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(rows)))
        code = rows.column("collection_id").take(pa.array(starts)).dictionary_encode().indices.to_numpy()
        order = np.argsort(code, kind="stable")
        place = np.arange(len(starts)) - np.searchsorted(code[order], code[order])  # of a passage in its collection
        block = np.empty(len(starts), np.int64)
        block[order] = np.cumsum(place % BLOCK_PASSAGES == 0) - 1
        yield from given(rows, starts[order], np.zeros(len(starts)), np.flatnonzero(place % BLOCK_PASSAGES == 0),
                         {"block": pa.array(np.arange(block.max() + 1) + following)})
        stems = rows.column("stem").dictionary_encode()
        keys = (block[passages] * len(stems.dictionary) + stems.indices.to_numpy()) * len(starts) + passages
        by_key = np.argsort(keys)
        keys = keys[by_key]
        own = np.flatnonzero(np.diff(keys, prepend=-1))
        weight = np.add.reduceat(rows.column("weight").to_numpy()[by_key], own)
        both, passages = np.divmod(keys[own], len(starts))
        edges = np.flatnonzero(np.diff(both, prepend=-1))
        number, stem = np.divmod(both[edges], len(stems.dictionary))
        yield from given(rows, starts[passages], weight, edges, {
            "stem": stems.dictionary.take(pa.array(stem)), "block": pa.array(number + following),
            "most": pa.array(np.maximum.reduceat(weight, edges)), "n": pa.array(np.diff(edges, append=len(weight)))})

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following, first, held, n = 2 * TaskContext.get().partitionId() + side << 40, not last, [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += len(batch)
                if n < CHUNK_POSTINGS:
                    continue
            if not n:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            codes = [rows.column(c).dictionary_encode().indices.to_numpy() for c in PASSAGE]
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)]))
            cuts = [0, len(rows)]  # what lies between them is blocked now
            if first and len(starts) > 1:
                yield from edge(rows.slice(0, starts[1]))
                cuts[0], starts, first = starts[1], starts[1:], False
            if batch is not None or not last:
                cuts[1], starts = starts[-1], starts[:-1]
            if len(starts):
                yield from blocked(rows.slice(cuts[0], cuts[1] - cuts[0]), starts - cuts[0], following)
                following += len(starts)
            held = [rows.slice(cuts[1])]
            n = len(held[0])
        if n:
            yield from edge(held[0])
    return rows.mapInArrow(laid, schema)


def build(postings: DataFrame) -> TextBlocks:
    """Blocks of weighted postings (collection_id, stem, passage_id, page_start, field, weight, ...), as `index.postings` makes them.

    Where the postings of a passage follow each other, as they are made and stored, tasks deal them to blocks as they lie and only passages at
    the edges of tasks are brought together. If any other passage stands in two places, all postings are sorted by passage first.
    """
    rows = postings.filter("collection_id is not null and passage_id is not null").select(*PASSAGE, "page_start", "stem", "weight")

    def sorted_by_passage(rows: DataFrame) -> DataFrame:
        return rows.repartition(*PASSAGE).sortWithinPartitions(*PASSAGE)

    made = written(_laid(rows, 0, False))
    edges = made.filter("block is null").select("collection_id", "stem", F.inline("hits")).select(*rows.columns)
    there = (made.filter("stem is null").select("collection_id", F.inline("hits")).select(*PASSAGE)
             .unionByName(_apart(edges.select(*PASSAGE).distinct())))
    if there.groupBy(*PASSAGE).count().filter("count > 1").isEmpty():
        blocks = made.filter("block is not null and stem is not null").unionByName(
            written(_laid(sorted_by_passage(edges), 1, True)).filter("stem is not null"))
    else:
        blocks = written(_laid(sorted_by_passage(rows), 0, True)).filter("stem is not null")
    return TextBlocks(blocks.select(*KEY, F.inline("hits")), _apart(blocks.select(*KEY, "most", "n")), _apart(blocks))


def _spans(terms: pa.Table, stems: pa.ChunkedArray, key: str) -> tuple[pa.Table, np.ndarray, list[list[slice]], np.ndarray]:
    """Stems of a group of queries against rows with stems: the terms by query, the rows by stem, every query's runs of these rows, and its first term."""
    coded = stems.combine_chunks().dictionary_encode()
    code, number = coded.indices.to_numpy(), {s: i for i, s in enumerate(coded.dictionary.to_pylist())}
    by_stem = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[by_stem], np.arange(len(number) + 1)).tolist()
    terms = terms.sort_by(key)
    queries = terms[key].combine_chunks().dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero(np.diff(queries, prepend=-1, append=-1)) if len(queries) else np.zeros(1, np.int64)
    wanted = [number.get(s) for s in terms["stem"].to_pylist()]
    spans = [[slice(edges[i], edges[i + 1]) for i in wanted[at:end] if i is not None] for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return terms, by_stem, spans, cuts[:-1]


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _bounding(key: str):
    """(key, collection_id, block, bound, n) of a group of queries over a range of blocks."""
    def bounding(terms: pa.Table, rows: pa.Table) -> pa.Table:
        asked, found, most, held = [], [], [], []
        blocks, place = np.unique(rows["block"].to_numpy(), return_inverse=True)
        terms, by_stem, spans, firsts = _spans(terms, rows["stem"], key)
        place, weight, n = place[by_stem], rows["most"].to_numpy()[by_stem], rows["n"].to_numpy()[by_stem]
        needed = terms["needed"].to_numpy()
        for at, own in zip(firsts.tolist(), spans, strict=True):
            if not own:
                continue
            met = np.concatenate([place[s] for s in own])
            total, stems = np.bincount(met, np.concatenate([weight[s] for s in own]), len(blocks)), np.bincount(met, minlength=len(blocks))
            passages = np.zeros(len(blocks), np.int64)
            np.maximum.at(passages, met, np.concatenate([n[s] for s in own]))
            hit = np.flatnonzero((stems > 0) & (stems >= needed[at]))
            asked.append(np.full(len(hit), at))
            found.append(hit)
            most.append(total[hit])
            held.append(passages[hit])
        q = pa.array(_joined(asked, np.int64))
        return pa.table({key: terms[key].take(q), "collection_id": terms["collection_id"].take(q), "block": pa.array(blocks[_joined(found, np.int64)]),
                         "bound": pa.array(_joined(most, float)), "n": pa.array(_joined(held, np.int64))})
    return bounding


def bounds(stems: DataFrame, maxima: DataFrame, key: str) -> DataFrame:
    """(key, collection_id, block, bound, n) for every block in which the stems (key, collection_id, needed, stem) may be met.

    Ranges of blocks meet groups of queries; both are so small that a task makes RANGE_PAIRS bounds at most, roughly.
    """
    sizes = written(maxima.groupBy("collection_id").agg(F.count("*").alias("_rows"), F.approx_count_distinct("block").alias("_blocks")).join(
        stems.groupBy("collection_id").agg(F.approx_count_distinct(key).alias("_queries")), "collection_id")
        .withColumn("_ranges", F.ceil(F.col("_rows") / RANGE_POSTINGS).cast("int"))
        .select("collection_id", "_ranges", F.ceil(F.col("_queries") * F.col("_blocks") / F.col("_ranges") / RANGE_PAIRS).cast("int").alias("_groups")))
    asked = (stems.join(sizes, "collection_id").withColumn("_group", salt(key, F.col("_groups"))).withColumn("_range", numbered(F.col("_ranges")))
             .drop("_groups", "_ranges"))
    there = (maxima.join(sizes, "collection_id").withColumn("_range", salt("block", F.col("_ranges"))).withColumn("_group", numbered(F.col("_groups")))
             .drop("_groups", "_ranges"))
    schema = T.StructType([stems.schema[key], stems.schema["collection_id"], T.StructField("block", T.LongType()),
                           T.StructField("bound", T.DoubleType()), T.StructField("n", T.LongType())])
    keys = ["collection_id", "_range", "_group"]
    return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(_bounding(key), schema)


def _summing(key: str):
    """(key, passage_id, page_start, score) of a range of blocks; the queries come as their stems and, in rows without a stem, as the blocks they read."""
    def summing(queries: pa.Table, rows: pa.Table) -> pa.Table:
        asked, found, totals = [], [], []
        is_term = queries["stem"].is_valid()
        wanted = queries.filter(pc.invert(is_term)).sort_by(key)
        ids = rows["passage_id"].combine_chunks().dictionary_encode()
        blocks, block = np.unique(rows["block"].to_numpy(), return_inverse=True)
        terms, by_stem, spans, firsts = _spans(queries.filter(is_term), rows["stem"], key)
        page = rows["page_start"].take(pa.array(np.unique(ids.indices.to_numpy(), return_index=True)[1]))
        place, weight, block = ids.indices.to_numpy()[by_stem], rows["weight"].to_numpy()[by_stem], block[by_stem]
        needed, names = terms["needed"].to_numpy(), terms[key].take(pa.array(firsts)).to_pylist()
        read, floors = wanted["block"].to_numpy(), wanted["floor"].to_numpy(zero_copy_only=False).astype(float)
        owners = wanted[key].combine_chunks().dictionary_encode()
        edges = np.searchsorted(owners.indices.to_numpy(), np.arange(len(owners.dictionary) + 1)).tolist()
        own_blocks = {q: (edges[i], edges[i + 1]) for i, q in enumerate(owners.dictionary.to_pylist())}
        for at, q, own in zip(firsts.tolist(), names, spans, strict=True):
            if q not in own_blocks or not own:
                continue
            begin, end = own_blocks[q]
            here = np.searchsorted(blocks, read[begin:end])
            here = here[blocks[np.minimum(here, len(blocks) - 1)] == read[begin:end]]
            opened = np.zeros(len(blocks), bool)
            opened[here] = True
            met, add, kept = (np.concatenate([f(x) for x in own]) for f in (place.__getitem__, weight.__getitem__, lambda x: opened[block[x]]))
            met = met[kept]
            score, stems = np.round(np.bincount(met, add[kept], len(page)), SCORE_DIGITS), np.bincount(met, minlength=len(page))
            hit = stems >= max(needed[at], 1)
            if not np.isnan(floors[begin]):
                hit &= score >= floors[begin]
            hit = np.flatnonzero(hit)
            asked.append(np.full(len(hit), at))
            found.append(hit)
            totals.append(score[hit])
        q, p = pa.array(_joined(asked, np.int64)), pa.array(_joined(found, np.int64))
        return pa.table({key: terms[key].take(q), "passage_id": ids.dictionary.take(p), "page_start": page.take(p), "score": pa.array(_joined(totals, float))})
    return summing


def scores(stems: DataFrame, blocks: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(key, passage_id, page_start, score) of the passages of the blocks (key, collection_id, block) that hold any stem, or all by `needed`.

    Blocks may name the `floor` their query's list has already: passages below it are not given. Ranges of blocks of RANGE_POSTINGS
    meet all queries that read one of them.
    """
    sizes = written(postings.groupBy("collection_id").agg(F.ceil(F.count("*") / RANGE_POSTINGS).cast("int").alias("_ranges")))
    floor = F.col("floor") if "floor" in blocks.columns else F.lit(None)
    opened = (blocks.join(sizes, "collection_id")
              .select(key, "collection_id", F.lit(None).cast("string").alias("stem"), F.lit(0).alias("needed"), "block", floor.cast("double").alias("floor"),
                      salt("block", F.col("_ranges")).alias("_range")))
    terms = (stems.join(sizes, "collection_id")
             .select(key, "collection_id", "stem", "needed", F.lit(None).cast("long").alias("block"), F.lit(None).cast("double").alias("floor"),
                     numbered(F.col("_ranges")).alias("_range")))
    there = postings.join(sizes, "collection_id").withColumn("_range", salt("block", F.col("_ranges"))).drop("_ranges")
    schema = T.StructType([stems.schema[key], postings.schema["passage_id"], postings.schema["page_start"], T.StructField("score", T.DoubleType())])
    keys = ["collection_id", "_range"]
    return opened.unionByName(terms).groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(_summing(key), schema)


def reaches(bound: Column, floor: Column) -> Column:
    """Whether a block can still hold a score of at least `floor`, roundings allowed for; a query without a full list reads on."""
    return floor.isNull() | (bound + F.lit(2 * 10.0**-SCORE_DIGITS) >= floor)


def waves(stems: DataFrame, stored: TextBlocks, depth: int, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates that hold every query's `depth` best, and the blocks read in the first and second wave."""
    stems = written(stems)
    asked = written(stems.select("collection_id", "stem").distinct())
    met = written(stored.rows.join(asked, ["collection_id", "stem"], "left_semi"))  # neither wave shuffles rows of other stems
    postings = met.select(*KEY, F.inline("hits"))
    known = written(bounds(stems, met.select(*KEY, "most", "n"), key))
    # a block holds a passage at least, so the first wave is among the `depth` blocks of highest bound
    highest = top_per(known, [key, "collection_id"], [F.col("bound").desc(), F.col("block")], depth, "_at")
    sooner = W.partitionBy(key, "collection_id").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = written(highest.withColumn("_held", F.sum("n").over(sooner) - F.col("n")).filter(F.col("_held") < depth).drop("_at", "_held"))
    near = written(scores(stems, first, postings, key))
    last = top_per(near, [key], [F.col("score").desc(), F.col("passage_id")], depth).filter(F.col("rank") == depth)
    later = known.join(first.select(key, "collection_id", "block"), [key, "collection_id", "block"], "left_anti")
    second = later.join(last.select(key, F.col("score").alias("floor")), key, "left").filter(reaches(F.col("bound"), F.col("floor")))
    second = written(second.select(key, "collection_id", "block", "floor"))
    return near.unionByName(scores(stems, second, postings, key)), first, second.drop("floor")
