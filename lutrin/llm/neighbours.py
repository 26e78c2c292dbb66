"""Approximate nearest neighbours by inner product: a neighbour graph built by NN-descent, searched greedily.

Building: equal vectors are one node. Two orders along random projections give every node first neighbours among the rows beside it. Each round
then joins the neighbours of neighbours: every node gathers its own list and at most REVERSE nodes that list it, all pairs in that gathering are scored
at once, and a pair is proposed to either node if it beats that node's last neighbour. Lists keep the DEGREE best by cosine. Rounds end after
ROUNDS, or when proposals fall below STILL of all edges.

Searching: a query starts at its own node and the best of ENTRIES entry points (the longest vectors and a sample), keeps the POOL best nodes met so
far by inner product, and in each of STEPS steps opens its EXPANDED best unopened nodes; all queries take a step together as one join with the graph.
The RERANKED best are scored in double precision on the original vectors. Queries with equal vectors are searched once.

Between, vectors travel as codes of one byte a component with step and norm, 8 bytes more. Node lists are bounded by DEGREE + REVERSE, groups by the
rank in their order, so a hub costs no more than any node. Every row is indexed; the graph and the search are approximate, and
the recall against brute force is measured in the tests and stated in the README.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without a vec_id; rows that share
a vec_id count as one, with the vector first in byte order; vectors of different length are no candidates for each other; equal scores go by vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lutrin.llm.common import written

DEGREE = 32
REVERSE = 32
ROUNDS = 4
STILL = 0.01
PROPOSED = 8  # partners that one gathering proposes to one node at most
BESIDE = 512  # rows of the first orders that are compared with each other
ORDERS = 2
GATHERED = 4096
ENTRIES = 256
POOL = 256
EXPANDED = 96
STEPS = 5
RERANKED = 64
TAIL = 8  # bytes of step and norm behind a code
EDGE = "a long, b long, score float"


@F.pandas_udf(T.BinaryType())
def _raw(vectors):
    """The vector in double precision as bytes, null if it takes no part."""
    import pandas as pd

    def one(v):
        if v is None or not len(v):
            return None
        x = np.array([np.nan if c is None else c for c in v], np.float64) + 0.0  # one zero only
        return x.tobytes() if np.isfinite(x).all() and x.any() else None
    return pd.Series([one(v) for v in vectors], dtype=object)


@F.pandas_udf(T.BinaryType())
def _code(raws):
    """Components of the unit vector in steps of a 127th of the largest one, then that step and the norm in single precision."""
    import pandas as pd

    def one(raw):
        x = np.frombuffer(raw, np.float64)
        top = np.abs(x).max()
        norm = top * np.sqrt(np.square(x / top).sum())
        unit = x / norm
        step = np.abs(unit).max() / 127
        tail = np.array([step, min(norm, float(np.finfo(np.float32).max))], np.float32)
        return np.round(unit / step).astype(np.int8).tobytes() + tail.tobytes()
    return pd.Series([one(r) for r in raws], dtype=object)


@F.pandas_udf(T.DoubleType())
def _norm(raws):
    import pandas as pd

    return pd.Series([float(np.abs(x).max() * np.sqrt(np.square(x / np.abs(x).max()).sum())) for x in (np.frombuffer(r, np.float64) for r in raws)],
                     dtype=np.float64)


def decoded(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision, and norms, of codes of one length."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    n = len(codes)
    if not n:
        return np.zeros((0, 0), np.float32), np.zeros(0, np.float32)
    offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset:codes.offset + n + 1]
    rows = np.frombuffer(codes.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(n, -1)
    tail = np.ascontiguousarray(rows[:, -TAIL:]).view(np.float32)
    return rows[:, :-TAIL].view(np.int8).astype(np.float32) * tail[:, :1], tail[:, 1]


@dataclass(frozen=True)
class Graph:
    """nodes (id, key, raw, size, code, norm), lists (id, near: (u, code) of its neighbours either way), rows (id of the node, vec_id)."""

    nodes: DataFrame
    lists: DataFrame
    rows: DataFrame


def _first_neighbours(nodes: DataFrame, seed: int, parts: int) -> DataFrame:
    """Edges between rows that stand together in an order along random directions."""
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x, _ = decoded(part.column("code"))
                along = x @ np.random.default_rng([seed, int(size)]).standard_normal((x.shape[1], 17)).astype(np.float32)
                signs = ((along[:, :16] > 0) * (1 << np.arange(16))).sum(1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("size"), part.column("code"), pa.array(signs),
                                                  pa.array(along[:, 16])], names=["id", "size", "code", "signs", "along"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            sizes = rows["size"].to_numpy()
            for size in np.unique(sizes):
                part = rows.filter(pa.array(sizes == size)).combine_chunks()
                for at in range(0, len(part), BESIDE):
                    some = part.slice(at, BESIDE)
                    x, _ = decoded(some["code"])
                    ids = some["id"].to_numpy()
                    yield _best_pairs(ids, x @ x.T, min(DEGREE, len(ids) - 1))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8 * BESIDE:
                yield from compared()
                held.clear()
        if held:
            yield from compared()

    placed = nodes.select("id", "size", "code").mapInArrow(projected, "id long, size int, code binary, signs long, along float")
    order = ["size", "signs", "along"]
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(beside, EDGE)


def _edges(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(score.astype(np.float32))],
                                      names=["a", "b", "score"])


def _best_pairs(ids: np.ndarray, scores: np.ndarray, most: int) -> pa.RecordBatch:
    if most <= 0:
        return _edges(*np.zeros((3, 0)))
    scores = np.round(scores, 6)
    np.fill_diagonal(scores, -np.inf)
    top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    return _edges(np.repeat(ids, most), ids[top].ravel(), np.take_along_axis(scores, top, 1).ravel())


def _best(edges: DataFrame) -> DataFrame:
    """The DEGREE best distinct edges of every node; equal edges have equal rank and are cut before the shuffle with the others."""
    rank = F.dense_rank().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))
    return edges.withColumn("_rank", rank).filter(F.col("_rank") <= DEGREE).groupBy("a", "b").agg(F.max("score").alias("score"))


def _gathered(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(id, near): for every node the nodes it lists and at most REVERSE that list it, with their codes and the score a new neighbour must beat."""
    both = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), F.lit(0).alias("back"), "score").unionByName(
        graph.select(F.col("b").alias("v"), F.col("a").alias("u"), F.lit(1).alias("back"), "score"))
    rank = F.row_number().over(W.partitionBy("v").orderBy("back", F.desc("score"), "u"))
    pairs = both.withColumn("_rank", rank).filter(F.col("_rank") <= DEGREE + REVERSE).groupBy("v", "u").agg(F.first("back").alias("back")).drop("back")
    last = graph.groupBy("a").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = nodes.select("id", "code").join(last, nodes["id"] == last["a"], "left").select(
        F.col("id").alias("u"), "code", F.when(F.col("n") >= DEGREE, F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    return pairs.join(known, "u").groupBy("v").agg(F.collect_list(F.struct("u", "code", "least")).alias("near"))


def _lists(near: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Lengths of the lists and their items in one array."""
    return near.value_lengths().to_numpy(zero_copy_only=False), near.flatten()


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every gathering that beat the last neighbour of one of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, GATHERED):
            lengths, items = _lists(batch.column("near").slice(at, GATHERED))
            x, _ = decoded(items.field("code")) if len(set(pa.compute.binary_length(items.field("code")).to_pylist())) == 1 else (None, None)
            ids, least = items.field("u").to_numpy(), items.field("least").to_numpy()
            starts = np.concatenate(([0], np.cumsum(lengths)))
            out = []
            for i, (low, high) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                if high - low < 2:
                    continue
                y = x[low:high] if x is not None else decoded(items.field("code").slice(low, high - low))[0]
                scores = np.round(y @ y.T, 6)
                np.fill_diagonal(scores, -np.inf)
                most = min(PROPOSED, high - low - 1)
                top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
                value = np.take_along_axis(scores, top, 1)
                r, c = np.nonzero(value >= least[low:high, None])
                out.append((ids[low + r], ids[low + top[r, c]], value[r, c]))
            if out:
                a, b, score = (np.concatenate(z) for z in zip(*out, strict=True))
                order = np.lexsort((b, a))
                a, b, score = a[order], b[order], score[order]
                first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield _edges(a[first], b[first], score[first])


def build(vectors: DataFrame) -> Graph:
    """The neighbour graph over all rows of vectors (vec_id, embedding, any more)."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _raw("embedding").alias("raw")).filter("vec_id is not null and raw is not null")
    rows = written(rows.groupBy("vec_id").agg(F.min("raw").alias("raw")).withColumn("key", F.sha2("raw", 256)))
    nodes = rows.groupBy("key").agg(F.min("vec_id").alias("id"), F.min("raw").alias("raw"))
    nodes = written(nodes.select("id", "key", "raw", F.octet_length("raw").alias("size"), _code("raw").alias("code"), _norm("raw").alias("norm")))
    owned = written(rows.select("vec_id", "key").join(nodes.select("key", "id"), "key").select("id", "vec_id"))
    first = _first_neighbours(nodes, 1, parts)
    for seed in range(2, ORDERS + 1):
        first = first.unionByName(_first_neighbours(nodes, seed, parts))
    graph = written(_best(first))
    for _ in range(ROUNDS):
        proposed = written(_gathered(nodes, graph).mapInArrow(_proposals, EDGE).join(
            graph.select("a", "b"), ["a", "b"], "left_anti"))
        new, old = proposed.count(), graph.count()
        if not new:
            break
        graph = written(_best(graph.unionByName(proposed.select("a", "b", "score"))))
        if new < STILL * old:
            break
    lists = written(_gathered(nodes, graph).select(F.col("v").alias("id"), F.transform("near", lambda n: F.struct(
        n["u"].alias("u"), n["code"].alias("code"))).alias("near")))
    return Graph(nodes, lists, owned)


STATE = "q long, code binary, ids array<long>, scores array<float>, opened array<boolean>"


def _merged(ids: np.ndarray, scores: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The POOL best distinct nodes, opened ones first among equals."""
    order = np.lexsort((ids, ~opened))
    ids, scores, opened = ids[order], scores[order], opened[order]
    _, first = np.unique(ids, return_index=True)
    by_id = np.argsort(ids, kind="stable")
    seen = np.zeros(len(ids), bool)
    new_id = np.concatenate(([True], np.diff(ids[by_id]) != 0))
    seen[by_id[new_id]] = True
    ids, scores, opened = ids[seen], scores[seen], opened[seen]
    top = np.lexsort((ids, -scores))[:POOL]
    return ids[top], scores[top], opened[top]


def search(graph: Graph, starts: DataFrame) -> DataFrame:
    """(q, id, score): for every node q of `starts` the RERANKED best nodes found, itself included, scored in double precision."""
    drawn = [graph.nodes.select("id", "code").orderBy(*order).limit(ENTRIES // 2) for order in ((F.desc("norm"), "id"), (F.xxhash64("id"), "id"))]
    entries = drawn[0].unionByName(drawn[1]).distinct().collect()  # at most ENTRIES rows: the longest vectors and a sample
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in {len(r["code"]) for r in entries}:
        some = [r for r in entries if len(r["code"]) == size]
        x, norm = decoded(pa.array([bytes(r["code"]) for r in some], pa.binary()))
        by_size[size] = (np.array([r["id"] for r in some], np.int64), x, norm)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"q": [], "code": [], "ids": [], "scores": [], "opened": []}
            for q, code in zip(batch.column("q").to_pylist(), batch.column("code").to_pylist(), strict=True):
                x, norm = decoded(pa.array([code], pa.binary()))
                ids, scores = np.array([q], np.int64), norm * norm
                if len(code) in by_size:
                    other, y, length = by_size[len(code)]
                    ids, scores = np.concatenate([ids, other]), np.concatenate([scores, (y @ x[0]) * length * norm[0]])
                order = np.argsort(-scores[1:], kind="stable")[:8] + 1  # the nearest entry points
                keep = np.concatenate(([0], order[ids[order] != q]))
                for name, value in (("q", q), ("code", code), ("ids", ids[keep]), ("scores", scores[keep].astype(np.float32)), ("opened", [False] * len(keep))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=STATE_SCHEMA)

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, opened = batch.column("opened").value_lengths().to_numpy(), batch.column("opened").flatten().to_numpy(zero_copy_only=False)
            ids, scores = batch.column("ids").flatten().to_numpy(), batch.column("scores").flatten().to_numpy()
            at = np.repeat(np.arange(batch.num_rows), lengths)
            free = np.flatnonzero(~opened)  # lists are sorted by score
            own = at[free]
            rank = np.arange(len(free)) - np.searchsorted(own, own)
            free = free[rank < EXPANDED]
            ends = np.cumsum(lengths)
            bar = np.where(lengths >= POOL, scores[ends - 1], -np.inf).astype(np.float32)
            rows = pa.array(at[free])
            yield pa.RecordBatch.from_arrays([batch.column("q").take(rows), batch.column("code").take(rows), pa.array(ids[free]), pa.array(bar[at[free]])],
                                             names=["q", "code", "id", "bar"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out_ids, out_scores = [], []
                bars, codes = part.column("bar").to_numpy(), part.column("code")
                lengths, items = _lists(part.column("near"))
                starts_ = np.concatenate(([0], np.cumsum(lengths)))
                for i in range(part.num_rows):
                    some = items.slice(starts_[i], lengths[i])
                    y, norm = decoded(some.field("code"))
                    x, own = decoded(codes.slice(i, 1))
                    scores = (y @ x[0]) * norm * own[0]
                    good = scores > bars[i]
                    out_ids.append(some.field("u").to_numpy()[good])
                    out_scores.append(scores[good].astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column("q"), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float32()))],
                                                 names=["q", "more", "more_scores"])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"q": batch.column("q").to_pylist(), "code": batch.column("code").to_pylist(), "ids": [], "scores": [], "opened": []}
            lists = {c: batch.column(c) for c in ("ids", "scores", "opened", "more", "more_scores")}
            for i in range(batch.num_rows):
                ids, scores, opened, more, more_scores = (lists[c][i].values for c in lists)
                opened = opened.to_numpy(zero_copy_only=False).copy()
                opened[np.flatnonzero(~opened)[:EXPANDED]] = True
                more = more.to_numpy() if more is not None else np.zeros(0, np.int64)
                more_scores = more_scores.to_numpy() if more_scores is not None else np.zeros(0, np.float32)
                merged = _merged(np.concatenate([ids.to_numpy(), more]), np.concatenate([scores.to_numpy(), more_scores]),
                                 np.concatenate([opened, np.zeros(len(more), bool)]))
                for name, value in zip(("ids", "scores", "opened"), merged, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=STATE_SCHEMA)

    state = written(starts.select(F.col("id").alias("q")).join(graph.nodes.select(F.col("id").alias("q"), "code"), "q").mapInArrow(begun, STATE))
    for _ in range(STEPS):
        front = state.mapInArrow(opening, "q long, code binary, id long, bar float")
        found = front.join(graph.lists, "id").select("q", "code", "bar", "near").mapInArrow(met, "q long, more array<long>, more_scores array<float>")
        sums = found.groupBy("q").agg(F.flatten(F.collect_list("more")).alias("more"), F.flatten(F.collect_list("more_scores")).alias("more_scores"))
        state = written(state.join(sums, "q", "left").mapInArrow(stepped, STATE))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [float((np.frombuffer(a, np.float64) * np.frombuffer(b, np.float64)).sum())
                      for a, b in zip(batch.column("own").to_pylist(), batch.column("raw").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), pa.array(values)], names=["q", "id", "score"])

    pairs = state.select("q", F.explode(F.slice("ids", 1, RERANKED)).alias("id"))
    raws = graph.nodes.select("id", "raw")
    return pairs.join(raws, "id").join(raws.select(F.col("id").alias("q"), F.col("raw").alias("own")), "q").mapInArrow(
        scored, "q long, id long, score double")


STATE_SCHEMA = pa.schema([("q", pa.int64()), ("code", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())),
                          ("opened", pa.list_(pa.bool_()))])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to every row that `is_query` (over vec_id) holds for, itself left out."""
    graph = build(vectors)
    queries = graph.rows.filter(is_query).select("id", F.col("vec_id").alias("query_id"))
    found = written(search(graph, queries.select("id").distinct()))
    rank = F.row_number().over(W.partitionBy("id").orderBy("vec_id"))
    members = graph.rows.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1).select("id", "vec_id")
    each = found.join(members, "id").select("q", "vec_id", "score")
    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = each.withColumn("_rank", order).filter(F.col("_rank") <= k + 1).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "vec_id", "score"))).alias("best"))
    own = queries.join(best, queries["id"] == best["q"]).select(
        "query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
