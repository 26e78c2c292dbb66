"""Embedding near-duplicates by an inverted multi-index.

Two independent codebooks, one per half of the unit vectors, span a product grid. Every vector is stored in the cell of its two
nearest centroids. As a query it visits cells in the order of the sum of both squared distances (multi-sequence
order) until the sum exceeds that of its own cell by a margin. The margin is the larger of two: one that reaches random
directions at the threshold, and one that reaches the real links of QUERIES vectors, found by brute force among all rows;
each so that a neighbour lies in a visited cell with the target probability. Since either vector of a pair may find the
other, recall is higher still. Vectors met in a cell are verified by their cosine in double precision.

The codebooks are fitted on at most SAMPLE vectors (smallest hash), every vector is indexed. Equal vectors are one class with a
multiplicity. Cells with many members or queries are dealt to blocks; a block returns link counts and a spanning forest of
its links, never all pairs. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
vectors of different length. Rows with a null vec_id have no links and no component. Rows that share a vec_id are linked to
what any of them links to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lutrin.llm.common import components, forest, release_memory, written

THRESHOLD = 0.95
RECALL = 0.995
SAMPLE = 20_000
MOST_CENTROIDS = 1024
PER_CELL = 8
BLOCK = 2048
TRIALS = 4000
QUERIES = 2048
BINS = 1 << 14  # per unit of squared distance, for the distances of real links


def unit(vector) -> np.ndarray | None:
    """The vector in double precision at length one; None if it cannot link."""
    if vector is None or not len(vector):
        return None
    x = np.array([np.nan if v is None else v for v in vector], np.float64) if getattr(vector, "dtype", None) in (None, object) else \
        np.asarray(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


@F.pandas_udf(T.BinaryType())
def _packed(vectors: pd.Series) -> pd.Series:
    units = (unit(v) for v in vectors)
    return pd.Series([None if u is None else u.tobytes() for u in units], dtype=object)


def _matrix(blobs) -> np.ndarray:
    blobs = list(blobs)
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _squared(x, c).argmin(1)
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = counts > 0
        c[full] = sums[full] / counts[full, None]
        c[~full] = x[rng.integers(len(x), size=int((~full).sum()))]
    return c


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves, and how far beyond the nearest cell a query goes on."""

    first: np.ndarray
    second: np.ndarray
    margin: float

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, threshold: float, recall: float) -> MultiIndex:
        rng = np.random.default_rng(5)
        k = int(min(MOST_CENTROIDS, max(1, 2 ** round(np.log2(max(1.0, (rows / PER_CELL) ** 0.5))))))
        half = sample.shape[1] // 2
        index = cls(_centroids(sample[:, :half], k, rng), _centroids(sample[:, half:], k, rng), 0.0)
        x = sample[rng.integers(len(sample), size=TRIALS)]
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        norm = np.sqrt((noise * noise).sum(1))[:, None]
        y = threshold * x + np.sqrt(1 - threshold**2) * np.divide(noise, norm, out=np.zeros_like(noise), where=norm > 0)
        return cls(index.first, index.second, float(np.quantile(index.beyond(x, *index.cell(y)), recall)) + 1e-12)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _squared(x[:, :half], self.first), _squared(x[:, half:], self.second)

    def cell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(1), b.argmin(1)

    def beyond(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How much farther than the own cell the cells (i, j) are from the rows of x."""
        a, b = self.distances(x)
        n = np.arange(len(x))
        return a[n, i] - a.min(1) + b[n, j] - b.min(1)

    def visited(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Cells that each row visits, nearest first, up to the margin."""
        a, b = self.distances(x)
        for p, q in zip(a - a.min(1)[:, None], b - b.min(1)[:, None], strict=True):
            i, j = np.flatnonzero(p <= self.margin), np.flatnonzero(q <= self.margin)
            total = p[i][:, None] + q[j][None, :]
            near = np.nonzero(total <= self.margin)
            order = np.argsort(total[near], kind="stable")
            yield (i[near[0][order]] * len(self.second) + j[near[1][order]]).astype(np.int64)


def _real_margin(index: MultiIndex, classes: DataFrame, queries: np.ndarray, threshold: float, recall: float) -> float:
    """The margin that reaches the target share of all links of the queries, from a histogram of how far beyond they lie."""
    def counted(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = index.distances(queries)
        a, b = a - a.min(1)[:, None], b - b.min(1)[:, None]
        total = np.zeros(0, np.int64)
        for pdf in pdfs:
            for at in range(0, len(pdf), 512):
                x = _matrix(pdf["unit"].iloc[at:at + 512])
                i, j = index.cell(x)
                cosines = x @ queries.T
                r, q = np.nonzero((cosines >= threshold) & (cosines < 1 - 1e-12))  # not the query itself
                own = np.bincount(np.ceil((a[q, i[r]] + b[q, j[r]]) * BINS).astype(np.int64), minlength=len(total))
                own[:len(total)] += total
                total = own
        full = np.flatnonzero(total)
        release_memory()
        yield pd.DataFrame({"bin": full, "links": total[full]})

    rows = (classes.select("unit").mapInPandas(counted, "bin long, links long")
            .groupBy("bin").agg(F.sum("links").alias("links")).orderBy("bin").collect())
    if not rows:
        return 0.0
    reached = np.cumsum([r["links"] for r in rows])
    return rows[int(np.searchsorted(reached, recall * reached[-1]))]["bin"] / BINS


def _met(index: MultiIndex, threshold: float):
    """Link weights and forest edges of one block of a cell: members (own vectors) and visiting queries."""
    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        here, seen = pdf[pdf["member"].to_numpy()], pdf[~pdf["member"].to_numpy()]
        none = pd.DataFrame({"rep": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "weight": pd.Series(dtype="int64"), "edge": pd.Series(dtype="bool")})
        if not len(here) or not len(seen):
            return none
        x, y = _matrix(seen["unit"]), _matrix(here["unit"])
        linked = x @ y.T >= threshold
        a, b = seen["rep"].to_numpy(), here["rep"].to_numpy()
        linked &= a[:, None] != b[None, :]
        if not linked.any():
            return none
        many_x, many_y = seen["many"].to_numpy(), here["many"].to_numpy()
        weight_x, weight_y = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        i, j = np.divmod(seen["home"].to_numpy(), len(index.second))
        first, second = (d - d.min(1)[:, None] for d in index.distances(y))
        for at in range(0, len(a), 256):
            r, c = np.nonzero(linked[at:at + 256])
            r += at
            weight_x += np.bincount(r, many_y[c], len(a)).astype(np.int64)
            alone = first[c, i[r]] + second[c, j[r]] > index.margin
            weight_y += np.bincount(c[alone], many_x[r[alone]], len(b)).astype(np.int64)
        u, v = forest(linked, a, b)
        out = pd.DataFrame({"rep": np.concatenate([a, b, u]), "other": np.concatenate([np.full(len(a) + len(b), -1), v]),
                            "weight": np.concatenate([weight_x, weight_y, np.zeros(len(u), np.int64)])})
        edge = np.arange(len(out)) >= len(a) + len(b)
        out["edge"] = edge
        return out[edge | (out["weight"] > 0)]
    return met


def _linked(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(rep, other, weight, edge): link weights (edge false) and forest edges (edge true) of vectors of one length."""
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("unit").collect()
    sample = _matrix(r["unit"] for r in chosen)
    index = MultiIndex.fit(sample, classes.count(), threshold, recall)
    index = replace(index, margin=max(index.margin, _real_margin(index, classes, sample[:QUERIES], threshold, recall) + 1e-12))

    def indexed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at:at + 1024]
                x = _matrix(part["unit"])
                i, j = index.cell(x)
                yield pd.DataFrame({"rep": part["rep"], "many": part["many"], "unit": part["unit"],
                                    "home": i * len(index.second) + j, "visits": list(index.visited(x))})

    placed = written(classes.select("rep", "many", "unit").mapInPandas(indexed, "rep long, many long, unit binary, home long, visits array<long>"))
    visits = placed.select("rep", F.explode("visits").alias("cell"))
    crowd = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ms")).join(
        visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qs")), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    members = placed.withColumn("cell", F.col("home")).join(crowd, "cell").withColumn("m", mine("ms")).withColumn("q", every("qs"))
    queries = placed.withColumn("cell", F.explode("visits")).join(crowd, "cell").withColumn("q", mine("qs")).withColumn("m", every("ms"))
    columns = ["cell", "m", "q", "rep", "many", "unit", "home"]
    both = members.select(*columns, F.lit(True).alias("member")).unionByName(queries.select(*columns, F.lit(False).alias("member")))
    return both.groupBy("cell", "m", "q").applyInPandas(_met(index, threshold), "rep long, other long, weight long, edge boolean")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, any more)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _packed("embedding").alias("unit"))
    good = rows.filter("vec_id is not null and unit is not null").withColumn("key", F.sha2("unit", 256))
    classes = written(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("many"), F.first("unit").alias("unit")))
    member = written(good.select("vec_id", "key").distinct().join(classes.select("key", "rep", "many"), "key").drop("key"))
    sizes = [r["n"] for r in classes.select(F.octet_length("unit").alias("n")).distinct().collect()]
    found = spark.createDataFrame([], "rep long, other long, weight long, edge boolean")
    for n in sorted(sizes):
        found = found.unionByName(_linked(classes.filter(F.octet_length("unit") == n), threshold, recall))
    found = written(found)
    weights = found.filter("not edge").groupBy("rep").agg(F.sum("weight").alias("links"))
    shared = member.groupBy("vec_id").agg(F.min("rep").alias("low"), F.collect_set("rep").alias("reps"))  # a repeated vec_id
    edges = found.filter("edge").select(F.col("rep").alias("a"), F.col("other").alias("b")).unionByName(
        shared.filter(F.size("reps") > 1).select(F.explode("reps").alias("a"), F.col("low").alias("b")))
    parts = components(edges)
    owned = (member.join(weights, "rep", "left").join(parts, member["rep"] == parts["id"], "left")
             .groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"),
                                    F.min(F.coalesce("component", "rep")).alias("component")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(owned, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
