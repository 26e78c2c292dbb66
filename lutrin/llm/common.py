"""Helpers the operators of this folder share: word hashing in vectors, running totals and components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.session import written

U64 = np.uint64
NULL_ID = -(2**63)
BATCH_BYTES = 1 << 19
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def long_rows(df: DataFrame) -> DataFrame:
    """The same rows; the session hands at most BATCH_ROWS of them to a Python worker at once, as texts may be long."""
    spark = df.sparkSession
    now = int(spark.conf.get(ARROW_ROWS))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return df


def release_memory() -> None:
    """Gives what a finished partition has freed back to the system, as the worker lives on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def worker_value(key: str, make: Callable):
    """A value made once per Python worker and kept for its later tasks."""
    kept = sys.modules.setdefault("_lutrin_worker", types.ModuleType("_lutrin_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published SplitMix64 steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def _byte_values(fold: bool) -> np.ndarray:
    values = mixed(np.arange(256, dtype=U64) + U64(0x5DEECE66D))
    if fold:
        values[65:91] = values[97:123]
    return values


SPACES = b" \t\n\r\x0b\x0c"


def byte_batches(rows: Iterable, size: Callable = len, most: int = BATCH_BYTES) -> Iterator[list]:
    """Lists of rows of about `most` bytes; one larger row makes a list of its own."""
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += size(row) + 64
        if held >= most:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def _hashed(text: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    values = worker_value(f"bytes{fold}", lambda: _byte_values(fold))
    blank = worker_value("blank", lambda: np.isin(np.arange(256), list(SPACES)))
    raw = np.frombuffer(text, np.uint8)
    inside = ~blank[raw]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.zeros(0, U64), starts
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(first, len(kept)))
    place = kept - np.repeat(starts, lengths)
    powers = worker_value("powers", lambda: odd_numbers(4096, 77))
    if place.max() >= len(powers):
        powers = odd_numbers(int(place.max()) + 1, 77)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(values[raw[kept]] * powers[place], first)
        return mixed(sums + lengths.astype(U64) * U64(0x9E3779B97F4A7C15)), starts


def word_hashes(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of words of each text.

    Words are runs of bytes other than the six ASCII blanks; `fold` lower-cases A-Z. A text
    above the batch size is hashed in segments that end at a blank.
    """
    hashes, counts = [], []
    for batch in byte_batches(texts):
        if len(batch) == 1 and len(batch[0]) > 2 * BATCH_BYTES:
            parts = [_hashed(x, fold)[0] for x in segments(batch[0])]
            hashes.extend(parts)
            counts.append(np.array([sum(map(len, parts))]))
            continue
        joined = b"\n".join(batch)
        found, starts = _hashed(joined, fold)
        bounds = np.cumsum([0] + [len(x) + 1 for x in batch])
        hashes.append(found)
        counts.append(np.diff(np.searchsorted(starts, bounds)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64),
            np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64))


def segments(text: bytes, size: int = BATCH_BYTES) -> Iterator[bytes]:
    """Pieces of at least `size` bytes that end before a blank or at the end."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[start:end]
        start = end


def grams(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of `width` neighbours (empty if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    factors = odd_numbers(width, seed)
    total = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += hashes[k:k + n] * factors[k]
    return mixed(total)


def encoded(texts: Iterable) -> list[bytes]:
    """UTF-8 of every text, empty for null; unpaired surrogates pass."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts]


def running(df: DataFrame, key: list[str], order: list[Column], spread: Column, weight: Column, out: str,
            rows_per_bucket: int = 2000) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows of the same key that come earlier.

    The order is by bucket of `spread`, then by `order`; a key with many rows is split into
    about one bucket per `rows_per_bucket` rows, so no task holds a whole key. `df` should be
    a written table: it is read twice.
    """
    buckets = 1 + df.count() // rows_per_bucket
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    sums = rows.groupBy(*key, "_bucket").agg(F.sum(weight).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(W.partitionBy(*key).orderBy("_bucket")) - F.col("_sum"))
    inside = rows.withColumn(
        out, F.sum(weight).over(W.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - weight)
    left, right = inside.alias("l"), before.drop("_sum").alias("r")
    same = F.col("l._bucket") == F.col("r._bucket")
    for k in key:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{out}") + F.col("r._before")).alias(out))


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what a matrix of links connects: every vertex with the smallest one it reaches."""
    ids, at = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    r, c = np.nonzero(linked)
    at = at.astype(np.int32)  # a full block has millions of links
    u, v = at[:len(rows)][r], at[len(rows):][c]
    del r, c
    label = np.arange(len(ids), dtype=np.int32)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the links (a, b); the component is its smallest vertex.

    Alternating star contraction (Kiveris et al., 2014): every vertex hands its neighbours
    the smallest vertex it knows. The links are written to the shared folder after every round; rounds
    grow with the logarithm of the largest component.
    """
    tree = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        tree = written(small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b")
                       .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state = tree.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    pairs = tree.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct())


__all__ = ["written"]
