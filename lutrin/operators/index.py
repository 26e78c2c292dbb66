"""Search structures as tables: weighted postings and vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from lutrin.functions import lexicon as L
from lutrin.functions import scores, stems
from lutrin.functions.guarded import guarded
from lutrin.functions.text import let
from lutrin.operators.skew import computed_once
from lutrin.sources import generations

POSTING_COLUMNS = ["collection_id", "stem", "passage_id", "page_start", "field", "tf", "weight", "first_field"]
BATCH_ROWS = 50_000  # postings handed over at a time


def postings(passages: DataFrame) -> DataFrame:
    """One row per (passage, stem, field); `first_field` marks one row per (passage, stem).

    Words are counted in the batch of passages they arrive with, so building the index shuffles nothing; fields are title (A),
    chapter (B), topics (B) and content (C).
    """
    topics = F.array_join(F.coalesce(F.col("mechanics"), F.array().cast("array<string>")), " ")
    page = F.col("page_start") if "page_start" in passages.columns else F.lit(None).cast("int").alias("page_start")
    texts = {"A": F.col("title"), "B": F.concat_ws(" ", "hierarchy_path", topics), "C": F.col("text")}
    split = passages.select("collection_id", "passage_id", page, *[stems.split_words(text).alias(f) for f, text in texts.items()])
    schema = ST.StructType([split.schema["collection_id"], ST.StructField("stem", ST.StringType()), split.schema["passage_id"],
                            split.schema["page_start"], ST.StructField("field", ST.StringType()), ST.StructField("tf", ST.IntegerType()),
                            ST.StructField("weight", ST.DoubleType()), ST.StructField("first_field", ST.BooleanType())])
    target, fields = to_arrow_schema(schema), list(texts)
    weights = np.array([L.FIELD_WEIGHTS[f] for f in fields])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [stems.stemmed(batch.column(f)) for f in fields]
            names = list(dict.fromkeys(s for _, _, own in parts for s in own))
            number = {s: i for i, s in enumerate(names)}
            keys = [(rows * len(names) + np.array([number[s] for s in own], np.int64)[codes]) * len(fields) + i
                    for i, (rows, codes, own) in enumerate(parts)]
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            both, field = np.divmod(key, len(fields))
            row, code = np.divmod(both, max(len(names), 1))
            values = {"stem": pa.array(names, pa.string()).take(pa.array(code)), "field": pa.array(fields).take(pa.array(field)),
                      "tf": tf.astype(np.int32), "weight": weights[field] * tf / (tf + 1), "first_field": np.diff(both, prepend=-1) != 0}
            out = pa.RecordBatch.from_arrays([
                pa.array(values[f.name], f.type) if f.name in values else batch.column(f.name).take(pa.array(row)).cast(f.type) for f in target], schema=target)
            for at in range(0, len(out), BATCH_ROWS):
                yield out.slice(at, BATCH_ROWS)
    return split.mapInArrow(counted, schema)


def refresh_postings(current: DataFrame, passages: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings again for `changed(passage_id)` only; the others are kept as they are."""
    kept = current.join(changed.select("passage_id"), "passage_id", "left_anti")
    renewed = passages.join(changed.select("passage_id"), "passage_id", "left_semi")
    return kept.select(*POSTING_COLUMNS).unionByName(postings(renewed))


def store_postings(passages: DataFrame, root: str) -> generations.Version:
    """The index of all passages as a stored table in versions (`sources.generations`)."""
    return generations.commit(passages.sparkSession, root, postings(passages))


def update_postings(passages: DataFrame, changed: DataFrame, root: str) -> generations.Version:
    """The stored index after passages changed, came or went: one segment with the postings of `changed(passage_id)` only, and a mark
    on their earlier ones. Nothing else is read or written; segments are compacted when they are many.
    """
    ids = changed.select("passage_id").distinct()
    return generations.commit(passages.sparkSession, root, postings(passages.join(ids, "passage_id", "left_semi")), ids)


def backfill(df: DataFrame, column: str, expression: Column) -> DataFrame:
    """Compute a derived column only where it is still null."""
    return df.withColumn(column, F.when(F.col(column).isNull(), expression).otherwise(F.col(column)))


def hashed_vector(text: Column, dimensions: int = 64) -> Column:
    """Default embedding: stem counts by hash bucket, at length one."""
    def number(stem: str) -> int:
        return int(hashlib.md5(stem.encode()).hexdigest()[:8], 16)

    @F.arrow_udf(ST.ArrayType(ST.DoubleType()))
    def vectors(words: pa.Array) -> pa.Array:
        rows, codes, names = stems.stemmed(words)
        bucket = np.array(stems.remembered("numbers", number, names), np.int64) % dimensions
        counts = np.bincount(rows * dimensions + bucket[codes], minlength=len(words) * dimensions).reshape(-1, dimensions).astype(float)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, norms, out=counts, where=norms > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dimensions, pa.int32()), pa.array(unit.ravel()))
    return vectors(stems.split_words(text))


def with_embedding(df: DataFrame, text: Column, embed: Callable[[Column], Column] = hashed_vector,
                   column: str = "embedding", dimensions: int | None = None) -> DataFrame:
    """Adds a vector column from any embedder (Column -> Column), e.g. an Arrow UDF.

    A text the embedder fails on keeps its row with a null vector; so does a vector of
    the wrong length when `dimensions` is given.
    """
    vector = embed(text)
    if dimensions is not None:
        vector = let(vector, lambda v: F.when(F.size(v) == dimensions, v))
    return df.withColumn(column, vector)


def with_guarded_embedding(df: DataFrame, text: Column, embed: Callable, column: str = "embedding", error: str = "embedding_error",
                           dimensions: int | None = None) -> DataFrame:
    """Adds the vectors of a Python embedder (batch of texts to vectors) and, where it raised or gave another length, what went wrong.

    A row that fails keeps its place with a null vector; it does not end the run, and the rows beside it have their vectors.
    """
    rows = computed_once(df, "_embedded", guarded(embed)(text))
    value, failed = F.col("_embedded.value"), F.col("_embedded.error")
    if dimensions is not None:
        fits = F.size(value) == dimensions
        failed = F.coalesce(failed, F.when(~fits, F.concat(F.lit("size "), F.size(value).cast("string"))))
        value = F.when(fits, value)
    return rows.withColumn(column, value).withColumn(error, failed).drop("_embedded")


def mean_pooled(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean of the vectors per key at length one.

    Sums run per (key, dimension) with map-side combine, so a key with a third of all
    rows costs one partial row per task and dimension, and only one vector per key is put together.
    """
    sums = (df.filter(F.col(vector).isNotNull())
            .select(*keys, F.posexplode(vector).alias("dim", "x"))
            .groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("x")))
    return (sums.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
            .select(*keys, scores.unit(F.col("v.x")).alias(vector)))


def split_by_dimension(df: DataFrame, dimensions: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows that can be searched, and rows whose vector has another length."""
    fits = F.size(vector) == dimensions
    return df.filter(fits), df.filter(F.col(vector).isNotNull() & ~fits)
