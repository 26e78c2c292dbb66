"""Vectors stored by cell, and exact top-k search that reads only the cells that can matter.

A collection is split around pivots (its own rows with the smallest hash), level by level, until a cell holds CELL_ROWS rows at most; every cell
keeps its centre, the largest angle of a row to it and its number of rows. For a query the triangle inequality on the sphere bounds every
score in a cell: cos(max(0, angle to the centre - radius)). The first wave reads the nearest cells that hold `depth` rows
and so gives every query a score its last hit will at least have; the second wave reads only cells whose bound reaches that
score and the threshold. Both waves are joins by cell, queries never pass the driver.

Hot collections are salted: rows are dealt to pivots in groups of SPLIT_ROWS, queries to centres and cells in groups of
QUERY_ROWS, and a cell of very many equal vectors is stored in parts. A visit carries its query's vector, so a batch whose queries and
cells make more than MOST_VISITS pairs names no visits: a task takes BUNDLE_QUERIES queries and reads the stored rows itself, BUNDLE_ROWS at a
time, one matrix product each, with one running list a query. Neither vectors of rows nor lists of bundles are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lutrin.operators.skew import RunningLists, top_per
from lutrin.session import read_in_task, written

SCORE_DIGITS = 9  # sums may run in any order; ties are settled by id
PIVOTS = 64
CELL_ROWS = 512
PIVOT_ROWS = 64  # rows a pivot of the first levels stands for at least
LEVELS = 6
SPLIT_ROWS = 50_000
PART_ROWS = 20_000
QUERY_ROWS = 4096
MOST_VISITS = 1 << 19
BUNDLE_ROWS, BUNDLE_QUERIES = 60_000, 4096
BLOCK_SCORES = 1 << 22  # scores held at a time inside a task
SLACK = 1e-6  # of an angle, for the rounding of arc cosines
PLACE = ["collection_id", "size", "cell"]


@dataclass(frozen=True)
class VectorCells:
    """cells (collection_id, size, cell, centre, radius, n, parts) and members (the same key, part, passage_id, page_start, vector)."""

    cells: DataFrame
    members: DataFrame
    split: bool = True


def packed(rows: DataFrame, column: str, out: str) -> DataFrame:
    """`out`: the vector in double precision as bytes; null if it is null, zero or not finite throughout."""
    schema = T.StructType([f for f in rows.schema if f.name != column] + [T.StructField(out, T.BinaryType())])
    target = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(column)
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")  # nulls become NaN
            ends = np.cumsum(lengths)
            blobs = []
            for n, end in zip(lengths.tolist(), ends.tolist(), strict=True):
                x = flat[end - n:end]
                length = np.sqrt(x @ x) if n else 0.0
                blobs.append(x.tobytes() if np.isfinite(length) and length > 0 else None)
            columns = [pa.array(blobs, pa.binary()) if f.name == out else batch.column(f.name).cast(f.type) for f in target]
            yield pa.RecordBatch.from_arrays(columns, schema=target)
    return rows.mapInArrow(pack, schema)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _apart(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, to be grouped together with what they stem from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def numbered(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))


def salt(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.greatest(n, F.lit(1))).cast("int")


def _nearest_pivot(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    if not len(rows):
        return rows.drop_columns(["_salt"]).append_column("angle", pa.array([], pa.float64()))
    pivots = pivots.sort_by("_pivot")
    centres, units, best, angle = _unit(_matrix(pivots["vector"])), _unit(_matrix(rows["vector"])), [], []
    for at in range(0, len(units), 8192):
        cosines = units[at:at + 8192] @ centres.T
        own = cosines.argmax(axis=1)
        best.append(own)
        angle.append(np.arccos(np.clip(np.take_along_axis(cosines, own[:, None], 1)[:, 0], -1, 1)))
    names = pivots["_pivot"].to_numpy()[np.concatenate(best)]
    cells = pa.array([f"{c}/{p}" for c, p in zip(rows["cell"].to_pylist(), names.tolist(), strict=True)])
    rows = rows.drop_columns(["_salt"])
    rows = rows.set_column(rows.column_names.index("cell"), "cell", cells)
    return rows.append_column("angle", pa.array(np.concatenate(angle)))


def _rows(passages: DataFrame) -> DataFrame:
    page = F.col("page_start") if "page_start" in passages.columns else F.lit(None).cast("int").alias("page_start")
    rows = packed(passages.filter("collection_id is not null").select("collection_id", "passage_id", page, "embedding"), "embedding", "vector")
    return written(rows.filter("vector is not null").withColumn("size", F.octet_length("vector")).withColumn("cell", F.lit("")))


def _stored(placed: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = written(cells.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")))
    members = placed.join(cells.select(*PLACE, "parts"), PLACE).withColumn("part", salt("passage_id", F.col("parts"))).drop("parts")
    return cells, members


def whole(passages: DataFrame) -> VectorCells:
    """One cell a collection and vector length, for vectors that are searched only once: no pivots, all rows are read."""
    rows = _rows(passages)
    return VectorCells(*_stored(rows, rows.groupBy(*PLACE).agg(F.count("*").alias("n"))), split=False)


def build(passages: DataFrame) -> VectorCells:
    """Cells of all passages (collection_id, passage_id, page_start, embedding) whose vector can be scored.

    Rows without a collection or a usable vector have no cell; a page_start column is optional.
    """
    rows = _rows(passages)
    out = T.StructType([*rows.schema, T.StructField("angle", T.DoubleType())])
    done: list[DataFrame] = []
    for level in range(LEVELS):
        nodes = rows.groupBy(*PLACE).agg(F.count("*").alias("_n"))
        if level:
            large = written(nodes.filter(F.col("_n") > CELL_ROWS))
            done.append(rows.join(large, PLACE, "left_anti"))
            if not large.limit(1).count():
                break
            if level == LEVELS - 1:  # what does not split is equal
                done.append(rows.join(large, PLACE, "left_semi"))
                break
            nodes, rows = large, rows.drop("angle")
        nodes = nodes.select(*PLACE, F.least(F.lit(PIVOTS), F.ceil(F.col("_n") / PIVOT_ROWS)).cast("int").alias("_pivots"),
                             F.ceil(F.col("_n") / SPLIT_ROWS).cast("int").alias("_salts"))
        open_rows = rows.join(nodes, PLACE)
        pivots = top_per(open_rows.select(*PLACE, "_pivots", "_salts", "passage_id", "vector"), PLACE, [F.xxhash64("passage_id"), F.col("passage_id")],
                         PIVOTS, "_pivot").filter("_pivot <= _pivots")
        keys = [*PLACE, "_salt"]
        pivots = pivots.select(*PLACE, "_pivot", "vector", numbered(F.col("_salts")).alias("_salt"))
        dealt = open_rows.withColumn("_salt", salt("passage_id", F.col("_salts"))).select(*rows.columns, "_salt")
        rows = written(dealt.groupBy(*keys).cogroup(_apart(pivots).groupBy(*keys)).applyInArrow(_nearest_pivot, out))
    placed = done[0] if done else rows
    for more in done[1:]:
        placed = placed.unionByName(more)
    cells = placed.groupBy(*PLACE).agg(F.min_by("vector", F.struct("angle", "passage_id")).alias("centre"), F.max("angle").alias("radius"),
                                       F.count("*").alias("n"))
    cells, members = _stored(placed.drop("angle"), cells)
    return VectorCells(cells, written(members))


def _chosen(key: str, depth: int, threshold: float | None):
    """Cells a group of queries visits: the nearest ones that hold `depth` rows, or, once a score is known, the others that can reach it."""
    def chosen(queries: pa.Table, cells: pa.Table) -> pa.Table:
        cells = cells.sort_by("cell")
        n, parts = cells["n"].to_numpy(), cells["parts"]
        rows, columns = [], []
        if len(cells) and len(queries):
            centres, radius = _unit(_matrix(cells["centre"])), cells["radius"].to_numpy() + SLACK
            floors = queries["floor"].to_numpy(zero_copy_only=False).astype(float)
            step = max(1, BLOCK_SCORES // len(cells))
            for at in range(0, len(queries), step):
                cosines = np.clip(_unit(_matrix(queries["vector"].slice(at, step))) @ centres.T, -1, 1)
                bounds = np.cos(np.maximum(np.arccos(cosines) - radius, 0))
                order = np.argsort(-cosines, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(cosines.shape, bool)
                np.put_along_axis(first, order, before < depth, axis=1)
                floor = floors[at:at + step, None]
                least = -2.0 if threshold is None else threshold
                wanted = np.where(np.isnan(floor), first, ~first & (bounds + 1e-9 >= np.nan_to_num(floor, nan=-2.0)))
                q, c = np.nonzero(wanted & (bounds + 1e-9 >= least))
                rows.append(q + at)
                columns.append(c)
        q = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        c = pa.array(np.concatenate(columns) if columns else np.zeros(0, np.int64))
        return pa.table({key: queries[key].take(q), "vector": queries["vector"].take(q), "collection_id": queries["collection_id"].take(q),
                         "size": queries["size"].take(q), "cell": cells["cell"].take(c), "parts": parts.take(c)})
    return chosen


def _best(queries: pa.ChunkedArray, members: pa.Table, depth: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, member and score of every query's `depth` best members that reach its floor; members are in the order of their passages."""
    rows, columns, found = [], [], []
    if len(queries) and len(members):
        vectors = _matrix(members["vector"])
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        step = max(1, BLOCK_SCORES // len(members))
        for at in range(0, len(queries), step):
            cosines = np.round((_unit(_matrix(queries.slice(at, step))) @ vectors.T) / norms, SCORE_DIGITS)
            floor = floors[at:at + step, None]
            if len(members) > depth and np.count_nonzero(cosines >= floor) > depth * len(cosines):
                floor = np.maximum(floor, np.partition(cosines, -depth, axis=1)[:, [-depth]])
            q, p = np.nonzero(cosines >= floor)
            if len(q) > depth * len(cosines):  # many equal scores
                order = np.lexsort((p, -cosines[q, p], q))
                q, p = q[order], p[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < depth
                q, p = q[kept], p[kept]
            rows.append(q + at)
            columns.append(p)
            found.append(cosines[q, p])
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((rows, np.int64), (columns, np.int64), (found, float)))


def _scored(key: str, depth: int, threshold: float | None):
    """Of every query the `depth` best rows of a part of a cell, ties to the smaller passage."""
    def scored(queries: pa.Table, members: pa.Table) -> pa.Table:
        members = members.sort_by("passage_id")
        floors = np.full(len(queries), -np.inf if threshold is None else threshold)
        q, p, score = _best(queries["vector"], members, depth, floors)
        q, p = pa.array(q), pa.array(p)
        return pa.table({key: queries[key].take(q), "passage_id": members["passage_id"].take(p), "page_start": members["page_start"].take(p),
                         "score": pa.array(score)})
    return scored


def visits(queries: DataFrame, cells: DataFrame, key: str, depth: int, threshold: float | None) -> DataFrame:
    """(key, vector, collection_id, size, cell, parts) of the cells to read for queries (key, collection_id, size, vector, floor)."""
    of = ["collection_id", "size"]
    many = queries.groupBy(*of).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("_salts"))
    asked = queries.join(many, of).withColumn("_salt", salt(key, F.col("_salts"))).drop("_salts")
    there = cells.join(many, of).withColumn("_salt", numbered(F.col("_salts"))).drop("_salts")
    schema = T.StructType([queries.schema[key], queries.schema["vector"], queries.schema["collection_id"], queries.schema["size"],
                           cells.schema["cell"], cells.schema["parts"]])
    return asked.groupBy(*of, "_salt").cogroup(_apart(there).groupBy(*of, "_salt")).applyInArrow(_chosen(key, depth, threshold), schema)


def read(visited: DataFrame, members: DataFrame, key: str, depth: int, threshold: float | None) -> DataFrame:
    """(key, passage_id, page_start, score): what visited cells give to the lists of their queries."""
    many = visited.groupBy(*PLACE).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("_salts"))
    asked = visited.join(many, PLACE).withColumn("_salt", salt(key, F.col("_salts"))).withColumn("part", numbered(F.col("parts"))).drop("_salts", "parts")
    there = members.join(many, PLACE).withColumn("_salt", numbered(F.col("_salts"))).drop("_salts")
    schema = T.StructType([visited.schema[key], members.schema["passage_id"], members.schema["page_start"], T.StructField("score", T.DoubleType())])
    keys = [*PLACE, "part", "_salt"]
    return asked.groupBy(*keys).cogroup(_apart(there).groupBy(*keys)).applyInArrow(_scored(key, depth, threshold), schema)


def read_whole(asked: DataFrame, members: DataFrame, key: str, depth: int, threshold: float | None) -> DataFrame:
    """(key, passage_id, page_start, score): every query's list from all stored rows of its collection, which the tasks of its group read themselves."""
    of, files = ["collection_id", "size"], sorted(members.inputFiles())
    many = written(asked.groupBy(*of).agg(F.ceil(F.count("*") / BUNDLE_QUERIES).cast("int").alias("_salts")))
    n = 2 * (many.agg(F.sum("_salts")).first()[0] or 1)  # groups are few bytes and long work: they are not coalesced
    dealt = asked.join(many, of).withColumn("_salt", salt(key, F.col("_salts"))).drop("_salts").repartition(n, *of, "_salt")
    schema = T.StructType([asked.schema[key], members.schema["passage_id"], members.schema["page_start"], T.StructField("score", T.DoubleType())])
    columns, least, rows_each = [*of, "passage_id", "page_start", "vector"], -np.inf if threshold is None else threshold, BUNDLE_ROWS

    def scored(queries: pa.Table) -> pa.Table:
        lists, own = RunningLists(len(queries), depth), [queries[c][0] for c in of]
        empty = to_arrow_schema(schema).empty_table()
        for batch in read_in_task(files, columns, rows_each):
            rows = pa.Table.from_batches([batch])
            for c, value in zip(of, own, strict=True):
                rows = rows.filter(pc.equal(rows[c], value))
            rows = rows.sort_by("passage_id")
            q, p, score = _best(queries["vector"], rows, depth, np.maximum(lists.floors, least))
            if len(q):
                lists.add(q, rows["passage_id"].take(pa.array(p)), rows["page_start"].take(pa.array(p)), score)
        if not lists.parts:
            return empty
        found = lists.cut()
        return pa.table({key: queries[key].take(found["query"]), **{c: found[c] for c in ("passage_id", "page_start", "score")}})
    return dealt.groupBy(*of, "_salt").applyInArrow(scored, schema)


def pairs(asked: DataFrame, cells: DataFrame) -> int:
    """How many visits there are if every query visits every cell of its collection."""
    of = ["collection_id", "size"]
    both = asked.groupBy(*of).agg(F.count("*").alias("q")).join(cells.groupBy(*of).agg(F.count("*").alias("c")), of)
    return both.agg(F.sum(F.col("q") * F.col("c"))).first()[0] or 0


def waves(queries: DataFrame, stored: VectorCells, depth: int, threshold: float | None, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of both waves, and the visits of each: (key, passage_id, page_start, score) holds every query's `depth` best, and more."""
    asked = packed(queries.filter(F.col("collection_id").isNotNull()).select(key, "collection_id", F.col("vector").cast("array<double>").alias("given")),
                   "given", "vector")
    asked = written(asked.filter("vector is not null").withColumn("size", F.octet_length("vector")))
    large = stored.split and pairs(asked, stored.cells) > MOST_VISITS
    if large or not stored.split:
        every = asked.join(stored.cells, ["collection_id", "size"]).select(key, "vector", *PLACE, "parts")
        found = read_whole(asked, stored.members, key, depth, threshold) if large else read(every, stored.members, key, depth, threshold)
        return found, every, every.limit(0)
    first = written(visits(asked.withColumn("floor", F.lit(None).cast("double")), stored.cells, key, depth, threshold))
    near = written(read(first, stored.members, key, depth, threshold))
    last = top_per(near, [key], [F.col("score").desc(), F.col("passage_id")], depth).filter(F.col("rank") == depth)
    floors = asked.join(last.select(key, F.col("score").alias("floor")), key, "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    second = written(visits(floors, stored.cells, key, depth, threshold))
    return near.unionByName(read(second, stored.members, key, depth, threshold)), first, second
