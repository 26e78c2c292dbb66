"""Top-k and costly columns that hold when one key owns a large share of the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LIST_ROWS = 1 << 20  # rows of running lists that are held before they are cut


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key with their rank.

    The filter sits directly on row_number, so each task keeps k rows per key before the
    shuffle: a hot key costs k rows per task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def computed_once(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Adds a costly value that is filtered on later.

    A plain projection would be computed a second time inside the pushed-down filter; the
    filter stays above the generator of one row.
    """
    return df.withColumn(column, F.explode_outer(F.array(value)))


class RunningLists:
    """The `depth` best rows (passage_id, page_start, score) of each of a task's queries, ties to the smaller passage, from any number of parts.

    `floors` are the scores that the last rows of full lists have: what lies below need not be added.
    """

    def __init__(self, queries: int, depth: int):
        self.floors, self.depth, self.parts, self.held, self.kept = np.full(queries, -np.inf), depth, [], 0, 0

    def add(self, query: np.ndarray, passage_id: pa.Array, page_start: pa.Array, score: np.ndarray) -> None:
        self.parts.append(pa.table({"query": pa.array(query), "passage_id": passage_id, "page_start": page_start, "score": pa.array(score)}))
        self.held += len(query)
        if self.held > 2 * self.kept and (not self.kept or self.held - self.kept > LIST_ROWS):
            self.cut()

    def cut(self) -> pa.Table:
        rows = pa.concat_tables(self.parts).sort_by([("query", "ascending"), ("score", "descending"), ("passage_id", "ascending")]).combine_chunks()
        query = rows["query"].to_numpy()
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.depth - 1
        self.floors[query[last]] = rows["score"].to_numpy()[last]
        rows = rows.filter(pa.array(rank < self.depth))
        self.parts, self.held, self.kept = [rows], len(rows), len(rows)
        return rows
