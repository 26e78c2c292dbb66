"""Table profile and bounded ad-hoc SQL."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_ROWS, MOST_ROWS = 100, 1000
MOST_SECONDS = 15.0


def profile(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, position, data_type, nullable, row_count) of all tables.

    Only column descriptions pass through the driver; rows are counted in one job.
    """
    columns = spark.createDataFrame(
        [(name, f.name, i + 1, f.dataType.simpleString(), f.nullable)
         for name, df in tables.items() for i, f in enumerate(df.schema.fields)],
        "table_name string, column_name string, position int, data_type string, nullable boolean")
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(name)) for name, df in tables.items()])
    return columns.join(counts, "table_name", "left").orderBy("table_name", "position")


def catalog_profile(spark: SparkSession, database: str | None = None) -> DataFrame:
    """`profile` of every table and view the catalog lists."""
    names = [t.name for t in spark.catalog.listTables(database)]
    return profile(spark, {n: spark.table(f"{database}.{n}" if database else n) for n in names})


def bounded_query(spark: SparkSession, query: str, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Rows of one read-only statement, at most `limit`, with a `truncated` flag.

    The statement becomes a subquery, so anything but a query is refused by the parser.
    One row more than asked for tells whether rows are missing.
    """
    n = DEFAULT_ROWS if limit <= 0 else min(limit, MOST_ROWS)
    body = query.strip().rstrip(";")
    rows = spark.sql(f"SELECT * FROM (\n{body}\n) LIMIT {n + 1}")
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    ranked = numbered.withColumn("_row", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("_row")))
    return (ranked.withColumn("truncated", F.max("_row").over(W.partitionBy(F.lit(1))) > n)
            .filter(F.col("_row") <= n).drop("_row"))


def within(spark: SparkSession, seconds: float, action: Callable):
    """The result of `action()`; after `seconds` its jobs are cancelled and a TimeoutError is raised.

    Only jobs this call starts carry its tag, so other work of the session goes on. Jobs that start
    after the limit are cancelled as well, until the action gives up. A running task ends at its next batch of rows.
    """
    context, tag, done, late = spark.sparkContext, f"lutrin-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        late.set()
        while not done.is_set():
            context.cancelJobsWithTag(tag)
            done.wait(0.2)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        result = action()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"the statement took more than {seconds:g} s and was cancelled") from error
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    if late.is_set():
        raise TimeoutError(f"the statement took more than {seconds:g} s")
    return result


def bounded_result(spark: SparkSession, query: str, limit: int = DEFAULT_ROWS, seconds: float = MOST_SECONDS) -> DataFrame:
    """`bounded_query` run at once, under a time limit; its rows, at most MOST_ROWS, are read once and held."""
    rows = bounded_query(spark, query, limit)
    return spark.createDataFrame(within(spark, seconds, rows.collect), rows.schema)
