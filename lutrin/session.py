"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "lutrin",
                  shared: str | None = None) -> SparkSession:
    """A session for tests and benchmarks, with its shared folder; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.lutrin.inputPartitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config(CHECKPOINT_SETTING, shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A session without that setting uses a folder inside its warehouse, which all executors
    share as well; nothing goes to a folder that only one machine sees.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for results that are used several times.

    Later reads get column pruning, and neither a lost executor nor a second use computes
    the rows again.
    """
    path = f"{shared_folder(df.sparkSession)}/lutrin-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_in_task(files: list[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a written table (its `inputFiles`) inside a task, `rows` at a time, for what every task has to see whole."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as file:
            yield from pq.ParquetFile(file).iter_batches(rows, columns=columns)
