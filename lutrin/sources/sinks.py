"""Tables out: passages, postings, logs and results."""

from __future__ import annotations

from lutrin.operators.activity import append_log
from lutrin.operators.maintain import write_snapshot
from lutrin.sources.files import write_results

from pyspark.sql import DataFrame

__all__ = ["append_log", "write_postings", "write_results", "write_snapshot"]


def write_postings(postings: DataFrame, path: str, files: int | None = None) -> None:
    """Postings by collection, ranged by stem, so a lookup reads few files of one folder.

    Ranging by (collection, stem, passage) also cuts a hot collection and a hot stem into
    several files; their number follows the shuffle settings unless it is given.
    """
    order = ["collection_id", "stem", "passage_id"]
    ranged = postings.repartitionByRange(files, *order) if files else postings.repartitionByRange(*order)
    (ranged.sortWithinPartitions("collection_id", "stem")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("collection_id").parquet(path))
