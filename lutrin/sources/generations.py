"""Stored tables in versions: readers follow one small pointer file, writers add a segment and then move the pointer.

A table is a folder. `data/seq=N/run=...` are segments of rows, `marks/on=.../seq=N/run=...` the keys that version N removes from earlier segments, and
`versions/v....json` names what belongs to version N. A writer first writes its folders and last the pointer, so a run that
fails, is killed or is repeated leaves the version that was, and a reader sees one version from begin to end. An update writes only
its own rows and keys; `compact` merges segments and marks into one segment; `restore` makes an earlier version the current
one again; `clean` removes, after a grace time, what no kept version names.

Two writers of one version are noticed by the name of the pointer file: the second gets an error and may run again. Files are
handled by Hadoop's file system of the folder, in which a rename within a folder has to be one step.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = 16  # a version of more is compacted when it is written
GRACE_SECONDS = 24 * 3600


class Conflict(RuntimeError):
    """Another writer made the version first."""


@dataclass(frozen=True)
class Version:
    """What belongs to a version: folders of rows, and folders of removed keys by their columns."""

    number: int
    schema: str
    segments: tuple[str, ...] = ()
    marks: tuple[tuple[str, str], ...] = ()  # (columns joined by a comma, folder)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of change in seconds) of what is in a folder, nothing if there is none."""
    fs, path = _file_system(spark, folder)
    if not fs.exists(path):
        return []
    return [(s.getPath().getName(), s.getModificationTime() // 1000) for s in fs.listStatus(path)]


def numbers(spark: SparkSession, root: str) -> list[int]:
    """All versions that can still be read, oldest first."""
    return sorted(int(name[1:-5]) for name, _ in _names(spark, f"{root}/versions") if name.startswith("v") and name.endswith(".json"))


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """A version, the newest one by default; None if nothing was stored yet."""
    known = numbers(spark, root)
    if not known:
        return None
    number = known[-1] if number is None else number
    text = spark.read.text(f"{root}/versions/v{number:010d}.json", wholetext=True).first()["value"]
    found = json.loads(text)
    return Version(number, found["schema"], tuple(found["segments"]), tuple((on, path) for on, path in found["marks"]))


def _point(spark: SparkSession, root: str, to: Version) -> Version:
    """The pointer file of a version, written aside and renamed."""
    fs, folder = _file_system(spark, f"{root}/versions")
    fs.mkdirs(folder)
    aside, final = (spark._jvm.org.apache.hadoop.fs.Path(folder, name) for name in (f".{uuid.uuid4().hex}", f"v{to.number:010d}.json"))
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({"schema": to.schema, "segments": to.segments, "marks": to.marks}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise Conflict(f"version {to.number} of {root} was made by another writer")
    return to


def read(spark: SparkSession, root: str, at: Version | int | None = None) -> DataFrame:
    """The rows of a version, the newest one by default.

    Segments are one scan; marks are joined once for each set of key columns, whatever their number.
    """
    at = at if isinstance(at, Version) else version(spark, root, at)
    if at is None:
        raise FileNotFoundError(f"no version is stored in {root}")
    schema = T.StructType.fromJson(json.loads(at.schema))
    if not at.segments:
        return spark.createDataFrame([], schema)
    numbered = T.StructType([*schema, T.StructField("seq", T.LongType()), T.StructField("run", T.StringType())])
    rows = spark.read.schema(numbered).option("basePath", f"{root}/data").parquet(*[f"{root}/{s}" for s in at.segments])
    by_columns: dict[str, list[str]] = {}
    for on, path in at.marks:
        by_columns.setdefault(on, []).append(f"{root}/{path}")
    for on, paths in by_columns.items():
        keys = on.split(",")
        form = T.StructType([*[schema[k] for k in keys], *numbered[-2:]])
        gone = (spark.read.schema(form).option("basePath", f"{root}/marks/on={on}").parquet(*paths)
                .groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("seq").alias("_gone")))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        rows = rows.join(gone, [*same, F.col("seq") < F.col("_gone")], "left_anti")
    return rows.select(*schema.names)


def newest_rows(spark: SparkSession, root: str, at: Version) -> DataFrame:
    """The rows that the writer of a version added."""
    schema = T.StructType.fromJson(json.loads(at.schema))
    return spark.read.schema(schema).parquet(f"{root}/{at.segments[-1]}")


def commit(spark: SparkSession, root: str, rows: DataFrame | None = None, gone: DataFrame | Sequence[DataFrame] = (),
           keys: Sequence[str] = (), settling: bool = True) -> Version:
    """A new version: without the earlier rows whose key is in a table of `gone` (its columns are the key) or, by `keys`, among the new rows, and
    with `rows`, which are computed once.

    The first rows give the table its schema; later ones may lack columns or have them in another order. Nothing is
    changed for readers until all is written.
    """
    base = version(spark, root)
    if base is None and rows is None:
        raise FileNotFoundError(f"no version is stored in {root}")
    base = base or Version(0, json.dumps(rows.schema.jsonValue()))
    new = replace(base, number=base.number + 1)
    place = f"seq={new.number}/run={uuid.uuid4().hex}"
    gone = [gone] if isinstance(gone, DataFrame) else [*gone]
    if rows is not None:
        schema = T.StructType.fromJson(json.loads(new.schema))
        fitted = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        fitted.write.parquet(f"{root}/data/{place}")
        new = replace(new, segments=(*new.segments, f"data/{place}"))
        if keys:
            gone.append(spark.read.schema(schema).parquet(f"{root}/data/{place}").select(*keys))
    for number, table in enumerate(gone if base.segments else []):
        on = ",".join(table.columns)
        table.distinct().write.parquet(f"{root}/marks/on={on}/{place}-{number}")
        new = replace(new, marks=(*new.marks, (on, f"marks/on={on}/{place}-{number}")))
    new = _point(spark, root, new)
    return settled(spark, root, new) if settling else new


def settled(spark: SparkSession, root: str, at: Version) -> Version:
    """The version, compacted if it has many parts."""
    return compact(spark, root) if len(at.segments) + len(at.marks) > SEGMENTS else at


def replaced(spark: SparkSession, root: str, rows: DataFrame, keys: list[str]) -> Version:
    """A version in which `rows` stand in place of all earlier rows that share their keys; rows of other keys stay."""
    return commit(spark, root, rows, keys=keys)


def compact(spark: SparkSession, root: str) -> Version:
    """The same rows as one segment without marks."""
    base = version(spark, root)
    place = f"data/seq={base.number + 1}/run={uuid.uuid4().hex}"
    read(spark, root, base).write.parquet(f"{root}/{place}")
    return _point(spark, root, Version(base.number + 1, base.schema, (place,)))


def restore(spark: SparkSession, root: str, number: int) -> Version:
    """An earlier version becomes the newest again; no row is written."""
    return _point(spark, root, replace(version(spark, root, number), number=numbers(spark, root)[-1] + 1))


def clean(spark: SparkSession, root: str, grace_seconds: int = GRACE_SECONDS) -> int:
    """Removes pointers that were followed by a newer one for `grace_seconds`, and folders that no kept version names and no
    run has touched for that time; returns how many. Readers and writers that began within the grace time are safe.
    """
    fs, folder = _file_system(spark, f"{root}/versions")
    now, removed = time.time(), 0
    times = {int(n[1:-5]): t for n, t in _names(spark, f"{root}/versions") if n.startswith("v") and n.endswith(".json")}
    known = sorted(times)
    kept = [n for n, after in zip(known, [*known[1:], None], strict=True) if after is None or times[after] + grace_seconds > now]
    named = set()
    for n in kept:
        at = version(spark, root, n)
        named |= {*at.segments, *(path for _, path in at.marks)}
    tops = ["data", *(f"marks/{name}" for name, _ in _names(spark, f"{root}/marks"))]
    for top in tops:
        for seq, _ in _names(spark, f"{root}/{top}"):
            for run, changed in _names(spark, f"{root}/{top}/{seq}"):
                path = f"{top}/{seq}/{run}"
                if path not in named and changed + grace_seconds <= now:
                    removed += bool(fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}"), True))
    for n in set(known) - set(kept):
        removed += bool(fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"v{n:010d}.json"), False))
    return removed
