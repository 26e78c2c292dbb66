"""Changing stored collections: upsert, delete, replace or merge, staged re-index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lutrin.functions.text import not_blank, slug
from lutrin.sources import generations


# --- snapshots -------------------------------------------------------------------------

def in_order(rows: DataFrame, order: list[str] | None) -> Column:
    """What orders rows of one key: the columns given, else all that can be compared."""
    names = order or [f.name for f in rows.schema.fields if not f.dataType.simpleString().startswith("map")]
    return F.struct(*names)


def last_values(changes: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per key: of several changes the last one that gives a field wins, as if they were saved in turn."""
    at = in_order(changes, order)
    fields = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields]).select(*changes.columns)


def upsert(current: DataFrame, changes: DataFrame, key: str, fixed: list[str] | None = None,
           touched: str | None = None, now: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """New snapshot: a field given in `changes` wins, null ones keep the stored value.

    `fixed` columns (creation time) keep the stored value even when a new one is given;
    `touched` is set to `now` on changed and new rows. Several changes of one key are saved in
    `order` (all columns if none is given).
    """
    fixed = fixed or []
    marked = last_values(changes, key, order).withColumn("_new", F.lit(True))
    new = marked.select(*[F.col(c).alias(f"_n_{c}") for c in changes.columns], "_new")
    joined = current.join(new, F.col(key) == F.col(f"_n_{key}"), "full")
    out = []
    for c in current.columns:
        if f"_n_{c}" not in new.columns:
            value = F.col(c)
        elif c in fixed:
            value = F.coalesce(F.col(c), F.col(f"_n_{c}"))
        else:
            value = F.coalesce(F.col(f"_n_{c}"), F.col(c))
        if c == touched and now is not None:
            value = F.when(F.col("_new"), now).otherwise(F.col(c))
        out.append(value.alias(c))
    return joined.select(*out)


def named_changes(changes: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Changes with an id from the name's slug, and those rejected for a blank name."""
    ok = not_blank(F.coalesce(F.col(name), F.lit("")))
    return changes.filter(ok).withColumn("id", slug(F.trim(name))), changes.filter(~ok)


def overlay(old: Column, new: Column) -> Column:
    """Map overlay, new keys win."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame,
                   parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the listed parents."""
    return (without(parents, gone, parent_key),
            children.join(gone.select(F.col(parent_key).alias(child_key)), child_key, "left_anti"))


def set_fields(rows: DataFrame, key: str, values: DataFrame, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Field-only update of the rows listed in `values`; of several rows of one key the last in `order` counts."""
    last = values.groupBy(key).agg(F.max_by(F.struct(*columns), in_order(values, order)).alias("_v"))
    new = last.select(F.col(key), *[F.col(f"_v.{c}").alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = rows.join(new, key, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in rows.columns])


def collection_counts(collections: DataFrame, passages: DataFrame, key: str = "collection_id") -> DataFrame:
    """Every collection with its number of passages, zero included.

    Counting first makes the join one row per collection, so a hot collection is settled
    by map-side counts.
    """
    counts = passages.groupBy(key).agg(F.count("*").alias("n_passages"))
    return (collections.join(counts, key, "left")
            .withColumn("n_passages", F.coalesce("n_passages", F.lit(0).cast("long"))))


# --- file lists ------------------------------------------------------------------------

def source_files(files: Column, legacy: Column) -> Column:
    """The stored list, else the legacy text cut at plus signs; null when there is none."""
    split = F.filter(F.transform(F.split(legacy, r"\+"), lambda f: F.trim(f)), lambda f: f != "")
    found = F.when(F.size(F.coalesce(files, F.array().cast("array<string>"))) > 0, files).otherwise(split)
    return F.when(F.size(found) > 0, found)


def merged_files(previous: Column, new: Column) -> Column:
    return F.array_distinct(F.concat(previous, new))


def import_plan(rows: DataFrame) -> DataFrame:
    """Rows (mode, previous, new) with the file list after the import and what it changes.

    merge keeps earlier files, replace (the default) drops those that are not in the new list;
    `added` is what a rollback has to drop.
    """
    merge = F.col("mode") == "merge"
    return (rows.withColumn("files", F.when(merge, merged_files(F.col("previous"), F.col("new"))).otherwise(
                F.array_distinct("new")))
            .withColumn("replaced", F.when(merge, F.array().cast("array<string>")).otherwise(
                F.array_except("previous", "new")))
            .withColumn("added", F.array_except("new", "previous")))


# --- staged re-index -------------------------------------------------------------------

def stored_form(rows: DataFrame) -> DataFrame:
    """Empty arrays instead of nulls, float vectors."""
    if "mechanics" in rows.columns:
        rows = rows.withColumn("mechanics", F.coalesce("mechanics", F.array().cast("array<string>")))
    if "embedding" in rows.columns:
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>"))
    return rows


def write_snapshot(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Passages as Parquet by collection; overwriting touches only the collections in `rows`.

    Rows are gathered by collection before writing, so that not every task writes a file
    into every folder; the rebalance lets AQE cut a hot collection into several tasks.
    """
    (stored_form(rows).hint("rebalance", F.col("collection_id"))
     .write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("collection_id").parquet(path))


def read_snapshot(like: DataFrame, path: str) -> DataFrame:
    """Stored rows in the columns and types of `like` (folder names are not guessed to be numbers)."""
    form = stored_form(like)
    return form.sparkSession.read.schema(form.schema).parquet(path).select(*form.columns)


def reindex(new_rows: DataFrame, root: str, replace: bool = True) -> DataFrame:
    """Swap in new passages per collection, as one version of the table stored in versions below `root` (`sources.generations`).

    With `replace` the new rows stand in place of their collections', else in place of the passages of equal id. Collections without any new row keep
    theirs; the returned rows (collection_id, n_new) say which were swapped. New rows are written once; a run that fails or is killed leaves the version
    that was, and a reader sees one version.
    """
    spark = new_rows.sparkSession
    keys = ["collection_id"] if replace else ["passage_id"]
    at = generations.commit(spark, root, stored_form(new_rows), keys=keys, settling=False)
    generations.settled(spark, root, at)
    return generations.newest_rows(spark, root, at).groupBy("collection_id").agg(F.count("*").alias("n_new"))


def add_documents(new_rows: DataFrame, root: str, replaced: DataFrame | None = None) -> None:
    """Merge the passages of arriving documents: they stand in place of what is stored of the same documents.

    Only the new rows and the ids of their documents are written, whatever the size of the collections. A batch that is run again
    leaves the same rows. Collections in `replaced` (collection_id) lose all earlier rows in the same version.
    """
    generations.commit(new_rows.sparkSession, root, stored_form(new_rows), [] if replaced is None else [replaced.select("collection_id")],
                       keys=["collection_id", "doc_id"])


def rolled_back(before: DataFrame, after: DataFrame, passages: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections and passages after a failed import: a new collection goes with its passages, an old one gets its row back.

    before and after are the collections (collection_id, files, ...) around the import, failed names those to take back;
    passages (collection_id, source_file, ...) lose the files that the import added.
    """
    kept = after.join(failed.select("collection_id"), "collection_id", "left_anti")
    restored = before.join(failed.select("collection_id").distinct(), "collection_id", "left_semi")
    old = before.select("collection_id", F.explode("files").alias("source_file")).distinct()
    touched = passages.join(failed.select("collection_id").distinct(), "collection_id", "left_semi")
    rest = passages.join(failed.select("collection_id").distinct(), "collection_id", "left_anti")
    return (kept.unionByName(restored.select(*after.columns)),
            rest.unionByName(touched.join(old, ["collection_id", "source_file"], "left_semi").select(*passages.columns)))


def outcome(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Per document: passages made and status; a document without any is an error row, not a stop."""
    made = passages.groupBy("collection_id", "doc_id").agg(F.count("*").alias("n_passages"))
    n = F.coalesce(F.col("n_passages"), F.lit(0).cast("long"))
    chars = F.aggregate("pages", F.lit(0), lambda acc, p: acc + F.length(p["text"]))
    return (documents.select("collection_id", "doc_id", chars.alias("n_chars"))
            .join(made, ["collection_id", "doc_id"], "left")
            .withColumn("n_passages", n)
            .withColumn("status", F.when(F.col("n_chars") == 0, "no text")
                        .when(n == 0, "no passage").otherwise("indexed")))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per collection: a run only fails when nothing was indexed."""
    return (outcomes.groupBy("collection_id")
            .agg(F.count("*").alias("files"), F.count_if(F.col("status") == "indexed").alias("indexed"),
                 F.count_if(F.col("status") != "indexed").alias("failed"), F.sum("n_passages").alias("n_passages"))
            .withColumn("success", F.col("n_passages") > 0))
