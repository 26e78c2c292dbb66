"""The driver's tables in the roles of documents, passages, questions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.operators.index import hashed_vector

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()
LINES_PER_PAGE = 20
INPUT_PARTITIONS = "spark.lutrin.inputPartitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table.

    A session that works on one small file may name in INPUT_PARTITIONS over how many tasks its rows are dealt; unset,
    as on a cluster, the splits of the scan stay as they are.
    """
    rows, tasks = table(spark, folder, "documents"), spark.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(tasks)) if tasks else rows


def documents(spark: SparkSession, folder: str, collection: str = "source") -> DataFrame:
    """Documents with pages of twenty lines, by source or by language."""
    return texts(spark, folder).select(
        F.col(collection).alias("collection_id"), "doc_id",
        T.pages_of_lines(F.col("text"), LINES_PER_PAGE).alias("pages"))


def page_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a passage: the language is the collection, the source the chapter.

    Collections are uneven on purpose: one language holds most of the rows.
    """
    rows = (texts(spark, folder)
            .select("lang", "doc_id", "source", F.explode(T.pages_of_lines(F.col("text"), LINES_PER_PAGE)).alias("p")))
    return rows.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("p.page_no").cast("string")).alias("passage_id"),
        F.col("lang").alias("collection_id"), F.col("doc_id").cast("string").alias("source_file"),
        F.col("source").alias("hierarchy_path"), (F.col("p.page_no") - 1).cast("int").alias("chunk_index"),
        F.coalesce(T.title_candidate(F.col("p.text")), F.lit("")).alias("title"), F.col("p.text").alias("text"),
        F.col("p.page_no").cast("int").alias("page_start"), F.col("p.page_no").cast("int").alias("page_end"),
        F.array().cast("array<string>").alias("mechanics"))


def page_embeddings(passages: DataFrame) -> DataFrame:
    return passages.withColumn("embedding", hashed_vector(F.col("text")))


def language_of(text: Column) -> Column:
    """Language by its special letters."""
    return (F.when(text.rlike("[ßäöüÄÖÜ]"), "de").when(text.rlike("[ñíóÑÍÓ]"), "es")
            .when(text.rlike(r"[^\x00-\x7F]"), "fr").otherwise("en"))


def excerpt_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as questions whose expected excerpt is the text itself."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), language_of(F.col("text")).alias("collection_id"),
        F.col("text").alias("question"), F.array("text").alias("expected"))


def exchanges_history(spark: SparkSession, folder: str) -> DataFrame:
    from lutrin.operators.context import exchanges
    return exchanges(table(spark, folder, "conversations"))
