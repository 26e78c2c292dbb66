"""Which collection a question names, and lookups by name or id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lutrin.functions.text import name_key, short_name_key
from lutrin.session import written


def detected_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name): the longest name cited; null for none or for several different ones.

    A name is cited when its key occurs as whole words. Names meet questions on one word each, the one that fewest
    questions hold; a name of several words is then looked for in the whole question. Names with a word that no question holds
    are out at once. Null and blank questions and names cite nothing; a query_id that repeats counts as one question.
    """
    keyed = names.select("name", short_name_key(F.col("name")).alias("_key")).distinct().filter(F.col("_key") != "")
    parts = keyed.select("_key", F.explode(F.array_distinct(F.split("_key", " "))).alias("_word")).distinct()
    spoken = questions.select("query_id", F.explode(F.array_distinct(F.split(name_key(F.col("question")), " "))).alias("_word"))
    hits = written(spoken.join(parts.select("_word").distinct(), "_word", "left_semi").distinct())

    held = parts.join(hits.groupBy("_word").agg(F.count("*").alias("_n")), "_word", "left")
    rarest = (held.groupBy("_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word")).alias("_rarest"))
              .filter("_rarest.n > 0").select("_key", F.col("_rarest._word").alias("_word")))
    met = written(hits.join(rarest, "_word").select("query_id", "_key"))
    single = ~F.col("_key").contains(" ")
    longer = met.filter(~single)
    texts = (questions.join(longer.select("query_id").distinct(), "query_id", "left_semi")
             .select("query_id", F.concat(F.lit(" "), name_key(F.col("question")), F.lit(" ")).alias("_text")))
    whole = longer.join(texts, "query_id").filter(F.col("_text").contains(F.concat(F.lit(" "), "_key", F.lit(" "))))
    cited = met.filter(single).unionByName(whole.select("query_id", "_key").distinct()).join(keyed, "_key")

    w = W.partitionBy("query_id").orderBy(F.length("name").desc(), "name")
    best = (cited.withColumn("_best", F.first(F.struct("name", "_key")).over(w))
            .groupBy("query_id")
            .agg(F.first("_best.name").alias("_name"),
                 F.bool_and(F.col("_best._key").contains(F.col("_key"))).alias("_clear")))
    return (questions.select("query_id").join(best, "query_id", "left")
            .select("query_id", F.when(F.col("_clear"), F.col("_name")).alias("name")))


def by_name(wanted: DataFrame, rows: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Rows whose name equals a wanted one in any case, and the wanted names without a row."""
    w = wanted.select(F.col("wanted"), F.lower("wanted").alias("_name"))
    r = rows.withColumn("_name", F.lower(name))
    return w.join(r, "_name").drop("_name"), w.join(r.select("_name"), "_name", "left_anti").drop("_name")


def by_id(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def selected(rows: DataFrame, ids: list | None, key: str) -> DataFrame:
    """All rows, or those of a list of ids."""
    return rows if not ids else rows.filter(F.col(key).isin(ids))


def ambiguous_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """Names held by more than one row, which a lookup by name cannot tell apart."""
    return (rows.groupBy(F.lower(name).alias("name_key")).agg(F.count("*").alias("n")).filter("n > 1"))


def name_search(rows: DataFrame, query: str, name: str = "name") -> DataFrame:
    return rows.filter(F.lower(name).contains(query.lower()))
