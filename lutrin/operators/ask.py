"""Questions to answers, for all questions at once, with a model given as a DataFrame function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions.answers import without_filler
from lutrin.operators import activity as V
from lutrin.operators import context as C
from lutrin.operators import names as N
from lutrin.operators import retrieve as R
from lutrin.operators.cells import VectorCells
from lutrin.operators.textblocks import TextBlocks
from lutrin.session import written

Embed = Callable[[Column], Column]
Model = Callable[[DataFrame], DataFrame]  # rows with `prompt` -> the same rows with `answer`, `model`, `tokens`
HISTORY = "array<struct<question:string,answer:string>>"


@dataclass
class Asked:
    """Results of one batch: answers, rejected questions, new cache rows and log rows."""

    answers: DataFrame
    rejected: DataFrame
    to_cache: DataFrame
    log: DataFrame


def extractive(rows: DataFrame) -> DataFrame:
    """Without a model the answer is the context."""
    return (rows.withColumn("answer", F.col("context")).withColumn("model", F.lit(""))
            .withColumn("tokens", F.lit(None).cast("struct<prompt:bigint,completion:bigint,total:bigint>")))


def ask(queries: DataFrame, collections: DataFrame, passages: DataFrame, postings: DataFrame | TextBlocks, embed: Embed,
        now: Column, model: Model = extractive, cache: DataFrame | None = None,
        limit: int = L.ASK_LIMIT, min_score: float = L.MIN_COSINE, valid_hours: int = 24, stored: VectorCells | None = None) -> Asked:
    """Answer queries(query_id, collection, question, history), searching the `stored` cells of the passages' vectors if they are given.

    collections(collection_id, name, updated_at) are found by name in any case;
    cache(cache_key, answer, expires_at) serves first questions. A question without any
    section gets a row with a null answer and is neither cached nor logged.
    """
    valid, blank = C.valid_queries(queries)
    valid = (valid.withColumn("query_id", F.col("query_id").cast("string"))
             .withColumn("history", C.trimmed_history(F.coalesce("history", F.from_json(F.lit("[]"), HISTORY)))))
    named = valid.select(F.trim("collection").alias("wanted"), "query_id", "question", "history")
    known = collections.withColumn("_name", F.lower("name"))
    found = named.withColumn("_name", F.lower("wanted")).join(known, "_name", "left").drop("_name")
    unknown = found.filter(F.col("collection_id").isNull())
    asked = (found.filter(F.col("collection_id").isNotNull())
             .withColumn("history_turns", F.size("history")).withColumn("asked_at", now)
             .withColumn("cache_key", V.cache_key(F.col("collection_id"), F.col("updated_at"), F.col("question"))))
    columns = ["query_id", "collection_id", "name", "question", "history", "history_turns", "asked_at", "cache_key"]
    asked = asked.select(*columns)
    served = written(V.cached_answers(asked, cache) if cache is not None else
                     asked.withColumn("answer", F.lit(None).cast("string")).withColumn("cached", F.lit(False)))
    misses = served.filter(~F.col("cached")).select(*columns)

    retrieved = C.retrieved_context(R.search_with_history(misses, passages, postings, embed, limit, min_score, stored))
    ready = (misses.join(retrieved.select("query_id", "kept", "context"), "query_id")
             .withColumn("prompt", C.prompt(F.col("question"), F.coalesce("context", F.lit("")), F.col("history"))))
    ready = written(ready)
    # written once: answers, cache and log show the same answer, and the model is asked once per question
    answered = written(model(ready.filter(F.col("context").isNotNull())).withColumn("answer", without_filler(F.col("answer"))))
    nothing = ready.filter(F.col("context").isNull())

    shown = answered.select("query_id", "collection_id", "answer", "model", F.lit(False).alias("cached"), "prompt",
                            C.response_sections(F.col("kept")).alias("sections"))
    empty = F.slice(C.response_sections(F.col("kept")), 1, 0)
    answers = (shown
               .unionByName(nothing.select("query_id", "collection_id", F.lit(None).cast("string").alias("answer"),
                                           F.lit("").alias("model"), F.lit(False).alias("cached"), "prompt", empty.alias("sections")))
               .unionByName(served.filter("cached").select("query_id", "collection_id", "answer", F.lit("").alias("model"), "cached"),
                            allowMissingColumns=True))
    to_cache = answered.filter("history_turns = 0").select(
        "cache_key", "answer", (F.col("asked_at") + F.expr(f"INTERVAL {valid_hours} HOURS")).alias("expires_at"))
    log = V.question_log(answered.withColumnRenamed("name", "collection").withColumnRenamed("asked_at", "created_at"))
    rejected = (blank.select(F.col("query_id").cast("string").alias("query_id"), F.lit("blank").alias("reason"))
                .unionByName(unknown.select("query_id", F.lit("unknown collection").alias("reason"))))
    return Asked(answers, rejected, to_cache, log)
