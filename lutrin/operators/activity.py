"""Logs, jobs, requests and cached answers as batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lutrin.functions.answers import content_text
from lutrin.functions.text import not_blank, strip
from lutrin.operators.skew import top_per


# --- logs ------------------------------------------------------------------------------

def recent(logs: DataFrame, limit: int = 100, at: str = "created_at", tie: str = "log_id") -> DataFrame:
    """Newest rows; a limit outside 1 to 500 becomes 100."""
    return logs.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(limit if 1 <= limit <= 500 else 100)


def of_type(logs: DataFrame, event_type: str) -> DataFrame:
    return logs.filter(F.col("event_type") == event_type)


def by_day(logs: DataFrame, at: str = "created_at") -> DataFrame:
    return (logs.groupBy(F.to_date(at).alias("day"), "event_type")
            .agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at")))


def files_by_collection(files: DataFrame) -> DataFrame:
    """Number, size and newest change of the files of each collection."""
    return files.groupBy("collection_id").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.max("modified").alias("modified"))


# --- jobs ------------------------------------------------------------------------------

def job_rollup(events: DataFrame) -> DataFrame:
    """events(job_id, event_type, at, current, total, message) to one row per job.

    Last progress and message come from max_by, which combines on the map side; no event
    list is collected. `tie` orders events of the same time.
    """
    order = F.struct("at", "tie")
    moving = F.col("event_type").isin("progress", "embedding_progress") & F.col("total").isNotNull()
    ending = F.col("event_type").isin("completed", "failed")
    return events.groupBy("job_id").agg(
        F.count("*").alias("event_count"), F.min("at").alias("started_at"),
        F.max_by("current", F.when(moving, order)).alias("current"),
        F.max_by("total", F.when(moving, order)).alias("total"),
        F.max_by("message", F.when(F.col("message").isNotNull(), order)).alias("message"),
        F.coalesce(F.max_by("event_type", F.when(ending, order)), F.lit("running")).alias("status"),
        F.max(F.when(ending, F.col("at"))).alias("completed_at"))


def last_events(events: DataFrame, keep: int = 100, key: str = "job_id") -> DataFrame:
    """The newest `keep` events per key, 1 being the newest."""
    return top_per(events, [key], [F.col("at").desc(), F.col("tie").desc()], keep, "age")


def run_totals(events: DataFrame) -> DataFrame:
    """Successes, attempts and duration per run."""
    ended = F.col("event_type").isin("completed", "failed")
    span = F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))
    return events.groupBy("job_id").agg(
        F.count_if(F.col("event_type") == "completed").alias("successes"), F.count_if(ended).alias("total"),
        F.floor(span / 1000).alias("duration_ms"))


def still_listed(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Finished jobs are dropped after a day."""
    return jobs.filter(F.col("completed_at").isNull()
                       | (F.col("completed_at") >= now - F.expr(f"INTERVAL {hours} HOURS")))


# --- request rate ----------------------------------------------------------------------

REQUEST_COLUMNS = "key string, request_id bigint, at double, allowed boolean, wait double"


def rate_limited(requests: DataFrame, per_minute: int, span: float = 3600.0) -> DataFrame:
    """Token bucket per key over requests(key, request_id, at in seconds); null is a key of its own.

    A bucket that had time to fill up is the same as a new one, so a key's requests fall
    apart into independent bursts. Bursts are found inside (key, span of time) windows
    and joined over the span borders by one summary row per span; a hot key is thereby
    spread over its spans and bursts. A burst is then folded as a sorted stream, batch by
    batch, with only the bucket in memory.
    """
    if per_minute <= 0:
        return requests.select(F.col("key").cast("string").alias("key"), "request_id", "at", F.lit(True).alias("allowed"), F.lit(0.0).alias("wait"))
    capacity, rate = float(per_minute), per_minute / 60
    order = [F.col("at"), F.col("request_id")]
    spans = requests.select("key", "request_id", "at", F.floor(F.col("at") / span).alias("span"))
    inside = W.partitionBy("key", "span").orderBy(*order)
    gaps = spans.withColumn("before", F.lag("at").over(inside))
    starts = gaps.withColumn("start", F.when(
        F.col("before").isNotNull() & ((F.col("at") - F.col("before")) * rate >= capacity), F.col("at")))
    # per span: first and last request and the last burst start seen inside
    summary = starts.groupBy("key", "span").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("start").alias("last_start"))
    across = W.partitionBy("key").orderBy("span")
    opened = summary.withColumn("end_before", F.lag("last_at").over(across)).withColumn(
        "opens", F.when(F.col("end_before").isNull()
                        | ((F.col("first_at") - F.col("end_before")) * rate >= capacity), F.col("first_at")))
    carried = opened.withColumn("carry", F.coalesce("opens", F.last(
        F.coalesce("last_start", "opens"), True).over(across.rowsBetween(W.unboundedPreceding, -1))))
    bursts = (starts.withColumn("burst", F.last("start", True).over(
                  inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
              .join(carried.select(F.col("key").alias("_key"), F.col("span").alias("_span"), "carry"),
                    F.col("key").eqNullSafe(F.col("_key")) & (F.col("span") == F.col("_span")))
              .select("key", "request_id", "at", F.coalesce("burst", "carry").alias("burst")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, capacity, 0.0
        for batch in batches:
            allowed, wait = [], []
            for key, burst, at in zip(batch["key"], batch["burst"], batch["at"], strict=True):
                if (key, burst) != current:
                    current, tokens, last = (key, burst), capacity, at
                tokens = min(capacity, tokens + (at - last) * rate)
                last = at
                if tokens >= 1:
                    tokens -= 1
                    allowed.append(True)
                    wait.append(0.0)
                else:
                    allowed.append(False)
                    wait.append((1 - tokens) / rate)
            yield batch[["key", "request_id", "at"]].assign(allowed=allowed, wait=wait)

    return (bursts.withColumn("key", F.col("key").cast("string"))
            .repartition("key", "burst")
            .sortWithinPartitions("key", "burst", "at", "request_id")
            .mapInPandas(fold, REQUEST_COLUMNS))


# --- answers ---------------------------------------------------------------------------

def cache_key(collection: Column, updated_at: Column, question: Column) -> Column:
    """A new update time of the collection makes a new key, so old answers are not served."""
    nanos = F.concat(F.unix_micros(updated_at).cast("string"), F.lit("000"))
    return F.concat(F.lit("ask:"), F.sha2(F.concat_ws(":", collection, nanos, F.lower(strip(question))), 256))


def cached_answers(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds the stored answer and `cached`; only first questions look it up.

    queries(cache_key, asked_at, history_turns, ...), answers(cache_key, answer, expires_at).
    Of several stored answers that are still valid the newest counts.
    """
    first = queries.filter(F.col("history_turns") == 0)
    others = queries.filter(F.coalesce(F.col("history_turns") != 0, F.lit(True)))
    newest = answers.groupBy("cache_key").agg(
        F.max_by("answer", "expires_at").alias("_answer"), F.max("expires_at").alias("_until"))
    # one row per key is left, so the join neither repeats questions nor gathers null keys
    found = first.join(newest, "cache_key", "left").select(
        *queries.columns, F.when(F.col("_until") > F.col("asked_at"), F.col("_answer")).alias("answer"))
    return (found.unionByName(others.withColumn("answer", F.lit(None).cast("string")))
            .withColumn("cached", F.col("answer").isNotNull()))


def live_answers(questions: DataFrame, answers: DataFrame, valid_hours: int = 24) -> DataFrame:
    """Questions with the newest answer of their key that was made before they were asked and is still valid.

    questions(cache_key, asked_at, history_turns, ...), answers(cache_key, answer, made_at); of answers made at one time the largest text counts.
    Only first questions look one up. Answers and questions of a key meet in one sorted window, so neither is multiplied.
    """
    first = F.col("history_turns") == 0
    asked = questions.filter(first & F.col("cache_key").isNotNull()).select(
        "cache_key", F.col("asked_at").alias("_at"), F.lit(1).alias("_asked"), F.lit(None).cast("string").alias("_text"),
        F.lit(None).cast("timestamp").alias("_made"), F.struct(*questions.columns).alias("_q"))
    made = answers.filter("cache_key is not null and answer is not null").select(
        "cache_key", F.col("made_at").alias("_at"), F.lit(0).alias("_asked"), F.col("answer").alias("_text"), F.col("made_at").alias("_made"),
        F.lit(None).cast(asked.schema["_q"].dataType).alias("_q"))
    earlier = W.partitionBy("cache_key").orderBy("_at", "_asked", "_text").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("_asked") == 0, F.struct("_text", "_made")), True).over(earlier)
    valid = F.col("_last._made") + F.expr(f"INTERVAL {valid_hours} HOURS") > F.col("_at")
    found = (asked.unionByName(made).withColumn("_last", last).filter("_asked = 1")
             .select("_q.*", F.when(valid, F.col("_last._text")).alias("answer")))
    others = questions.filter(~F.coalesce(first & F.col("cache_key").isNotNull(), F.lit(False)))
    return (found.unionByName(others.withColumn("answer", F.lit(None).cast("string")))
            .withColumn("cached", F.col("answer").isNotNull()))


def question_log(answered: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Log rows (event_type, message, metadata, created_at) of answered questions."""
    metadata = F.to_json(F.struct(
        F.col("collection"), F.col("question"), F.col("model"),
        F.when(F.col("history_turns") > 0, F.col("history_turns")).alias("history_turns"),
        F.col("tokens.prompt").alias("tokens_input"), F.col("tokens.completion").alias("tokens_output"),
        F.col("tokens.total").alias("tokens_total")))
    return answered.select(
        *(keep or []), F.lit("ask_question").alias("event_type"),
        F.concat(F.lit("Question sur le jeu '"), F.col("collection"), F.lit("'")).alias("message"),
        metadata.alias("metadata"), "created_at")


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def reassembled(lines: DataFrame) -> DataFrame:
    """Delta streams (stream_id, pos, line) to (stream_id, answer, model, finish_reason, tokens, ok).

    Lines after `[DONE]` do not count; a stream whose answer is blank is marked not ok.
    """
    schema = ("struct<id:string,model:string,usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>,"
              "choices:array<struct<delta:struct<content:string>,finish_reason:string>>>")
    data = lines.filter(strip(F.col("line")).startswith("data:")).select(
        "stream_id", "pos", strip(F.regexp_replace(strip(F.col("line")), "^data:", "")).alias("data"))
    ends = data.groupBy("stream_id").agg(F.min(F.when(F.col("data") == "[DONE]", F.col("pos"))).alias("_end"))
    parsed = (data.join(ends, "stream_id")
              .filter(F.col("_end").isNull() | (F.col("pos") < F.col("_end")))
              .withColumn("c", F.from_json("data", schema)))
    text = F.array_join(F.transform("c.choices", lambda x: F.coalesce(
        content_text(x["delta"]["content"]), x["delta"]["content"], F.lit(""))), "")
    last = F.filter(F.transform("c.choices", lambda x: x["finish_reason"]), lambda r: r != "")
    return (parsed.select("stream_id", "pos", "c", text.alias("t"), F.try_element_at(last, F.lit(-1)).alias("reason"))
            .groupBy("stream_id").agg(
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda p: p["t"]), "").alias("answer"),
                F.max_by("c.model", F.when(F.col("c.model") != "", F.col("pos"))).alias("model"),
                F.max_by("c.id", F.when(F.col("c.id") != "", F.col("pos"))).alias("response_id"),
                F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("finish_reason"),
                F.max_by("c.usage", F.when(F.col("c.usage").isNotNull(), F.col("pos"))).alias("usage"))
            .withColumn("ok", not_blank(F.col("answer"))))
