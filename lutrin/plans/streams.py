"""Streaming jobs run over the tables at hand; each equals a batch query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.plans import activity, sql as S
from lutrin.plans.corpus import PLAIN_PAGES
from lutrin.plans.registry import SQL, query
from lutrin.session import shared_folder
from lutrin.sources import generations
from lutrin.sources import tables as D
from lutrin.streaming import jobs as J


def _folders(spark):
    base = f"{shared_folder(spark)}/lutrin-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint", f"{base}/staging"


def _event_stream(spark, folder, files_per_batch=64):
    return J.table_stream(spark, folder, "events", files_per_batch).select(
        F.col("event_id").alias("log_id"), F.col("ts").cast("timestamp").alias("created_at"), "user_id", "event_type", "value", "props")


@query("stream_rate_limited", SQL["rate_limited"])
def stream_rate_limited(spark, folder):
    """The rows of `rate_limited` from files that arrive from the youngest to the oldest, some per batch, and are answered in order of time.

    The delay is that of a backfill, the whole span of the log. The last tick releases what waits behind the watermark.
    """
    out, checkpoint, arriving = _folders(spark)
    log = D.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(600000000.0)).alias("at"))
    ends = log.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    log = log.withColumn("tick", F.lit(False))
    log.repartitionByRange(16, F.col("at").desc()).sortWithinPartitions(F.col("at").desc()).write.parquet(arriving)
    J.tick(spark, arriving)  # the youngest file, so it comes last
    requests = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 8).parquet(arriving)
    limited = J.ordered_rate_limit_stream(requests, per_minute=2, delay=(ends["last"] or 0.0) - (ends["first"] or 0.0) + 1)
    J.run_available(limited.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)
    return spark.read.parquet(out).filter("NOT late").select("key", "request_id", "allowed", F.round("wait", 6).alias("wait"))


@query("stream_jobs", f"""
    WITH {activity.JOB_EVENTS}
    SELECT job_id, count(*) AS event_count, coalesce(arg_max(current, (tm, tie)) FILTER (total IS NOT NULL), -1) AS current,
           coalesce(arg_max(message, (tm, tie)) FILTER (message IS NOT NULL), '') AS message,
           coalesce(arg_max(event_type, (tm, tie)) FILTER (event_type IN ('completed', 'failed')), 'running') AS status,
           least(count(*), 100) AS last_events
    FROM jobs GROUP BY job_id""")
def stream_jobs(spark, folder):
    out, checkpoint, _ = _folders(spark)
    kind = F.col("event_type")
    events = _event_stream(spark, folder).select(
        F.col("user_id").alias("job_id"), F.col("log_id").alias("event_id"), F.col("created_at").alias("at"),
        F.when(kind == "view", "progress").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("note").alias("event_type"),
        F.when(kind == "view", F.floor("value")).alias("current"), F.when(kind == "click", F.col("props")).alias("message"))
    J.run_available(J.append_batches(J.job_stream(events), out), checkpoint)
    return J.newest_per_job(spark, out)


@query("stream_import", f"""
    WITH RECURSIVE {S.PAGES}, {PLAIN_PAGES}, {S.chunks('p')}
    SELECT sha256(collection_id || '/' || doc_id || '/' || chunk_index) AS passage_id, collection_id, doc_id,
           chunk_index, md5(text) AS text_md5 FROM chunks""")
def stream_import(spark, folder):
    """Documents arriving as files are chunked; every batch is a version of the stored table."""
    out, checkpoint, staging = _folders(spark)
    documents = J.table_stream(spark, folder, "documents").select(
        F.col("source").alias("collection_id"), "doc_id", T.pages_of_lines(F.col("text")).alias("pages"))
    J.run_available(J.import_stream(documents, out, staging), checkpoint)
    return generations.read(spark, out).select(
        "passage_id", "collection_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"))


@query("stream_event_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_log(spark, folder):
    """Events appended by day, each id once although the stream brings every row twice."""
    out, checkpoint, _ = _folders(spark)
    events = _event_stream(spark, folder)
    J.run_available(J.log_stream(events.unionByName(_event_stream(spark, folder)), out), checkpoint)
    return (spark.read.parquet(out).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type")
            .agg(F.count("*").alias("n")))


@query("stream_live_answers", SQL["live_answers"])
def stream_live_answers(spark, folder):
    """The rows of `live_answers` from two streams, of questions and of answers, that meet in keyed state."""
    out, checkpoint, arriving = _folders(spark)
    again, made = activity.repeated_questions(spark, folder)
    again = again.withColumn("question_id", F.concat_ws("/", "conv_id", "exchange_no"))
    again.write.parquet(f"{arriving}/questions")
    made.write.parquet(f"{arriving}/answers")
    questions, answers = (spark.readStream.schema(df.schema).parquet(f"{arriving}/{name}") for df, name in ((again, "questions"), (made, "answers")))
    served = J.answer_cache_stream(questions, answers)
    J.run_available(served.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)
    place = F.split("question_id", "/")
    return spark.read.parquet(out).select(
        place[0].cast("long").alias("conv_id"), place[1].cast("long").alias("exchange_no"), F.coalesce("answer", F.lit("")).alias("answer"),
        F.col("answer").isNotNull().alias("cached"))


@query("stream_cached_answers", SQL["answer_cache_hits"])
def stream_cached_answers(spark, folder):
    """The repeated questions of `answer_cache_hits`, arriving as a stream over the stored answers."""
    out, checkpoint, arriving = _folders(spark)
    asked = activity._asked(spark, folder)
    stored = asked.filter("history_turns = 0").select(
        "cache_key", "answer", (F.col("asked_at") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    newest = stored.groupBy("cache_key").agg(F.max_by("answer", "expires_at").alias("answer"), F.max("expires_at").alias("expires_at"))
    again = asked.select("conv_id", "exchange_no", "history_turns", "cache_key", F.timestamp_micros(
        F.unix_micros("asked_at") + F.col("conv_id") % 48 * F.lit(3600000000)).alias("asked_at"))
    again.write.parquet(arriving)
    questions = spark.readStream.schema(again.schema).parquet(arriving)
    joined = J.cached_answer_stream(questions, newest)
    J.run_available(joined.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)
    return spark.read.parquet(out).select(
        "conv_id", F.col("exchange_no").cast("long").alias("exchange_no"), F.coalesce("answer", F.lit("")).alias("answer"), "cached")
