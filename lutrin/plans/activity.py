"""Queries over logs, jobs, requests and cached answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lutrin.operators import activity as V
from lutrin.plans.registry import query
from lutrin.plans.retrieval import EXCHANGES
from lutrin.sources import tables as D


def _logs(spark, folder):
    return D.table(spark, folder, "events").select(
        F.col("event_id").alias("log_id"), F.col("ts").cast("timestamp").alias("created_at"), "user_id", "event_type", "value", "props")


@query("recent_events", """
    SELECT event_id AS log_id, event_type, epoch_us(ts) AS at_us FROM events WHERE event_type = 'error'
    ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_events(spark, folder):
    """The hundred newest rows of one type (an unusable limit falls back to a hundred)."""
    rows = V.recent(V.of_type(_logs(spark, folder), "error"), limit=0)
    return rows.select("log_id", "event_type", F.unix_micros("created_at").alias("at_us"))


@query("events_by_day", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
    FROM events GROUP BY ALL""")
def events_by_day(spark, folder):
    days = V.by_day(_logs(spark, folder))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n",
                       F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query("event_json_fields", """
    SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type || ':' || json_extract_string(props, '$.k') AS label FROM events""")
def event_json_fields(spark, folder):
    parsed = _logs(spark, folder).withColumn("p", F.from_json("props", "struct<k:bigint>"))
    return parsed.select(F.col("log_id").alias("event_id"), "p.k", F.concat_ws(":", "event_type", F.col("p.k").cast("string")).alias("label"))


# Events as job events: views report progress, clicks carry a message, purchases and errors end a job.
JOB_EVENTS = """jobs AS (
    SELECT user_id AS job_id, event_id AS tie, ts AS tm,
           CASE event_type WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'note' END AS event_type,
           CASE WHEN event_type = 'view' THEN floor(value)::BIGINT END AS current, CASE WHEN event_type = 'view' THEN 500::BIGINT END AS total,
           CASE WHEN event_type = 'click' THEN props END AS message FROM events)"""


def _job_events(spark, folder):
    kind, logs = F.col("event_type"), _logs(spark, folder)
    return logs.select(
        F.col("user_id").alias("job_id"), F.col("log_id").alias("tie"), F.col("created_at").alias("at"),
        F.when(kind == "view", "progress").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("note").alias("event_type"),
        F.when(kind == "view", F.floor("value")).alias("current"), F.when(kind == "view", F.lit(500).cast("long")).alias("total"),
        F.when(kind == "click", F.col("props")).alias("message"))


@query("job_rollup", f"""
    WITH {JOB_EVENTS}
    SELECT job_id, count(*) AS event_count, epoch_us(min(tm)) AS started_us,
           coalesce(arg_max(current, (tm, tie)) FILTER (total IS NOT NULL), -1) AS current,
           coalesce(arg_max(message, (tm, tie)) FILTER (message IS NOT NULL), '') AS message,
           coalesce(arg_max(event_type, (tm, tie)) FILTER (event_type IN ('completed', 'failed')), 'running') AS status,
           coalesce(epoch_us(max(tm) FILTER (event_type IN ('completed', 'failed'))), 0) AS completed_us
    FROM jobs GROUP BY job_id""")
def job_rollup(spark, folder):
    jobs = V.job_rollup(_job_events(spark, folder))
    return jobs.select("job_id", "event_count", F.unix_micros("started_at").alias("started_us"),
                       F.coalesce("current", F.lit(-1).cast("long")).alias("current"), F.coalesce("message", F.lit("")).alias("message"),
                       "status", F.coalesce(F.unix_micros("completed_at"), F.lit(0).cast("long")).alias("completed_us"))


@query("job_last_events", f"""
    WITH {JOB_EVENTS}, aged AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tm DESC, tie DESC) AS age FROM jobs)
    SELECT job_id, tie AS event_id, event_type, age FROM aged WHERE age <= 100""")
def job_last_events(spark, folder):
    return V.last_events(_job_events(spark, folder)).select(
        "job_id", F.col("tie").alias("event_id"), "event_type", F.col("age").cast("long").alias("age"))


@query("job_retention", f"""
    WITH {JOB_EVENTS}, ended AS (
        SELECT job_id, max(tm) FILTER (event_type IN ('completed', 'failed')) AS completed_at FROM jobs GROUP BY job_id)
    SELECT job_id FROM ended WHERE completed_at IS NULL OR completed_at >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS""")
def job_retention(spark, folder):
    """Finished jobs are listed for a day, counted from the newest event."""
    events = _job_events(spark, folder)
    newest = events.agg(F.max("at")).scalar()
    return V.still_listed(V.job_rollup(events), newest).select("job_id")


@query("run_summary", f"""
    WITH {JOB_EVENTS}
    SELECT job_id, count(*) FILTER (event_type = 'completed') AS successes, count(*) FILTER (event_type IN ('completed', 'failed')) AS total,
           (epoch_us(max(tm)) - epoch_us(min(tm))) // 1000 AS duration_ms FROM jobs GROUP BY job_id""")
def run_summary(spark, folder):
    return V.run_totals(_job_events(spark, folder))


# The request clock runs 600 times as fast as the event clock.
@query("rate_limited", """
    WITH RECURSIVE requests AS (
        SELECT user_id AS key, event_id AS request_id, epoch_us(ts) / 600000000.0::DOUBLE AS tm,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    buckets AS (
        SELECT key, request_id, i, tm, 1.0::DOUBLE AS tokens, true AS allowed, 0.0::DOUBLE AS wait FROM requests WHERE i = 1
        UNION ALL
        SELECT key, request_id, i, tm, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1, CASE WHEN t >= 1 THEN 0 ELSE (1 - t) / (2 / 60.0::DOUBLE) END
        FROM (SELECT r.key, r.request_id, r.i, r.tm, least(2.0::DOUBLE, b.tokens + (r.tm - b.tm) * (2 / 60.0::DOUBLE)) AS t
              FROM buckets b JOIN requests r ON r.key = b.key AND r.i = b.i + 1))
    SELECT key::VARCHAR AS key, request_id, allowed, round(wait, 6) AS wait FROM buckets""")
def rate_limited(spark, folder):
    requests = _logs(spark, folder).select(
        F.col("user_id").alias("key"), F.col("log_id").alias("request_id"),
        (F.unix_micros("created_at") / F.lit(600000000.0)).alias("at"))
    return V.rate_limited(requests, per_minute=2).select("key", "request_id", "allowed", F.round("wait", 6).alias("wait"))


ASKED = f"""{EXCHANGES}, opening AS (SELECT min(ts) AS start FROM events),
asked AS (
    SELECT conv_id, exchange_no, question, coalesce(answer, '') AS answer, exchange_no - 1 AS history_turns,
           (SELECT start FROM opening) + INTERVAL (conv_id) HOUR AS asked_at FROM exchanges),
keyed AS (
    SELECT *, 'ask:' || sha256('c' || (conv_id % 3) || ':' || (epoch_us((SELECT start FROM opening)) + (conv_id % 3) * 1000000) || '000:' || lower(trim(question))) AS cache_key
    FROM asked)"""


def _asked(spark, folder):
    start = _logs(spark, folder).agg(F.min("created_at")).scalar()
    rows = D.exchanges_history(spark, folder).withColumn("start", start)
    collection = F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string"))
    updated = F.timestamp_micros(F.unix_micros("start") + F.col("conv_id") % 3 * 1000000)
    return rows.select(
        "conv_id", "exchange_no", "question", F.coalesce("answer", F.lit("")).alias("answer"), (F.col("exchange_no") - 1).alias("history_turns"),
        F.timestamp_micros(F.unix_micros("start") + F.col("conv_id") * F.lit(3600000000)).alias("asked_at"),
        V.cache_key(collection, updated, F.col("question")).alias("cache_key"))


@query("answer_cache_hits", f"""
    WITH {ASKED}, stored AS (SELECT cache_key, answer, asked_at + INTERVAL 24 HOURS AS expires_at FROM keyed WHERE history_turns = 0),
    again AS (
        SELECT conv_id, exchange_no, history_turns, cache_key, asked_at + INTERVAL (conv_id % 48) HOUR AS asked_at FROM keyed)
    SELECT a.conv_id, a.exchange_no, coalesce(arg_max(s.answer, s.expires_at), '') AS answer, count(s.answer) > 0 AS cached
    FROM again a LEFT JOIN stored s ON a.history_turns = 0 AND s.cache_key = a.cache_key AND s.expires_at > a.asked_at
    GROUP BY ALL""")
def answer_cache_hits(spark, folder):
    """Every question asked again up to two days later: first questions are served while the answer is valid."""
    asked = _asked(spark, folder)
    stored = asked.filter("history_turns = 0").select(
        "cache_key", "answer", (F.col("asked_at") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    again = asked.select("conv_id", F.col("exchange_no").cast("long").alias("exchange_no"), "history_turns", "cache_key",
                         F.timestamp_micros(F.unix_micros("asked_at") + F.col("conv_id") % 48 * F.lit(3600000000)).alias("asked_at"))
    return V.cached_answers(again, stored).select(
        "conv_id", "exchange_no", F.coalesce("answer", F.lit("")).alias("answer"), "cached")


@query("live_answers", f"""
    WITH {ASKED}, made AS (SELECT cache_key, answer, asked_at AS made_at FROM keyed WHERE history_turns = 0),
    again AS (SELECT conv_id, exchange_no, cache_key, asked_at + INTERVAL (conv_id % 48) HOUR AS asked_at FROM keyed WHERE history_turns = 0)
    SELECT a.conv_id, a.exchange_no, coalesce(arg_max(m.answer, (m.made_at, m.answer)), '') AS answer, count(m.answer) > 0 AS cached
    FROM again a LEFT JOIN made m ON m.cache_key = a.cache_key AND m.made_at <= a.asked_at AND a.asked_at < m.made_at + INTERVAL 24 HOUR
    GROUP BY a.conv_id, a.exchange_no, a.cache_key, a.asked_at""")
def live_answers(spark, folder):
    """First questions asked again, up to two days later, each served by the newest answer made before it."""
    asked, made = repeated_questions(spark, folder)
    found = V.live_answers(asked, made)
    return found.select("conv_id", F.col("exchange_no").cast("long").alias("exchange_no"), F.coalesce("answer", F.lit("")).alias("answer"), "cached")


def repeated_questions(spark, folder):
    """First questions of all conversations, asked again, and the answers that were made when they were asked first."""
    first = _asked(spark, folder).filter("history_turns = 0")
    again = first.select("conv_id", "exchange_no", "history_turns", "cache_key", F.timestamp_micros(
        F.unix_micros("asked_at") + F.col("conv_id") % 48 * F.lit(3600000000)).alias("asked_at"))
    return again, first.select("cache_key", "answer", F.col("asked_at").alias("made_at"))


@query("files_by_collection", """
    SELECT source AS collection_id, count(*) AS n_files, sum(n_chars)::BIGINT AS total_size, max(doc_id) AS last_doc FROM documents GROUP BY source""")
def files_by_collection(spark, folder):
    """Stored documents as the files of their sources; the time of change is their number in seconds."""
    files = D.table(spark, folder, "documents").select(
        F.col("source").alias("collection_id"), F.col("n_chars").alias("size"), F.timestamp_seconds("doc_id").alias("modified"))
    return V.files_by_collection(files).select("collection_id", "n_files", F.col("total_size").cast("long").alias("total_size"),
                                               F.unix_seconds("modified").alias("last_doc"))


@query("question_log", f"""
    WITH {EXCHANGES}, tokens AS (SELECT user_id, sum(json_extract_string(props, '$.k')::BIGINT) AS total FROM events GROUP BY user_id)
    SELECT x.conv_id, x.exchange_no, 'ask_question' AS event_type, 'Question sur le jeu ''c' || (x.conv_id % 3) || '''' AS message,
           x.question, CASE WHEN x.exchange_no > 1 THEN x.exchange_no - 1 ELSE 0 END AS history_turns, coalesce(t.total, 0)::BIGINT AS tokens_total
    FROM exchanges x LEFT JOIN tokens t ON t.user_id = x.conv_id""")
def question_log(spark, folder):
    """Log rows with their JSON metadata, read back from the JSON."""
    tokens = (_logs(spark, folder).groupBy(F.col("user_id").alias("conv_id"))
              .agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total")))
    rows = D.exchanges_history(spark, folder).join(tokens, "conv_id", "left").select(
        "conv_id", "exchange_no", F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")).alias("collection"), "question",
        F.lit("m").alias("model"), (F.col("exchange_no") - 1).alias("history_turns"), F.lit(0).cast("timestamp").alias("created_at"),
        F.struct(F.lit(None).cast("long").alias("prompt"), F.lit(None).cast("long").alias("completion"), F.col("total").alias("total")).alias("tokens"))
    logged = V.question_log(rows, keep=["conv_id", "exchange_no"])
    read = logged.withColumn("m", F.from_json("metadata", "struct<question:string,history_turns:bigint,tokens_total:bigint>"))
    return read.select("conv_id", F.col("exchange_no").cast("long").alias("exchange_no"), "event_type", "message", "m.question",
                       F.coalesce("m.history_turns", F.lit(0).cast("long")).alias("history_turns"),
                       F.coalesce("m.tokens_total", F.lit(0).cast("long")).alias("tokens_total"))


@query("stream_reassembly", """
    SELECT conv_id AS stream_id, string_agg(CASE WHEN role = 'system' THEN '' ELSE text END, '' ORDER BY turn) AS answer,
           'm' || max(turn) FILTER (role = 'assistant') AS model, CASE WHEN max(turn) % 2 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
           max(turn) AS tokens_total
    FROM conversations GROUP BY conv_id""")
def stream_reassembly(spark, folder):
    """Conversations cut to delta lines and put together again; lines after the end mark do not count."""
    turns = D.table(spark, folder, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    text = F.when(F.col("role") == "system", "").otherwise(F.col("text"))
    choice = F.struct(F.struct(text.alias("content")).alias("delta"),
                      F.when(F.col("turn") == F.col("last"), F.when(F.col("last") % 2 == 0, "length").otherwise("stop")).alias("finish_reason"))
    chunk = F.to_json(F.struct(
        F.when(F.col("role") == "assistant", F.concat(F.lit("m"), F.col("turn").cast("string"))).otherwise("").alias("model"),
        F.array(choice).alias("choices"), F.struct(F.col("turn").alias("total_tokens")).alias("usage")))
    lines = turns.join(last, "conv_id").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("pos"),
                                               F.concat(F.lit("data: "), chunk).alias("line"))
    ends = last.select(F.col("conv_id").alias("stream_id"), (F.col("last") + 1).alias("pos"), F.lit("data: [DONE]").alias("line"))
    late = last.select(F.col("conv_id").alias("stream_id"), (F.col("last") + 2).alias("pos"),
                       F.lit('data: {"choices":[{"delta":{"content":"late"}}]}').alias("line"))
    noise = last.select(F.col("conv_id").alias("stream_id"), F.lit(-1).cast("long").alias("pos"), F.lit(": keep-alive").alias("line"))
    joined = V.reassembled(lines.unionByName(ends).unionByName(late).unionByName(noise))
    return joined.select("stream_id", "answer", "model", "finish_reason", F.col("usage.total_tokens").cast("long").alias("tokens_total"))
