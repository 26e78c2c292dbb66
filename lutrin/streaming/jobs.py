"""Live flows as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lutrin.operators import maintain as M
from lutrin.operators import passages as P
from lutrin.session import written

DAY_MS = 24 * 3600 * 1000


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = 64) -> DataFrame:
    """New Parquet files of one table, a single file or a folder of part files.

    The schema is read from the files that are there. None takes all of them in one batch, for a backfill whose order in time counts.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be a file or a folder
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes a restart go on where it ended.

    Keyed state with lists and timers needs the RocksDB state store.
    """
    SparkSession.active().conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _time_mode(sweep: bool) -> str:
    return "ProcessingTime" if sweep else "None"


# --- request rate ----------------------------------------------------------------------

class TokenBucket(StatefulProcessor):
    """Bucket per key; a key is forgotten once its bucket would be full again.

    The rows of a batch are taken in the order of their time, whatever the order in which they arrive; a row that comes in a
    later batch than younger ones finds the bucket as these left it. No row is dropped for being late.
    """

    def __init__(self, per_minute: int, sweep: bool):
        self.capacity = float(per_minute)
        self.rate = per_minute / 60
        self.sweep = sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, last, timer = self.bucket.get() if self.bucket.exists() else (self.capacity, None, None)
        batch = pd.concat([r[["request_id", "at"]] for r in rows]).sort_values(["at", "request_id"])
        allowed, wait = [], []
        for at in batch["at"]:
            tokens = min(self.capacity, tokens + (max(0.0, at - last) if last is not None else 0.0) * self.rate)
            last = at if last is None else max(at, last)
            granted = tokens >= 1
            wait.append(0.0 if granted else (1 - tokens) / self.rate)
            tokens -= 1 if granted else 0
            allowed.append(granted)
        yield pd.DataFrame({"key": str(key[0]), "request_id": batch["request_id"], "at": batch["at"], "allowed": allowed, "wait": wait})
        if self.sweep:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = int(timerValues.getCurrentProcessingTimeInMs() + self.capacity / self.rate * 1000)
            self.handle.registerTimer(timer)
        self.bucket.update((tokens, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, per_minute: int, sweep: bool = False) -> DataFrame:
    """requests(key, request_id, at in seconds) to the same rows with `allowed` and `wait`; a limit of 0 is off.

    `sweep` is for flows that never end: keys whose bucket would be full again are forgotten. A run over what is there would
    wait for these timers.
    """
    if per_minute <= 0:
        return requests.select(F.col("key").cast("string").alias("key"), "request_id", "at", F.lit(True).alias("allowed"), F.lit(0.0).alias("wait"))
    return requests.groupBy("key").transformWithStateInPandas(
        TokenBucket(per_minute, sweep), "key string, request_id bigint, at double, allowed boolean, wait double",
        "Append", _time_mode(sweep))


class OrderedTokenBucket(StatefulProcessor):
    """Bucket per key that takes requests in the order of their time, whatever the order in which they arrive.

    A key mostly brings few requests, so rows come and go one by one: a data frame a key and span cost more than its requests.
    Requests wait in state, packed by span of time, until the watermark passes the end of their span. A timer releases the span, so
    that one span of one key is in memory at a time. Requests of a span that the watermark has passed are `late`: they get no
    answer and leave the bucket as it is. Once the bucket of a key without waiting requests would be full, a timer forgets the key.
    """

    def __init__(self, per_minute: int, span: float):
        self.capacity = float(per_minute)
        self.rate = per_minute / 60
        self.span_ms = max(1, int(span * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double, parts long, timer long")
        self.waiting = handle.getMapState("waiting", "span long, part long", "at array<double>, request_id array<bigint>")

    def _held(self) -> tuple[float, float | None, int, int | None]:
        return self.bucket.get() or (self.capacity, None, 0, None)

    def _hold(self, tokens: float, last: float | None, parts: int, timer: int | None, need: int) -> None:
        """Stores the bucket; one timer at or before the next time of need is enough."""
        if timer is None or need < timer:
            self.handle.registerTimer(need)
            timer = need
        self.bucket.update((tokens, last, parts, timer))

    @staticmethod
    def _row(key, at, request_id, allowed, wait, late: bool) -> Row:
        return Row(key=key[0], request_id=request_id, at=at, allowed=allowed, wait=wait, late=late)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        tokens, last, parts, timer = self._held()
        first = None
        while True:
            some = list(islice(rows, PART_ROWS))
            if not some:
                break
            spans: dict[int, tuple[list, list]] = {}
            for r in some:
                if r["tick"]:
                    continue
                at = r["at"]
                known = at is not None and abs(at) <= LAST_SECOND
                span = int(at * 1000 // self.span_ms) if known else 0
                if known and (span + 1) * self.span_ms > passed:
                    ats, ids = spans.setdefault(span, ([], []))
                    ats.append(at)
                    ids.append(r["request_id"])
                else:
                    yield self._row(key, at, r["request_id"], None, None, True)
            for span in sorted(spans):
                self.waiting.updateValue((span, parts), spans[span])
                first = span if first is None else min(first, span)
                parts += 1
        if first is not None:
            self._hold(tokens, last, parts, timer, (first + 1) * self.span_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        tokens, last, parts, timer = self._held()
        if timer is None or timer > expiredTimerInfo.getExpiryTimeInMs():
            return  # a later timer has taken over, or the key is forgotten
        waiting = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        due = sorted({span for span, _ in waiting if (span + 1) * self.span_ms <= passed})
        for span in due:
            own = [k for k in waiting if k[0] == span]
            held = [self.waiting.getValue(k) for k in own]
            asked = sorted(((at, -1 if i is None else i, i) for ats, ids in held for at, i in zip(ats, ids, strict=True)), key=lambda r: r[:2])
            for at, _, request_id in asked:
                tokens = min(self.capacity, tokens + (max(0.0, at - last) if last is not None else 0.0) * self.rate)
                last = at if last is None else max(at, last)
                granted = tokens >= 1
                yield self._row(key, at, request_id, granted, 0.0 if granted else (1 - tokens) / self.rate, False)
                tokens -= 1 if granted else 0
            for k in own if len(due) < len({s for s, _ in waiting}) else ():
                self.waiting.removeKey(k)
        left = [span for span, _ in waiting if span not in due]
        if waiting and not left:
            self.waiting.clear()
        need = (min(left) + 1) * self.span_ms if left else int((last + self.capacity / self.rate) * 1000) + 1
        if left or need > passed:
            self._hold(tokens, last, parts, None, need)
        else:
            self.bucket.clear()

    def close(self) -> None:
        pass


PART_ROWS = 10_000  # requests of a key that are taken at a time
#: No request is younger than the end of the year 9999; a tick of this time ends a stream.
LAST_SECOND = 253402300799.0
REQUEST_SCHEMA = "key string, request_id long, at double, tick boolean"


def ordered_rate_limit_stream(requests: DataFrame, per_minute: int, delay: float, span: float = 3600.0) -> DataFrame:
    """requests(key, request_id, at in seconds, tick) to the same rows with `allowed`, `wait` and `late`, decided in the order of time.

    Requests may arrive up to `delay` seconds behind the youngest one before them, in any order of files and batches: the rows
    that are not late are those of `rate_limited` over them. Late rows, and rows whose time is null or no time, have null
    in `allowed` and `wait`, for a table of their own. Answers are given when the watermark has passed their span of
    `span` seconds; rows with `tick` are no requests, they only move the watermark on. A limit of 0 is off and nothing waits.
    """
    asked = requests.select(F.col("key").cast("string").alias("key"), F.col("request_id").cast("long").alias("request_id"),
                            F.col("at").cast("double").alias("at"), F.coalesce("tick", F.lit(False)).alias("tick"))
    if per_minute <= 0:
        return rate_limit_stream(asked.filter("NOT tick"), 0).withColumn("late", F.lit(False))
    moment = F.when(F.abs("at") <= LAST_SECOND, F.timestamp_millis(F.floor(F.col("at") * 1000).cast("long")))
    # the column with the watermark is left out, so that late rows reach the bucket instead of being dropped before it
    timed = asked.withColumn("_moment", moment).withWatermark("_moment", f"{int(delay * 1000)} milliseconds")
    return timed.select("key", "request_id", "at", "tick").groupBy("key").transformWithState(
        OrderedTokenBucket(per_minute, span), "key string, request_id bigint, at double, allowed boolean, wait double, late boolean",
        "Append", "EventTime")


def tick(spark: SparkSession, folder: str, at: float = LAST_SECOND) -> None:
    """Tells a folder of requests that time has come to `at`; the last second releases all that waits and ends the flow."""
    spark.createDataFrame([(None, None, float(at), True)], REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


# --- jobs ------------------------------------------------------------------------------

class JobState(StatefulProcessor):
    """Progress of one job: counters, last message, status and the newest events.

    Every value is kept with the time and id of its event, so an older event never replaces a younger one,
    in whatever order files, batches and rows arrive.
    """

    MARK = (-(2**62), -(2**62))

    def __init__(self, keep: int, sweep: bool):
        self.keep = keep
        self.sweep = sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState(
            "job", "event_count long, current long, current_at long, current_id long, message string, message_at long, message_id long, "
                   "status string, status_at long, status_id long, timer long")
        self.newest = handle.getListState("newest", "event_id long, event_type string, at_ms long")

    @staticmethod
    def _last(rows: pd.DataFrame, mark: tuple, value, column: str) -> tuple:
        """The value of the last row, if it is younger than the one kept."""
        if len(rows):
            top = rows.sort_values(["at_ms", "event_id"]).iloc[-1]
            if (top["at_ms"], top["event_id"]) > mark:
                return (int(top["at_ms"]), int(top["event_id"])), top[column]
        return mark, value

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, current, ca, ci, message, ma, mi, status, sa, si, timer = (
            self.job.get() if self.job.exists() else (0, -1, *self.MARK, "", *self.MARK, "running", *self.MARK, 0))
        kept, done = list(self.newest.get()), sa
        for batch in rows:
            count += len(batch)
            own = batch[["event_id", "event_type", "at_ms"]].itertuples(index=False, name=None)
            kept = sorted([*kept, *own], key=lambda e: (e[2], e[0]))[-self.keep:]
            moving = batch[batch["event_type"].isin(["progress", "embedding_progress"]) & batch["current"].notna()]
            (ca, ci), current = self._last(moving, (ca, ci), current, "current")
            (ma, mi), message = self._last(batch[batch["message"].notna()], (ma, mi), message, "message")
            (sa, si), status = self._last(batch[batch["event_type"].isin(["completed", "failed"])], (sa, si), status, "event_type")
        if self.sweep and sa != done:
            if timer:
                self.handle.deleteTimer(timer)
            timer = int(timerValues.getCurrentProcessingTimeInMs() + DAY_MS)
            self.handle.registerTimer(timer)
        self.job.update((count, int(current), ca, ci, message, ma, mi, status, sa, si, timer))
        self.newest.put([(int(e), t, int(a)) for e, t, a in kept])
        yield pd.DataFrame({"job_id": [int(key[0])], "event_count": [count], "current": [int(current)], "message": [message],
                            "status": [status], "last_events": [len(kept)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        self.newest.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, keep: int = 100, sweep: bool = False) -> DataFrame:
    """events(job_id, event_id, event_type, at, current, message) to one changed row per job and batch.

    With `sweep`, for flows that never end, a finished job is forgotten a day after its end was seen.
    """
    timed = events.withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("job_id").transformWithStateInPandas(
        JobState(keep, sweep), "job_id bigint, event_count bigint, current bigint, message string, status string, last_events bigint",
        "Update", _time_mode(sweep))


def append_batches(rows: DataFrame, path: str) -> Callable:
    """Update-mode rows kept per batch; writing a batch again replaces it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return rows.writeStream.outputMode("update").foreachBatch(write)


def newest_per_job(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in ("job_id", "batch_id")]
    return (rows.groupBy("job_id").agg(F.max_by(F.struct(*fields), "batch_id").alias("j")).select("job_id", "j.*"))


# --- import ----------------------------------------------------------------------------

def import_stream(documents: DataFrame, root: str, staging: str, replace: bool = False, embed=None):
    """Arriving documents (collection_id, doc_id, pages) are chunked; every batch becomes a version of the table stored below `root`.

    merge adds to a collection. replace puts the documents of this run in its place: the first batch that brings a
    collection replaces it, later batches add to it. A batch that is run again writes the same ids. `staging` keeps which collections
    a run has replaced.
    """
    begun = f"{staging}/replaced"

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        rows = P.enriched(P.passages(batch))
        if embed is not None:
            rows = rows.withColumn("embedding", embed(P.embed_text(F.col("hierarchy_path"), F.col("text"))))
        first = None
        if replace:
            rows = written(rows)  # used twice
            seen = stored(batch.sparkSession, begun, "collection_id string, batch long").filter(F.col("batch") < batch_id)
            first = written(rows.select("collection_id").distinct().join(seen, "collection_id", "left_anti"))
        M.add_documents(rows, root, first)
        if first is not None:
            first.write.mode("overwrite").parquet(f"{begun}/batch={batch_id}")
    return documents.writeStream.foreachBatch(index_batch)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a Parquet table, none if there is no such table yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --- logs and answers ------------------------------------------------------------------

def log_stream(events: DataFrame, path: str):
    """Audit events appended by day; an event id counts once, and none is too late.

    A batch is compared with the stored ids of its own days only, so a batch that is run again adds nothing.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch.withColumn("day", F.to_date("created_at")).dropDuplicates(["log_id"]))
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # at most one per day of the batch
        there = stored(batch.sparkSession, path, rows.schema).filter(F.col("day").isin(days)).select("log_id", "day")
        rows.join(there, ["log_id", "day"], "left_anti").write.mode("append").partitionBy("day").parquet(path)
    return events.writeStream.foreachBatch(append)


def cached_answer_stream(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """First questions of a stream joined with the stored answers that are valid when asked.

    answers(cache_key, answer, expires_at) holds one row per key.
    """
    valid: Column = F.col("_until") > F.col("asked_at")
    stored = answers.select(F.col("cache_key").alias("_key"), F.col("answer").alias("_answer"), F.col("expires_at").alias("_until"))
    lookup = F.when(F.col("history_turns") == 0, F.col("cache_key"))
    joined = questions.withColumn("_asked", lookup).join(stored, F.col("_asked") == F.col("_key"), "left")
    return (joined.withColumn("answer", F.when(valid, F.col("_answer")))
            .withColumn("cached", F.col("answer").isNotNull()).drop("_asked", "_key", "_answer", "_until"))


class AnswerCache(StatefulProcessor):
    """The newest answer of a key with the time it was made; questions and answers of a batch are taken in the order of their time.

    An answer serves questions asked from its time on, for `valid_ms`. A new update time of the collection is another key, so a
    re-index invalidates all. The state of a key is one row; with `sweep` it is forgotten a day of the clock after its last change (TTL).
    """

    def __init__(self, valid_ms: int, sweep: bool):
        self.valid_ms, self.sweep = valid_ms, sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "answer string, made_ms long"
        self.newest = handle.getValueState("newest", schema, self.valid_ms) if self.sweep else handle.getValueState("newest", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        answer, made = self.newest.get() if self.newest.exists() else (None, None)
        before = made, answer
        # a batch holds as many rows as its trigger allows
        batch = pd.concat([r[["question_id", "at_ms", "answer"]] for r in rows]).sort_values(["at_ms", "question_id", "answer"], na_position="first")
        ids, served = [], []
        for question_id, at, text in batch.itertuples(index=False):
            if pd.isna(question_id):
                if made is None or (at, text) >= (made, answer):
                    answer, made = text, int(at)
            else:
                ids.append(question_id)
                served.append(answer if made is not None and made <= at < made + self.valid_ms else None)
        if (made, answer) != before:
            self.newest.update((answer, made))
        yield pd.DataFrame({"question_id": pd.Series(ids, dtype="object"), "answer": pd.Series(served, dtype="object")})

    def close(self) -> None:
        pass


def answer_cache_stream(questions: DataFrame, answers: DataFrame, valid_hours: int = 24, sweep: bool = False) -> DataFrame:
    """(question_id, answer) of first questions: the answer made for the same key, by this stream or stored before, or null for the model to give one.

    questions(question_id string, cache_key, asked_at, history_turns) and answers(cache_key, answer, made_at) are streams; what was stored earlier
    may be the first files of the answers. Keyed state serves an answer from the batch that brings it on.
    """
    asked = questions.filter("history_turns = 0 and cache_key is not null").select(
        "cache_key", F.col("question_id").cast("string").alias("question_id"), F.unix_millis("asked_at").alias("at_ms"), F.lit(None).cast("string").alias("answer"))
    made = answers.filter("cache_key is not null and answer is not null").select(
        "cache_key", F.lit(None).cast("string").alias("question_id"), F.unix_millis("made_at").alias("at_ms"), "answer")
    return asked.unionByName(made).groupBy("cache_key").transformWithStateInPandas(
        AnswerCache(valid_hours * 3_600_000, sweep), "question_id string, answer string", "Append", _time_mode(sweep))
