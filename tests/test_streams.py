"""Streams over folders of part files in any order of time, late rows, and batches that are run again."""

import datetime as dt
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from lutrin.operators import activity as V
from lutrin.operators import ask as A
from lutrin.operators import index
from lutrin.operators import maintain as M
from lutrin.operators import names as N
from lutrin.sources import generations
from lutrin.streaming import jobs as J


def part_files(spark, folder, name, batches, schema):
    """A table as a folder with one part file per batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(spark, writer, tmp_path):
    return J.run_available(writer, str(tmp_path / "check"))


def test_log_keeps_late_rows_and_counts_an_id_once(spark, tmp_path):
    at = [dt.datetime(2024, 1, 2, h) for h in (12, 9, 6, 1)]
    batches = [[(i, t, "ask")] * 2 for i, t in enumerate(at)] + [[(0, at[0], "ask"), (9, dt.datetime(2023, 5, 1), "old")]]
    folder = part_files(spark, tmp_path / "in", "events", batches, "log_id long, created_at timestamp, event_type string")
    out = str(tmp_path / "out")
    run(spark, J.log_stream(J.table_stream(spark, folder, "events", 1), out), tmp_path)
    assert sorted(r["log_id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 9]


def requests(n=400, seed=3):
    rng = random.Random(seed)
    return sorted((rng.choice("ab"), i, round(rng.uniform(0, 600), 2)) for i in range(n))


def test_rate_limit_of_a_backfill_equals_the_batch_job(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = sorted(requests(), key=lambda r: -r[2])
        schema = "key string, request_id long, at double"
        folder = part_files(spark, tmp_path / "in", "requests", [rows[i::5] for i in range(5)], schema)
        out = str(tmp_path / "out")
        limited = J.rate_limit_stream(J.table_stream(spark, folder, "requests", None), 6)
        run(spark, limited.writeStream.format("parquet").outputMode("append").option("path", out), tmp_path)
        got = {r["request_id"]: (r["allowed"], round(r["wait"], 6)) for r in spark.read.parquet(out).collect()}
        want = {r["request_id"]: (r["allowed"], round(r["wait"], 6)) for r in V.rate_limited(spark.createDataFrame(rows, schema), 6).collect()}
        assert got == want and len({a for a, _ in got.values()}) == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def ordered(spark, root, batches, per_minute, delay, span, end=True):
    """Rows of the ordered limiter, one file per batch, in the order of the batches."""
    out, folder = str(root / "out"), str(root / "in")
    for i, rows in enumerate([*batches, None] if end else batches):
        if rows is None:
            J.tick(spark, f"{folder}/requests.parquet")
        else:
            part_files(spark, folder, "requests", [[(*r, False) for r in rows]], J.REQUEST_SCHEMA)
        if i == 0:
            limited = J.ordered_rate_limit_stream(J.table_stream(spark, folder, "requests", 1), per_minute, delay, span)
        J.run_available(limited.writeStream.format("parquet").outputMode("append").option("path", out), str(root / "check"))
    return spark.read.parquet(out).collect()


def decided(rows):
    return {r["request_id"]: (r["allowed"], round(r["wait"], 6)) for r in rows}


def test_requests_in_any_order_of_batches_are_answered_in_order_of_time(spark, tmp_path):
    rows = sorted(requests(300), key=lambda r: -r[2])
    got = ordered(spark, tmp_path, [rows[:100], rows[200:], rows[100:200]], 6, delay=601, span=60.0)
    assert not any(r["late"] for r in got) and len(got) == 300
    want = V.rate_limited(spark.createDataFrame(rows, "key string, request_id long, at double"), 6).collect()
    assert decided(got) == decided(want) and len({r["allowed"] for r in got}) == 2


def test_late_requests_stand_aside_and_leave_the_bucket_alone(spark, tmp_path):
    early = [("a", i, float(i)) for i in range(20)] + [("b", 100, 5.0), ("b", 100, 5.0), (None, 101, 6.0)]
    young = [("a", 200, 500.0), ("c", 201, 500.0)]
    late = [("a", 300, 3.5), ("b", 301, 4.0), ("d", 302, 7.0), ("a", 303, None), ("a", 304, float("nan")), ("a", None, 499.0)]
    got = ordered(spark, tmp_path, [early, young, late], 6, delay=30, span=10.0)
    aside = [r for r in got if r["late"]]
    assert sorted(r["request_id"] for r in aside) == [300, 301, 302, 303, 304]
    assert all(r["allowed"] is None and r["wait"] is None for r in aside)
    on_time = [r for r in [*early, *young, *late[-1:]]]
    want = V.rate_limited(spark.createDataFrame(on_time, "key string, request_id long, at double"), 6).collect()
    key = lambda r: (r["key"] or "", r["request_id"] or -1, r["at"], r["allowed"], round(r["wait"], 6))
    assert sorted(map(key, (r for r in got if not r["late"]))) == sorted(map(key, want))


def test_what_the_watermark_has_not_passed_waits_and_full_buckets_are_forgotten(spark, tmp_path):
    got = ordered(spark, tmp_path, [[("a", 1, 1.0), ("a", 2, 2.0)], [("b", 3, 300.0)], [("b", 4, 301.0)]], 6, delay=30, span=10.0, end=False)
    assert sorted(r["request_id"] for r in got) == [1, 2]
    kept = spark.read.format("statestore").option("stateVarName", "bucket").load(str(tmp_path / "check")).select("key.key").collect()
    assert [r["key"] for r in kept] == ["b"]


def test_ordered_limit_of_no_rows_and_no_limit(spark, tmp_path):
    assert ordered(spark, tmp_path / "none", [[]], 6, delay=30, span=10.0) == []
    got = ordered(spark, tmp_path / "off", [[("a", i, 0.0) for i in range(5)]], 0, delay=30, span=10.0, end=False)
    assert all(r["allowed"] and not r["late"] for r in got) and len(got) == 5


def test_limit_zero_is_off_in_batch_and_stream(spark, tmp_path):
    schema = "key long, request_id long, at double"
    folder = part_files(spark, tmp_path / "in", "requests", [[(1, i, 0.0) for i in range(5)]], schema)
    out = str(tmp_path / "out")
    limited = J.rate_limit_stream(J.table_stream(spark, folder, "requests"), 0)
    run(spark, limited.writeStream.format("parquet").outputMode("append").option("path", out), tmp_path)
    batch = V.rate_limited(spark.createDataFrame([(1, i, 0.0) for i in range(5)], schema), 0)
    assert spark.read.parquet(out).schema.simpleString() == batch.schema.simpleString()
    assert all(r["allowed"] for r in [*spark.read.parquet(out).collect(), *batch.collect()])


def test_job_state_does_not_depend_on_the_order_of_files(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    kinds = ["progress", "note", "progress", "completed", "note", "failed"]
    rows = [(7, i, kinds[i % 6], start + dt.timedelta(seconds=i), i if i % 2 == 0 else None, f"m{i}" if i % 5 == 0 else None) for i in range(60)]
    schema = "job_id long, event_id long, event_type string, at timestamp, current long, message string"
    folder = part_files(spark, tmp_path / "in", "events", [rows[50:], rows[20:50], rows[:10], rows[10:20]], schema)
    out = str(tmp_path / "out")
    run(spark, J.append_batches(J.job_stream(J.table_stream(spark, folder, "events", 1), keep=20), out), tmp_path)
    (job,) = J.newest_per_job(spark, out).collect()
    moving = [r for r in rows if r[2] == "progress" and r[4] is not None]
    assert (job["event_count"], job["current"], job["message"], job["status"], job["last_events"]) == (60, moving[-1][4], "m55", "failed", 20)


def test_replace_mode_keeps_all_documents_of_one_run(spark, tmp_path):
    text = "Les joueurs posent leurs jetons sur le plateau principal avant de piocher deux cartes. " * 4
    schema = "collection_id string, doc_id long, pages array<struct<page_no:int,text:string>>"
    target = str(tmp_path / "target")

    def go(name, docs, replace):
        folder = part_files(spark, tmp_path / name, "docs", [[d] for d in docs], schema)
        stream = J.table_stream(spark, folder, "docs", 1)
        J.run_available(J.import_stream(stream, target, str(tmp_path / f"{name}-stage"), replace), str(tmp_path / f"{name}-check"))
        return sorted({(r["collection_id"], r["doc_id"]) for r in generations.read(spark, target).collect()})

    def doc(collection, number):
        return collection, number, [(1, text)]

    assert go("first", [doc("a", 1), doc("b", 2)], False) == [("a", 1), ("b", 2)]
    assert go("second", [doc("a", 3), doc("a", 4), doc("c", 5)], True) == [("a", 3), ("a", 4), ("b", 2), ("c", 5)]
    assert go("third", [doc("a", 6)], False) == [("a", 3), ("a", 4), ("a", 6), ("b", 2), ("c", 5)]


def test_documents_that_arrive_again_replace_theirs(spark, tmp_path):
    schema = "passage_id string, collection_id string, doc_id long, text string"
    root = str(tmp_path / "t")

    def rows(*items):
        return spark.createDataFrame(items, schema)

    M.add_documents(rows(("1", "A", 1, "old"), ("2", "A", 2, "kept"), ("3", "B", 1, "b")), root)
    for _ in range(2):  # a batch that is run again leaves the same rows
        M.add_documents(rows(("4", "A", 1, "new"), ("5", "A", 1, "newer")), root)
        got = generations.read(spark, root).collect()
        assert sorted((r["collection_id"], r["text"]) for r in got) == [("A", "kept"), ("A", "new"), ("A", "newer"), ("B", "b")]
    M.add_documents(rows(("6", "A", 3, "third")), root, spark.createDataFrame([("B",)], "collection_id string"))
    assert sorted(r["text"] for r in generations.read(spark, root).collect()) == ["kept", "new", "newer", "third"]


def test_several_changes_of_one_key_are_saved_in_turn(spark):
    current = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, n int")
    changes = spark.createDataFrame([(1, "x", None, 2), (1, None, 11, 3), (1, "y", 5, 1), (3, "c", 1, 1), (3, "d", None, 2)],
                                    "id int, name string, n int, turn int")
    out = M.upsert(current, changes, "id", order=["turn"])
    assert sorted(map(tuple, out.collect())) == [(1, "x", 11), (2, "b", 20), (3, "d", 1)]
    values = spark.createDataFrame([(1, 7, 1), (1, None, 2)], "id int, n int, turn int")
    assert sorted(map(tuple, M.set_fields(current, "id", values, ["n"], ["turn"]).collect()), key=str) == [(1, "a", None), (2, "b", 20)]


def test_rollback_of_failed_imports(spark):
    before = spark.createDataFrame([("a", ["f1"]), ("b", ["g1"])], "collection_id string, files array<string>")
    after = spark.createDataFrame([("a", ["f1", "f2"]), ("b", ["g1", "g2"]), ("new", ["h"])], "collection_id string, files array<string>")
    passages = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "g1"), ("b", "g2"), ("new", "h")], "collection_id string, source_file string")
    failed = spark.createDataFrame([("a",), ("new",)], "collection_id string")
    rows, kept = M.rolled_back(before, after, passages, failed)
    assert sorted((r["collection_id"], r["files"]) for r in rows.collect()) == [("a", ["f1"]), ("b", ["g1", "g2"])]
    assert sorted(map(tuple, kept.collect())) == [("a", "f1"), ("b", "g1"), ("b", "g2")]


def test_names_are_found_by_whole_runs_of_words(spark):
    questions = spark.createDataFrame([(1, "Dans Château de Cartes, qui joue ?"), (2, "rien"), (3, "Azul ou Catane ?"), (4, ""), (5, "le catane deluxe !")],
                                      "query_id int, question string")
    names = spark.createDataFrame([("Château de cartes",), ("Azul",), ("Catane",), ("Catane Deluxe",), ("!!",)], "name string")
    got = {r["query_id"]: r["name"] for r in N.detected_names(questions, names).collect()}
    assert got == {1: "Château de cartes", 2: None, 3: None, 4: None, 5: "Catane Deluxe"}


def test_the_model_is_asked_once_per_question(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        calls.add(len(prompts))
        return "Ok, " + prompts.str.len().astype(str)

    def model(rows):
        return (rows.withColumn("answer", answer("prompt")).withColumn("model", F.lit("m"))
                .withColumn("tokens", F.lit(None).cast("struct<prompt:bigint,completion:bigint,total:bigint>")))

    passages = spark.createDataFrame(
        [(f"p{i}", "g", "f", "", i, "Titre", f"la tuile {i} du plateau", 1, 1) for i in range(3)],
        "passage_id string, collection_id string, source_file string, hierarchy_path string, chunk_index int, title string, text string, page_start int, page_end int")
    passages = passages.withColumn("mechanics", F.array().cast("array<string>")).withColumn("embedding", index.hashed_vector(F.col("text")))
    collections = spark.createDataFrame([("g", "Jeu", dt.datetime(2024, 1, 1))], "collection_id string, name string, updated_at timestamp")
    asked = spark.createDataFrame([("1", "jeu", "Où va la tuile ?", []), ("2", "JEU", "Et le plateau ?", [("Q", "A")])],
                                  f"query_id string, collection string, question string, history {A.HISTORY}")
    out = A.ask(asked, collections, passages, index.postings(passages), index.hashed_vector, F.lit("2024-01-02").cast("timestamp"), model, min_score=-1)
    answers = {r["query_id"]: r["answer"] for r in out.answers.collect()}
    cached = [r["answer"] for r in out.to_cache.collect()]
    assert out.log.count() == 2 and calls.value == 2
    assert cached == [answers["1"]] and answers["1"].isdigit()


class Handle:
    """Stand-in for the state of one key."""

    def __init__(self):
        self.values, self.timers = {}, []

    def _state(self, name, schema):
        outer = self

        class State:
            def exists(self):
                return name in outer.values

            def get(self):
                return outer.values.get(name, ())

            def update(self, value):
                outer.values[name] = value

            put = update

            def clear(self):
                outer.values.pop(name, None)
        return State()

    getValueState = getListState = _state

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_idle_keys_and_finished_jobs_are_swept():
    handle, bucket = Handle(), J.TokenBucket(6, True)
    bucket.init(handle)
    for _ in range(2):
        list(bucket.handleInputRows(("k",), iter([pd.DataFrame({"request_id": [2, 1], "at": [5.0, 1.0]})]), Now()))
    assert handle.timers == [61000] and handle.values["bucket"][1] == 5.0
    list(bucket.handleExpiredTimer(("k",), Now(), None))
    assert handle.values == {}
    handle, job = Handle(), J.JobState(3, True)
    job.init(handle)
    rows = pd.DataFrame({"event_id": [1, 2], "event_type": ["progress", "completed"], "at_ms": [1, 2], "current": [4, None], "message": [None, None]})
    (out,) = job.handleInputRows((7,), iter([rows]), Now())
    assert handle.timers == [1000 + J.DAY_MS] and out.iloc[0]["current"] == 4 and out.iloc[0]["status"] == "completed"
    list(job.handleExpiredTimer((7,), Now(), None))
    assert handle.values == {}


def test_answers_made_by_the_stream_are_served_for_a_day(spark, tmp_path):
    day, start = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    q_schema, a_schema = "question_id string, cache_key string, asked_at timestamp, history_turns int", "cache_key string, answer string, made_at timestamp"
    hour = lambda h: start + dt.timedelta(hours=h)
    batches = [([("1", "k", hour(0), 0), ("2", "k", hour(0), 1), ("0", None, hour(0), 0)], [("k", "one", hour(1)), (None, "lost", hour(0)), ("k", None, hour(2))]),
               ([("3", "k", hour(2), 0), ("4", "k2", hour(2), 0), ("5", "k", hour(0.5), 0)], []),  # k2: the collection was indexed again
               ([("6", "k", hour(1) + day, 0), ("7", "k", hour(26), 0)], [("k", "two", hour(25.5)), ("k", "old", hour(0.25))]),
               ([("8", "k", hour(40), 0)], [("k2", "other", hour(3))])]
    root = tmp_path / "stream"
    for asked, made in batches:
        for name, rows, schema in (("questions", asked, q_schema), ("answers", made, a_schema)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(root / name))
        streams = [spark.readStream.schema(schema).parquet(str(root / name)) for name, schema in (("questions", q_schema), ("answers", a_schema))]
        served = J.answer_cache_stream(*streams)
        J.run_available(served.writeStream.format("parquet").outputMode("append").option("path", str(root / "out")), str(root / "check"))
    got = {r["question_id"]: r["answer"] for r in spark.read.parquet(str(root / "out")).collect()}
    want = {"1": None, "3": "one", "4": None, "5": None, "6": None, "7": "two", "8": "two"}
    assert got == want
    # a flow that never ends, its state with a time to live
    served = J.answer_cache_stream(*streams, sweep=True)
    query = (served.writeStream.format("parquet").outputMode("append").option("path", str(root / "out2"))
             .option("checkpointLocation", str(root / "check2")).start())
    try:
        end = time.time() + 60
        while time.time() < end and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.5)
    finally:
        query.stop()
    live = {r["question_id"]: r["answer"] for r in spark.read.parquet(str(root / "out2")).collect()}
    assert live == {**want, "5": "old"}  # all files in one batch, in the order of time
    asked, made = (spark.createDataFrame([r for b in batches for r in b[i]], schema) for i, schema in ((0, q_schema), (1, a_schema)))
    batch = {r["question_id"]: (r["answer"], r["cached"]) for r in V.live_answers(asked, made).collect()}
    assert batch == {**{q: (a, a is not None) for q, a in want.items()}, "2": (None, False), "0": (None, False), "5": ("old", True)}


def test_ordered_limiter_takes_rows_without_a_frame_per_key(monkeypatch):
    """Requests of a key come and go as rows, in parts of bounded size; no data frame is made for them."""
    import pandas as pd
    from pyspark.sql import Row

    class Held(dict):
        value = None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)
        updateValue, getValue, registerTimer = dict.__setitem__, dict.__getitem__, lambda self, at: None

    class Clock:
        getCurrentWatermarkInMs = lambda self: 0

    monkeypatch.setattr(J, "PART_ROWS", 4, raising=False)
    monkeypatch.setattr(pd, "DataFrame", None)
    bucket = J.OrderedTokenBucket(6, 10.0)
    bucket.handle, bucket.bucket, bucket.waiting = Held(), Held(), Held()
    asked = [Row(key="a", request_id=i, at=float(i), tick=False) for i in range(6)] + [Row(key="a", request_id=9, at=None, tick=False)]
    late = list(bucket.handleInputRows(("a",), iter(asked), Clock()))
    assert [(r.request_id, r.allowed, r.late) for r in late] == [(9, None, True)]
    assert dict(bucket.waiting) == {(0, 0): ([0.0, 1.0, 2.0, 3.0], [0, 1, 2, 3]), (0, 1): ([4.0, 5.0], [4, 5])}
