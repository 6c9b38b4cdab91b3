"""State that streams keep: jobs, status of sessions, running experiments; each against plain Python, with restarts."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import experiments
from vellum.streaming import ab, jobs, status, stream

RESPONSE = "job_id string, batch string, asked_s long, status string, request_token string, next_token string"


@pytest.fixture
def spark(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_jobs_end_once(spark, tmp_path):
    stream.keep_state_in_rocksdb(spark)
    rows = [
        # succeeds at the second poll with one batch
        ("one", "a", 0, "IN_PROGRESS", None, None), ("one", "b", 5, "SUCCEEDED", None, None), ("one", "c", 9, "FAILED", None, None),
        # three batches, the last part of them after a restart
        ("three", "a", 0, "SUCCEEDED", None, "t1"), ("three", "b", 6, "SUCCEEDED", "t1", "t2"), ("three", "c", 900, "SUCCEEDED", "t2", None),
        ("slow", "a", 0, "SUCCEEDED", None, "t1"), ("slow", "b", 20, "SUCCEEDED", "t1", None),
        # two batches with a missing one between them
        ("hole", "a", 0, "SUCCEEDED", None, "t1"), ("hole", "c", 8, "SUCCEEDED", "t2", None),
        ("bad", "a", 0, "IN_PROGRESS", None, None), ("bad", "b", 10, "FAILED", None, None),
        ("late", "a", 100, "IN_PROGRESS", None, None), ("late", "b", 701, "SUCCEEDED", None, None),
        (None, "a", 1, "SUCCEEDED", None, None), ("open", "a", 990, "IN_PROGRESS", None, None), ("clock", "a", 1000, "IN_PROGRESS", None, None),
    ] + [("polled", f"p{k:03d}", k, "IN_PROGRESS", None, None) for k in range(125)]
    df = spark.createDataFrame(rows, RESPONSE)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = lambda arrived: stream.drain(jobs.job_results(arrived.withColumn("asked", F.timestamp_seconds(F.col("asked_s") + 86_400))), out, checkpoint)
    stream.in_slices(df, "asked_s", 4, run)
    got = sorted((r.job_id, r.outcome, r.attempts, r.n_batches, r.ended_ms // 1000 - 86_400) for r in spark.read.parquet(out).collect())
    assert got == [
        ("bad", "FAILED", 2, 0, 10), ("hole", "TIMED_OUT", 1, 2, 600), ("late", "TIMED_OUT", 1, 0, 700), ("one", "SUCCEEDED", 2, 1, 5),
        ("polled", "TIMED_OUT", 120, 0, 119), ("slow", "SUCCEEDED", 1, 2, 20), ("three", "TIMED_OUT", 1, 2, 600),
    ]


def plain_status(changes):
    level, out = {"UPLOADING": 1, "PROCESSING": 2, "READY": 3, "FAILED": 3}, {}
    for session, name, ts, event in sorted(changes, key=lambda c: (c[2], c[3])):
        now, moved, refused = out.get(session, (None, 0, 0))
        if level.get(name) == level.get(now, 0) + 1:
            out[session] = (name, moved + 1, refused)
        else:
            out[session] = (now, moved, refused + 1)
    return out


def test_status_is_merged_once(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "table")
    names = ["UPLOADING", "UPLOADING", "PROCESSING", "READY", "FAILED", "LOST"]
    rows = [(f"s{rng.randint(0, 40)}", rng.choice(names), k // 2, k) for k in range(400)]
    frames = [spark.createDataFrame(part, "session_id string, status string, ts long, event_id long").withColumn("ts", F.timestamp_seconds("ts")) for part in (rows[:150], rows[150:300], rows[300:])]
    now = lambda: {r.session_id: (r.status, r.n_changes, r.n_refused) for r in status.read_status(spark, path).collect()}
    for k, part in enumerate(frames):
        status.merge_status(path, part, k, buckets=8)
        once = now()
        status.merge_status(path, part, k, buckets=8)  # a batch that is replayed
        assert now() == once == plain_status(rows[: (150, 300, 400)[k]])
    # a change from before the last move, one without a time and one without a session
    odd = spark.createDataFrame([("s0", "READY", 0, 0), ("s1", "READY", None, 1), (None, "READY", 5, 2), ("new", "LOST", 9, 3)], "session_id string, status string, ts long, event_id long")
    status.merge_status(path, odd.withColumn("ts", F.timestamp_seconds("ts")), 3, buckets=8)
    after = now()
    assert after["s0"] == (*once["s0"][:2], once["s0"][2] + 1) and after["s1"][2] == once["s1"][2] + 1 and after["new"] == (None, 0, 1) and None not in after
    # a version without its mark isn't there
    spark.createDataFrame([("ghost", "READY", None, 1, 0, 0)], status.TABLE).write.partitionBy("bucket").parquet(f"{path}/v=99")
    (tmp_path / "table" / "v=99" / "_SUCCESS").unlink()
    assert now() == after
    assert status.read_status(spark, str(tmp_path / "none")).count() == 0


def test_experiments_stop_where_plain_python_stops(spark, tmp_path):
    rng = random.Random(5)
    gap = {"near": 0.0, "far": 0.2, "few": 0.2}
    rows = []
    for k in range(900):
        intent, variant = rng.choice(["near", "near", "far"]) if k % 30 else "few", rng.choice(["A", "B", None] if k % 50 == 0 else ["A", "B"])
        rows.append((k, variant, intent, min(1.0, rng.random() * 0.5 + gap[intent] * (variant == "B")), rng.random() * 9, 0.001 * k))
    df = spark.createDataFrame(rows, "run_id long, variant string, intent string, composite double, latency double, cost double")
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    stream.in_slices(df, "run_id", 6, lambda arrived: ab.watch(arrived, path, checkpoint))
    stops, found = {}, {}
    for trigger in range(6):
        for intent in gap:
            own = {v: [r[3] for r in rows if r[0] < 150 * (trigger + 1) and r[2] == intent and r[1] == v] for v in "AB"}
            n, mean = {v: len(x) for v, x in own.items()}, {v: sum(x) / max(1, len(x)) for v, x in own.items()}
            if min(n.values()) >= 50 and abs(mean["A"] - mean["B"]) >= 0.05:
                found[trigger, intent] = "conclude"
            else:
                found[trigger, intent] = "equivalent" if sum(n.values()) >= 200 else "continue"
            if found[trigger, intent] != "continue":
                stops.setdefault(intent, trigger)
    got = ab.decisions(spark, path).collect()
    assert {(r.trigger, r.intent): r.decision for r in got} == found
    assert {r.intent: r.stopped_at for r in got} == {i: stops.get(i) for i in gap} and stops
    order = lambda frame: sorted(map(tuple, frame.collect()))
    assert order(ab.last_summary(spark, path)) == order(experiments.summary(df))
    parts = experiments.moments(df.where("run_id % 3 = 0")).unionByName(experiments.moments(df.where("run_id % 3 <> 0")))
    assert order(experiments.summary_of(experiments.merged(parts))) == order(experiments.summary(df))
    assert order(experiments.decision_of(experiments.merged(parts))) == order(experiments.decision(df))


def test_a_cache_ends_with_its_session(spark, tmp_path):
    from vellum.streaming import cache

    stream.keep_state_in_rocksdb(spark)
    day = 86_400
    # a life of 100 seconds from the first question: at its very end it is over
    asked = [("s", 0, 0, "q"), ("s", 1, 50, "q"), ("s", 2, 99, "r"), ("s", 3, 100, "q"), ("s", 4, 150, "r"), ("s", 5, 199, "q"), ("s", 6, 500, "q"), ("t", 0, 60, "q"), ("t", 1, 61, "q"), (None, 0, 5, "q"), ("t", 2, 70, None)]
    df = spark.createDataFrame([(s, t, day + at, k) for s, t, at, k in asked], "session_id string, turn long, asked_s long, key string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = lambda arrived: stream.drain(cache.answered(arrived.withColumn("asked", F.timestamp_seconds("asked_s")), 100), out, checkpoint)
    stream.in_slices(df, "asked_s", 5, run)
    got = {(r.session_id, r.turn): r.hit for r in spark.read.parquet(out).collect()}
    assert got == {("s", 0): False, ("s", 1): True, ("s", 2): False, ("s", 3): False, ("s", 4): False, ("s", 5): True, ("s", 6): False, ("t", 0): False, ("t", 1): True}


def test_a_stream_takes_tables_of_many_files(spark, tmp_path):
    from vellum.plans import catalog

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("once_per_question", "stream_event_counts"):
        one, many = (sorted(map(tuple, catalog.QUERIES[name](spark, at).collect())) for at in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one and one == many


def test_jobs_ask_the_store_for_no_single_state(spark, tmp_path):
    spark.createDataFrame([], RESPONSE).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(RESPONSE).parquet(str(tmp_path / "in")).withColumn("asked", F.timestamp_seconds("asked_s"))
    plan = jobs.job_results(rows)._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan


def plain_jobs(rows, most_polls, limit):
    """Each job's result by one walk over its rows; time has passed as far as the latest row of all."""
    own, out = {}, {}
    for job, batch, at, status_, request, next_ in rows:
        own.setdefault(job, []).append((at, batch is None, batch or "", status_, request, next_))
    now = max(r[2] for r in rows)
    for job, mine in own.items():
        mine.sort(key=lambda r: r[:3])
        due, attempts, batches, named, asked, last = mine[0][0] + limit, 0, 0, [], [], 0
        for at, _, _, status_, request, next_ in mine:
            if at > due:
                break
            attempts += request is None
            if status_ == "SUCCEEDED":
                batches, last = batches + 1, last + (next_ is None)
                named, asked = named + [next_], asked + [request]
            whole = sorted(filter(None, named)) == sorted(filter(None, asked)) and None in asked and last
            end = "FAILED" if status_ == "FAILED" else "SUCCEEDED" if status_ == "SUCCEEDED" and whole else "TIMED_OUT" if status_ != "SUCCEEDED" and attempts >= most_polls else None
            if end:
                out[job] = (end, attempts, batches, at)
                break
        if job not in out and now > due:
            out[job] = ("TIMED_OUT", attempts, batches, due)
    return out


def test_many_jobs_share_a_state(spark, tmp_path):
    stream.keep_state_in_rocksdb(spark)
    rng, rows = random.Random(9), []
    for j in range(300):
        at, n = rng.randint(1, 600), rng.randint(1, 6)
        for k in range(n):
            state = rng.choice(["IN_PROGRESS", None]) if k < 2 and rng.random() < 0.6 else rng.choice(["SUCCEEDED"] * 9 + ["FAILED"])
            first = not any(r[0] == f"j{j}" and r[3] == "SUCCEEDED" for r in rows)
            token = (None if first or state != "SUCCEEDED" else f"t{k}", f"t{k + 1}" if state == "SUCCEEDED" and k < n - 1 else None)
            if rng.random() < 0.95:
                rows.append((f"j{j}", rng.choice([None, f"b{k}"]), at, state, *token))
            at += rng.choice([0, 5, 5, 40, 90])
    # a job is open as long as the latest row of all is at its limit and not beyond it
    rows += [("at", "a", 900, "IN_PROGRESS", None, None), ("end", "a", 1000, "IN_PROGRESS", None, None), ("over", "a", 899, "IN_PROGRESS", None, None)]
    expected = plain_jobs(rows, 3, 100)
    assert {e[0] for e in expected.values()} == {"SUCCEEDED", "FAILED", "TIMED_OUT"} and "over" in expected and "at" not in expected
    out, checkpoint, states = str(tmp_path / "out"), str(tmp_path / "checkpoint"), []

    def run(arrived):
        own = jobs.job_results(arrived.withColumn("asked", F.timestamp_seconds("asked_s")), most_polls=3, seconds=100, buckets=4)
        query = own.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    stream.in_slices(spark.createDataFrame(rows, RESPONSE), "asked_s", 4, run)
    got = spark.read.parquet(out).collect()
    assert len(got) == len(expected) and {r.job_id: (r.outcome, r.attempts, r.n_batches, r.ended_ms // 1000) for r in got} == expected
    assert max(states) <= 4


def test_slices_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            made.add(len(f))
            yield f

    rows, landed = spark.range(30).mapInPandas(seen, "id long"), []
    stream.in_slices(rows, "id", 3, lambda arrived: landed.append(arrived.isStreaming))
    assert made.value == 30 and landed == [True] * 3
