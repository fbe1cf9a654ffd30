import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import runs
from lodestrata.streaming import streams

EVENTS = "job_id long, at double, seq long, status string"
CALLS = "tool string, seq long, at double, ok boolean"


def feed(spark, path, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/part={n}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/part=*")


def made_events(seed=5, n=400):
    """Jobs with more than 64 events, ties in time, null times and times before 1970."""
    rng = random.Random(seed)
    return [(rng.randrange(4), rng.choice([None, -50.0, -3.5, 0.0, 10.0, float(rng.randrange(-100, 100))]), i, rng.choice(["queued", "running", "completed", "failed", "retry"])) for i in range(n)]


def test_jobs_and_their_last_events_across_a_restart(spark, tmp_path):
    rows = made_events()
    path, state = str(tmp_path), str(tmp_path / "checkpoint")
    for n, part in enumerate((rows[:150], rows[150:250])):
        feed(spark, path, part, EVENTS, n)
    first = streams.drain(streams.job_states(stream(spark, path, EVENTS)), "jobs_first", "update", checkpoint=state)
    assert first.count() > 0
    feed(spark, path, rows[250:], EVENTS, 2)  # the query has ended; the next starts from its checkpoint
    last = streams.drain(streams.job_states(stream(spark, path, EVENTS)), "jobs_second", "update", ["job_id"], checkpoint=state).collect()
    batch = spark.createDataFrame(rows, EVENTS)
    want = {r["job_id"]: r for r in runs.job_states(batch).collect()}
    assert {r["job_id"]: (r["status"], r["created_at"], r["started_at"], r["completed_at"]) for r in last} == {j: (r["status"], r["created_at"], r["started_at"], r["completed_at"]) for j, r in want.items()}
    recent = {(r["job_id"], r["seq"], r["recent"]) for r in runs.last_events(batch).collect()}
    assert {(r["job_id"], e["seq"], i + 1) for r in last for i, e in enumerate(r["recent"])} == recent
    assert sum(r["events"] for r in last) == len(rows) and max(len(r["recent"]) for r in last) == 64


def test_job_timers(spark, tmp_path):
    """A job that falls silent has failed as the watermark passes, one that has ended is forgotten."""
    path = str(tmp_path)
    feed(spark, path, [(1, 100.0, 1, "running"), (2, 100.0, 2, "completed"), (3, 4000.0, 3, "running")], EVENTS, 0)
    feed(spark, path, [(3, 9000.0, 4, "running")], EVENTS, 1)
    feed(spark, path, [(3, 9001.0, 5, "running"), (2, 9002.0, 6, "queued")], EVENTS, 2)
    got = [(r["job_id"], r["status"], r["error_code"], r["events"]) for r in streams.drain(streams.job_states(stream(spark, path, EVENTS), stall=600.0, forget=600.0, late="10 seconds"), "job_timers", "update").collect()]
    assert (1, "failed", "service_restarted", 1) in got
    assert (2, "queued", None, 1) in got  # counted anew: what was known of job 2 had been forgotten


CASES = [[(0, False), (1, False), (2, True), (10, True), (11, True)], [(-100, False), (-99, False), (-98, False), (-90, True), (-80, False)], [(None, False), (None, False), (None, True), (5, False), (None, False), (6, False), (None, True), (60, True)]]


def test_circuit_stream_equals_batch_across_a_restart(spark, tmp_path):
    rows = [(f"t{k}", i, None if t is None else float(t), ok) for k, case in enumerate(CASES) for i, (t, ok) in enumerate(case)]
    rng = random.Random(2)
    rows += [("busy", i, rng.choice([None, float(i) - 150]), rng.random() < 0.5) for i in range(300)]
    path, state = str(tmp_path), str(tmp_path / "checkpoint")
    feed(spark, path, [r for r in rows if r[1] < 3], CALLS, 0)
    one = streams.drain(streams.breaker(stream(spark, path, CALLS), 2, 5.0), "calls_first", "update", checkpoint=state).collect()
    feed(spark, path, [r for r in rows if r[1] >= 3], CALLS, 1)
    two = streams.drain(streams.breaker(stream(spark, path, CALLS), 2, 5.0), "calls_second", "update", checkpoint=state).collect()
    want = {tuple(r) for r in runs.breaker(spark.createDataFrame(rows, CALLS), 2, 5.0).collect()}
    assert {tuple(r) for r in one + two} == want and len(one) + len(two) == len(rows)


def test_circuit_recovers_by_its_timer(spark, tmp_path):
    path = str(tmp_path)
    feed(spark, path, [("a", 1, 1000.0, False), ("a", 2, 1001.0, False), ("b", 1, 1000.0, True)], CALLS, 0)
    feed(spark, path, [("b", 2, 9000.0, True)], CALLS, 1)
    got = [tuple(r) for r in streams.drain(streams.breaker(stream(spark, path, CALLS), 2, 60.0, timed=True, late="10 seconds"), "calls_timed").collect()]
    assert ("a", None, "half_open") in got and not [r for r in got if r[0] == "b" and r[1] is None]


ROWS = "memory_id string, version long, text string"


def size(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/data/" in d + "/"}


def test_keyed_table_rewrites_only_the_buckets_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    table = streams.KeyedTable(path, buckets=32)
    table.merge(spark.createDataFrame([(f"k{i}", 1, f"text {i} " * 20) for i in range(2000)], ROWS), 0)
    before = size(path)
    table.merge(spark.createDataFrame([("k7", 2, "new"), ("k7", 1, "old"), ("k8", 0, "older"), (None, 1, "no key")], ROWS), 1)
    new = {f: n for f, n in size(path).items() if f not in before}
    assert sum(new.values()) < 0.25 * sum(before.values())
    got = {r["memory_id"]: r["text"] for r in table.read(spark, ROWS).collect()}
    assert len(got) == 2001 and got["k7"] == "new" and got["k8"] == "text 8 " * 20 and got[None] == "no key"


def test_keyed_table_after_crashes_and_repeats(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = streams.KeyedTable(path, buckets=8)
    batches = [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("c", 1, "v")], [("b", 2, "w")], [("a", 2, "same version")]]
    frames = [spark.createDataFrame(b, ROWS) for b in batches]
    table.merge(frames[0], 0)
    with monkeypatch.context() as m:  # the driver dies between the rows and the manifest
        m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            table.merge(frames[1], 1)
    assert {r["memory_id"]: r["text"] for r in table.read(spark, ROWS).collect()} == {"a": "x", "b": "y"}
    table.merge(frames[1], 1)  # the batch comes again
    once = {r["memory_id"]: r["text"] for r in table.read(spark, ROWS).collect()}
    table.merge(frames[1], 1)  # and again after all was written
    assert once == {r["memory_id"]: r["text"] for r in table.read(spark, ROWS).collect()} == {"a": "z", "b": "y", "c": "v"}
    for n in (2, 3):
        table.merge(frames[n], n)
    assert {r["memory_id"]: r["text"] for r in table.read(spark, ROWS).collect()} == {"a": "same version", "b": "w", "c": "v"}
    # Old generations go: at most two of each bucket stay.
    kept = [f.split("bucket=")[1].split("/")[0] for f in size(path)]
    assert all(kept.count(b) <= 2 for b in kept) and len(os.listdir(f"{path}/manifest")) <= 2


def test_keyed_table_as_a_sink(spark, tmp_path):
    path = str(tmp_path)
    for n, rows in enumerate(([("a", 1, "x")], [("a", 2, "y"), ("b", 1, "z")])):
        feed(spark, path, rows, ROWS, n)
    query = stream(spark, path, ROWS).writeStream.foreachBatch(streams.upsert_to(f"{path}/t")).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["memory_id"]: r["text"] for r in streams.KeyedTable(f"{path}/t").read(spark, ROWS).collect()} == {"a": "y", "b": "z"}
    assert spark.read.schema(ROWS).parquet(f"{path}/t/data/*/*").agg(F.count("*")).first()[0] >= 2
