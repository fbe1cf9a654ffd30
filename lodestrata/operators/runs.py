"""Jobs, tool calls and caches as event logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import running
from .retrieve import top_k

TERMINAL = ["completed", "failed"]


def job_states(events: DataFrame, now: float | None = None) -> DataFrame:
    """(job_id, status, created_at, started_at, completed_at, elapsed_sec) from events (job_id, at, status, seq).

    A job's last event gives its status; elapsed time runs from the start (or creation, if it waits) to its end, or now."""
    s = events.groupBy("job_id").agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.min("at").alias("created_at"), F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"), F.max(F.when(F.col("status").isin(TERMINAL), F.col("at"))).alias("ended"), F.max("at").alias("last"))
    done = F.when(F.col("status").isin(TERMINAL), F.col("ended"))
    clock = F.lit(now).cast("double") if now is not None else F.col("last")
    return s.select("job_id", "status", "created_at", "started_at", done.alias("completed_at"), F.greatest(F.lit(0.0), F.coalesce(done, clock) - F.coalesce("started_at", "created_at")).alias("elapsed_sec"))


def recover(states: DataFrame) -> DataFrame:
    """States after a restart: jobs that waited or ran have failed and may be retried."""
    open_ = ~F.col("status").isin(TERMINAL)
    return states.withColumn("error_code", F.when(open_, "service_restarted")).withColumn("retryable", open_).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))


def queue_positions(states: DataFrame, width: float = 3600.0) -> DataFrame:
    """Place of each waiting job by creation, from 1. One service has one queue, ordered by ranges of creation times."""
    waiting = states.filter("status = 'queued'").select("job_id", "created_at")
    placed = running(waiting, [], F.floor(F.col("created_at") / width), ["created_at", "job_id"], {"position": F.lit(1)})
    return placed.select("job_id", F.col("position").cast("int").alias("position"))


def last_events(events: DataFrame, k: int = 64) -> DataFrame:
    return top_k(events, ["job_id"], [F.desc("at"), F.desc("seq")], k, "recent")


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("jobs"))


def progress(elapsed):
    """Progress that a waiting client is shown."""
    return F.least(F.lit(85), 35 + 3 * F.floor(elapsed / 10))


def error_code(message):
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(F.contains(low, F.lit("memory")), "out_of_memory").when(F.contains(low, F.lit("timeout")) | F.contains(low, F.lit("timed out")), "timeout").when(F.contains(low, F.lit("not found")) | F.contains(low, F.lit("no such file")), "not_found").otherwise("processing_error")


def failure_runs(calls: DataFrame, limit: int = 3, width: int = 4096) -> DataFrame:
    """calls (tool, seq, ok) with `failures`, the failures in a row up to each call, and `opens`, where they reach the limit.

    Failures so far less those at the last success, both over ranges of `width` numbers seq: a tool's calls are many tasks."""
    at = F.floor(F.col("seq") / width)
    failed = running(calls, ["tool"], at, ["seq"], {"failed_": F.when(F.col("ok"), 0).otherwise(1)})
    out = running(failed, ["tool"], at, ["seq"], {"base_": F.when(F.col("ok"), F.col("failed_"))}, F.max)
    out = out.withColumn("failures", F.col("failed_") - F.coalesce("base_", F.lit(0))).drop("failed_", "base_")
    return out.withColumn("opens", ~F.col("ok") & (F.col("failures") == limit))


def circuit(fails: int, since: float | None, at: float | None, ok: bool, limit: int, recovery: float) -> tuple[str, int, float | None]:
    """State of a circuit before a call, and its failures in a row and the time it opened after it (none: it is not open).

    What is turned away changes nothing, a success closes, the limit of failures opens. A call without a time neither opens a
    circuit nor finds an open one recovered."""
    state = "closed" if since is None else "half_open" if at is not None and at - since >= recovery else "open"
    if state == "open":
        return state, fails, since
    fails = 0 if ok else fails + 1
    return state, fails, at if fails >= limit and not ok else None


def breaker(calls: DataFrame, limit: int = 3, recovery: float = 60.0) -> DataFrame:
    """(tool, seq, state): the circuit before each call (tool, seq, at, ok): closed, open (the call is turned away) or half_open.

    A tool's calls pass through a task in order, which holds a batch of them and two numbers."""

    def run(batches):
        tool, started, fails, since = None, False, 0, None
        for batch in batches:
            states = []
            for name, at, ok in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(2), batch.column(3)))):
                if not started or name != tool:
                    tool, started, fails, since = name, True, 0, None
                state, fails, since = circuit(fails, since, at, ok, limit, recovery)
                states.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(states, pa.string())], ["tool", "seq", "state"])

    rows = calls.select("tool", F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), "ok")
    schema = T.StructType([*rows.select("tool", "seq").schema, T.StructField("state", T.StringType())])
    return rows.repartition("tool").sortWithinPartitions("tool", "seq", "at", "ok").mapInArrow(run, schema)


def call_summary(calls: DataFrame) -> DataFrame:
    """(tool, calls, ok, attempts, latency_ms, last_ok) of calls (tool, seq, ok, attempts, latency_ms)."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.sum("attempts").alias("attempts"), F.avg("latency_ms").alias("latency_ms"), F.max_by("ok", "seq").alias("last_ok"))


def backoff(attempt, base: float = 0.5):
    """Seconds before the attempt after this one: linear."""
    return attempt * base


def cache_counts(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    c = lambda name: F.count_if(F.col(status) == name).alias(name)
    return rows.groupBy(*by).agg(c("hit"), c("miss"), F.count_if(~F.col(status).isin("hit", "miss") | F.col(status).isNull()).alias("unknown"))


def cached(wanted: DataFrame, cache: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """wanted (key[, legacy_key]) with the value kept under its key, or under its older key, and `status` hit or miss."""
    out = wanted.join(cache, "key", "left")
    if legacy is not None:
        out = out.join(legacy.select(F.col("key").alias("legacy_key"), F.col("value").alias("old_value")), "legacy_key", "left").withColumn("value", F.coalesce("value", "old_value")).drop("old_value")
    return out.withColumn("status", F.when(F.col("value").isNull(), "miss").otherwise("hit"))
