"""Streams: windows over event time with watermarks, job states, circuits and memory kept as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.retrieve import top_k
from ..operators.runs import circuit
from ..tables import Scratch

# What an event type stands for in a job's life.
STATUS = {"view": "queued", "click": "running", "purchase": "completed", "error": "failed", "signup": "retry"}


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files; ts becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total) of windows; events later than the watermark are left out."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n", "total")


#: States that need timers and lists are kept by this provider.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("completed", "failed")


def _none(x):
    return None if x is None or x != x else x


class Jobs(StatefulProcessor):
    """State of each job with its last events. With event time, a job that says nothing for `stall` seconds has failed and may
    be retried, and one that has ended is forgotten after `forget` seconds, each by a timer on the watermark."""

    def __init__(self, keep: int = 64, stall: float | None = None, forget: float | None = None):
        self.keep, self.stall, self.forget = keep, stall, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, created double, started double, ended double, last double, seq long, events long, error string")
        self.recent = handle.getListState("recent", "at double, seq long, status string")

    def _row(self, key: tuple, state: tuple, recent: list[tuple]) -> pd.DataFrame:
        status, created, started, ended, _, _, events, error = state
        done = ended if status in TERMINAL else None
        return pd.DataFrame([(key[0], status, created, started, done, events, error, [{"at": a, "seq": s, "status": x} for a, s, x in recent])], columns=["job_id", "status", "created_at", "started_at", "completed_at", "events", "error_code", "recent"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(_none(a), int(s), x) for pdf in rows for a, s, x in pdf[["at", "seq", "status"]].itertuples(index=False)]
        status, created, started, ended, last, seq, events, _ = self.job.get() if self.job.exists() else (None, None, None, None, None, None, 0, None)
        last, seq, created, started, ended = (_none(x) for x in (last, seq, created, started, ended))
        # An event without a time comes before all others, then the number decides.
        order = lambda a, s: (a is not None, a or 0.0, s)
        for at, number, now in new:
            if status is None or order(at, number) >= order(last, seq):
                status, last, seq = now, at, number
            if at is not None:
                created = at if created is None else min(created, at)
                if now == "running":
                    started = at if started is None else min(started, at)
                if now in TERMINAL:
                    ended = at if ended is None else max(ended, at)
        recent = [(_none(a), int(s), x) for a, s, x in (self.recent.get() if self.recent.exists() else [])] + new
        recent = sorted(recent, key=lambda r: order(r[0], r[1]), reverse=True)[: self.keep]
        state = (status, created, started, ended, last, seq, events + len(new), None)
        self.job.update(state)
        self.recent.put(recent)
        wait = self.forget if status in TERMINAL else self.stall
        if wait is not None and last is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(1, int((last + wait) * 1000)))
        yield self._row(key, state, recent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        state = self.job.get()
        recent = [(_none(a), int(s), x) for a, s, x in (self.recent.get() if self.recent.exists() else [])]
        if state[0] in TERMINAL:
            self.job.clear()
            self.recent.clear()
            return
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        state = ("failed", _none(state[1]), _none(state[2]), at, at, state[5], state[6], "service_restarted")
        self.job.update(state)
        if self.forget is not None:
            self.handle.registerTimer(int((at + self.forget) * 1000))
        yield self._row(key, state, recent)

    def close(self) -> None:
        pass


class Circuits(StatefulProcessor):
    """Circuit of each tool before every call (see runs.circuit); with event time, a row without a number tells when an open one
    has recovered, as the watermark passes that time and not at the next call."""

    def __init__(self, limit: int, recovery: float, timed: bool):
        self.limit, self.recovery, self.timed = limit, recovery, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("circuit", "fails long, since double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fails, since = self.state.get() if self.state.exists() else (0, None)
        since, before, out = _none(since), _none(since), []
        calls = [(int(s), _none(a), bool(k)) for pdf in rows for s, a, k in pdf[["seq", "at", "ok"]].itertuples(index=False)]
        for seq, at, ok in sorted(calls, key=lambda c: (c[0], c[1] is not None, c[1] or 0.0, c[2])):
            state, fails, since = circuit(fails, since, at, ok, self.limit, self.recovery)
            out.append((key[0], seq, state))
        self.state.update((fails, since))
        if self.timed and since != before:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if since is not None:
                self.handle.registerTimer(max(1, int((since + self.recovery) * 1000)))
        yield pd.DataFrame(out, columns=["tool", "seq", "state"]).astype({"seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], None, "half_open")], columns=["tool", "seq", "state"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def _timed(events: DataFrame, wanted: bool, late: str) -> tuple[DataFrame, str]:
    """events with a watermark over `at` where timers are wanted, and the time mode."""
    if not wanted:
        return events, "None"
    at = F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))
    return events.withColumn("event_time_", at).withWatermark("event_time_", late), "EventTime"


def job_states(events: DataFrame, keep: int = 64, stall: float | None = None, forget: float | None = None, late: str = "1 hour") -> DataFrame:
    """A row for each job at each batch that changes it, or as its timer runs out: status, times, number of events, error_code and
    `recent`, its last events, the newest first. events: (job_id, at, seq, status)."""
    rows = events if "seq" in events.columns else events.withColumn("seq", F.lit(0).cast("long"))
    rows, mode = _timed(rows, stall is not None or forget is not None, late)
    kind = dict(rows.dtypes)["job_id"]
    return rows.groupBy("job_id").transformWithStateInPandas(Jobs(keep, stall, forget), f"job_id {kind}, status string, created_at double, started_at double, completed_at double, events long, error_code string, recent array<struct<at: double, seq: long, status: string>>", "Update", mode)


def breaker(calls: DataFrame, limit: int = 3, recovery: float = 60.0, timed: bool = False, late: str = "1 hour") -> DataFrame:
    """(tool, seq, state) of each call (tool, seq, at, ok) as it comes: closed, open or half_open."""
    rows, mode = _timed(calls, timed, late)
    kind = dict(rows.dtypes)["tool"]
    return rows.groupBy("tool").transformWithStateInPandas(Circuits(limit, recovery, timed), f"tool {kind}, seq long, state string", "Update" if not timed else "Append", mode)


class KeyedTable:
    """A table of the latest row of each key in the shared folder, in buckets by the key's hash.

    A batch rewrites only the buckets that its keys are in, as a generation named by the batch, and then writes a manifest of
    the generation of every bucket; the newest whole manifest is the table. A batch that comes again before its manifest was
    written writes its generation anew; one that comes again after it changes nothing. What neither the newest manifest nor the
    one before names is removed, so that a reader of the last state can end."""

    def __init__(self, path: str, key: str = "memory_id", version: str = "version", buckets: int = 64):
        self.path, self.key, self.version, self.buckets = path.rstrip("/"), key, version, buckets

    def _files(self, spark: SparkSession):
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, spark: SparkSession, folder: str) -> list[str]:
        fs, at = self._files(spark), spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _manifests(self, spark: SparkSession) -> list[int]:
        """Numbers of whole manifests, in order."""
        there = lambda n: "_SUCCESS" in self._listed(spark, f"manifest/{n}")
        return sorted(int(n) for n in self._listed(spark, "manifest") if n.isdigit() and there(n))

    def _generations(self, spark: SparkSession, number: int) -> dict[int, int]:
        """A number for each bucket in use."""
        return {r["bucket"]: r["generation"] for r in spark.read.schema("bucket int, generation long").parquet(f"{self.path}/manifest/{number}").collect()}

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, schema, generations: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{g}/bucket={b}" for b, g in sorted(generations.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The table as of the newest manifest; empty before the first."""
        known = self._manifests(spark)
        return self._read(spark, schema, self._generations(spark, known[-1]) if known else {})

    def merge(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch sink: the latest version of each key, of equal versions the new row. Rows with a null key are one key."""
        from ..operators.memory import upsert

        spark = batch.sparkSession
        known = self._manifests(spark)
        if known and known[-1] >= number:
            return
        before = self._generations(spark, known[-1]) if known else {}
        touched = [r["b"] for r in batch.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
        old = self._read(spark, batch.schema, {b: before[b] for b in touched if b in before})
        merged = upsert(old, batch, self.key, self.version).withColumn("bucket", self._bucket())
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        after = before | {b: number for b in touched}
        spark.createDataFrame(sorted(after.items()), "bucket int, generation long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        self._clean(spark, after, before, {number, *known[-1:]})

    def _clean(self, spark: SparkSession, after: dict[int, int], before: dict[int, int], manifests: set[int]) -> None:
        fs, at = self._files(spark), spark._jvm.org.apache.hadoop.fs.Path
        used = {(g, b) for m in (after, before) for b, g in m.items()}
        for g in (x for x in self._listed(spark, "data") if x.isdigit()):
            left = [x for x in self._listed(spark, f"data/{g}") if x.startswith("bucket=")]
            gone = [x for x in left if (int(g), int(x[7:])) not in used]
            for x in gone if len(gone) < len(left) else [""]:
                fs.delete(at(f"{self.path}/data/{g}/{x}".rstrip("/")), True)
        for n in self._listed(spark, "manifest"):
            if n.isdigit() and int(n) not in manifests:
                fs.delete(at(f"{self.path}/manifest/{n}"), True)


def upsert_to(path: str, key: str = "memory_id", version: str = "version", buckets: int = 64):
    """A foreachBatch sink into a KeyedTable at path."""
    return KeyedTable(path, key, version, buckets).merge


def drain(df: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """All that a stream gives from the files there are now, as Parquet in the shared folder: a generation for each batch, of
    which only the last counts in complete mode, and with keys only the last row of each of them. With a checkpoint folder the
    stream goes on where an earlier one ended."""
    scratch = Scratch(df.sparkSession, name)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_", F.lit(number)).write.mode("overwrite").parquet(f"{scratch.dir}/{number}")
        if number not in done:
            done.append(number)
        if mode == "complete":
            scratch.drop(*(str(n) for n in done[:-1]))
            del done[:-1]

    conf, key = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKSDB)
    try:
        query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{scratch.dir}/state").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(key, before) if before else conf.unset(key)
    scratch.drop("state")
    if not done:
        return df.sparkSession.createDataFrame([], df.schema)
    # One scan of all batches, each row with its batch's number.
    rows = df.sparkSession.read.schema(T.StructType(list(df.schema)).add("batch_", T.IntegerType())).parquet(*(f"{scratch.dir}/{n}" for n in done))
    if not keys:
        return rows.drop("batch_")
    return top_k(rows, keys, [F.desc("batch_")], 1, "last_").drop("batch_", "last_")
