import json

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import readers, writers
from lodestrata.streaming import streams


def test_captions(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:00,500 --> 00:00:03,000\n<i>Hello</i>\nyou\n\n2\n00:00:04,000 --> 00:00:07,000 align:start\nthere\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\nNOTE x --> y\n\n00:01.000 --> 00:02.000\nhi\n")
    rows = [tuple(r)[1:] for r in readers.captions(spark, str(tmp_path)).orderBy("path", "span_start").collect()]
    assert rows == [(0.5, 3.0, "Hello you"), (4.0, 7.0, "there"), (1.0, 2.0, "hi")]


def test_caption_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"segments": [{"start": 0, "end": 1, "text": " a "}, {"start": 2, "end": 2, "text": "b"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"start_sec": 3, "end_sec": 4, "text": "c"}]))
    assert [tuple(r)[1:] for r in readers.caption_json(spark, str(tmp_path)).orderBy("span_start").collect()] == [(0.0, 1.0, "a"), (3.0, 4.0, "c")]


def test_records_that_do_not_parse_are_errors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"record_id": "a", "split": "train"}\n{"record_id": \n')
    with pytest.raises(Exception, match="bad sft record"):
        readers.jsonl(spark, str(tmp_path / "x.jsonl"), "sft").collect()


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "segment_id string, embedding array<float>")
    writers.write_index(df, str(tmp_path / "i"))
    assert readers.dense_index(spark, str(tmp_path / "i"), 2).count() == 1
    with pytest.raises(Exception, match="3 numbers"):
        readers.dense_index(spark, str(tmp_path / "i"), 3).collect()


def test_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    got = readers.listing(spark, str(tmp_path)).first()
    assert got["size"] == 1 and got["sha256"].startswith("2d711642")


def test_stream_of_jobs_agrees_with_batch(spark, tmp_path):
    rows = [(1, 100.0, "queued"), (1, 105.0, "running"), (1, 112.0, "completed"), (2, 101.0, "queued")]
    spark.createDataFrame(rows, "job_id long, at double, status string").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("job_id long, at double, status string").parquet(str(tmp_path / "e"))
    got = {r["job_id"]: (r["status"], r["started_at"], r["completed_at"]) for r in streams.drain(streams.job_states(events), "jobs_test", "update").collect()}
    assert got == {1: ("completed", 105.0, 112.0), 2: ("queued", None, None)}


def test_stream_breaker(spark, tmp_path):
    rows = [("t", i, float(t), ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, True), (10, True), (11, True)])]
    spark.createDataFrame(rows, "tool string, seq long, at double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "c"))
    calls = spark.readStream.schema("tool string, seq long, at double, ok boolean").parquet(str(tmp_path / "c"))
    got = streams.drain(streams.breaker(calls, 2, 5.0), "breaker_test").orderBy("seq").collect()
    assert [r["state"] for r in got] == ["closed", "closed", "open", "half_open", "closed"]


def test_stream_windows(spark):
    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = streams.read_events(spark, f"{d}/events.parquet*", schema)
    total = streams.drain(streams.tumbling(events), "windows_test", "complete").agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{d}/events.parquet").count()


def test_drained_stream_is_in_files(spark):
    """A result is read from the shared folder, not from the driver's memory, and is whole."""
    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    got = streams.drain(streams.tumbling(streams.read_events(spark, f"{d}/events.parquet*", schema)), "files_test", "complete")
    assert got.inputFiles()
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{d}/events.parquet").count()
