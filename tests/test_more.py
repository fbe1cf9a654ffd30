import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import evals, segment, select
from lodestrata.sources import readers


def test_supervision_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cases": [{"video_path": "clips/one.two.mp4", "query": "q1"}, {"case_id": "mine", "video_path": "/abs/b.mov", "query": "q2", "split": "TEST", "video_id": "vid", "gold_spans": [{"start_sec": 1, "end_sec": 2.5}]}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"case_id": "", "video_path": "x", "query": "q3", "split": ""}]))
    got = {r["case_id"]: r for r in readers.supervision(spark, str(tmp_path)).filter("query <> 'q3'").collect()}
    assert set(got) == {"supervision-0000", "mine"}
    one, two = got["supervision-0000"], got["mine"]
    assert (one["asset"], one["split"], one["gold_spans"]) == ("one.two", "dev", []) and one["media"].endswith(f"{tmp_path.name}/clips/one.two.mp4")
    assert (two["asset"], two["split"], two["media"], tuple(two["gold_spans"][0])) == ("vid", "test", "/abs/b.mov", (1.0, 2.5))
    assert readers.supervision(spark, str(tmp_path / "b.json")).first()["case_id"] == "supervision-0000"
    (tmp_path / "c.json").write_text(json.dumps([{"video_path": "x"}]))
    with pytest.raises(Exception, match="case without query"):
        readers.supervision(spark, str(tmp_path / "c.json")).collect()


def test_media_by_declared_path_name_and_bytes(spark):
    h = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]
    files = spark.createDataFrame([("/p/v/one.mp4", h[0]), ("/p/data/raw/two.mp4", h[1]), ("/p/data/raw/z/moved.MOV", h[2]), ("/p/data/raw/a/moved.mkv", h[2]), ("/p/data/raw/three.bin", h[3]), ("/elsewhere/four.mp4", h[4])], "path string, sha256 string")
    packs = [(1, "v/one.mp4", h[0]), (2, "v/one.mp4", None), (3, "v/one.mp4", h[1]), (4, "/far/two.mp4", h[1]), (5, "/far/x.mp4", h[2].upper()), (6, "/far/three.bin", h[3]), (7, "/far/other.bin", h[3]), (8, "/elsewhere/four.mp4", h[4]), (9, "", None), (10, None, "bad")]
    got = {r["pack_id"]: r["path"] for r in readers.resolve_media(spark.createDataFrame(packs, "pack_id long, declared string, sha256 string"), files, "/p/").collect()}
    assert got == {1: "/p/v/one.mp4", 2: "/p/v/one.mp4", 3: "/p/data/raw/two.mp4", 4: "/p/data/raw/two.mp4", 5: "/p/data/raw/a/moved.mkv", 6: "/p/data/raw/three.bin", 7: None, 8: None, 9: None, 10: None}


def test_reference_records(spark):
    pairs = spark.createDataFrame([(i, 0.1 * i) for i in range(5)], "pair_id long, reward_margin double")
    known = [(0, -1.0, -2.0, 4, 2), (1, -1.0, -2.0, 4, 2), (1, -5.0, -2.0, 4, 2), (2, None, -2.0, 4, 2), (4, -9.0, -3.0, 9, 1)]
    ref = spark.createDataFrame(known, "pair_id long, chosen_logp double, rejected_logp double, chosen_tokens long, rejected_tokens long")
    got = {r["pair_id"]: (r["chosen_logp"], r["error"]) for r in evals.with_reference(pairs, ref).collect()}
    assert got == {0: (-1.0, None), 1: (-5.0, "repeated"), 2: (None, "incomplete"), 3: (None, "missing"), 4: (-9.0, None)}
    part = evals.reference_bias(evals.with_reference(pairs, ref)).first()
    assert (part["pairs"], part["errors"], part["chosen_longer"], part["length_margin_r"]) == (5, 3, None, None)
    whole = evals.reference_bias(evals.with_reference(pairs.filter("pair_id in (0, 4)"), ref)).first()
    assert tuple(whole) == (2, 0, 1.0, 0.5, 1.0, pytest.approx(1.0))


def test_planner_examples(spark):
    ranked = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.9), (1, 9, 0.9), (1, 10, 0.1)], "query_id long, segment_id long, score double")
    asked = spark.createDataFrame([(1, "what"), (2, "where")], "query_id long, query string")
    got = {r["query_id"]: r for r in select.planner_examples(ranked, asked).collect()}
    assert [tuple(x) for x in got[1]["target_plan"]] == [("retrieve", "8", 0), ("retrieve", "9", 1), ("retrieve", "7", 2), ("synthesize", "knowledge_pack", None)]
    assert [tuple(x) for x in got[1]["candidates"]] == [("8", 0.9), ("9", 0.9), ("7", 0.5)]
    assert got[2]["candidates"] == [] and [tuple(x) for x in got[2]["target_plan"]] == [("synthesize", "knowledge_pack", None)]


def test_peak_memory_and_frame_hashes(spark):
    reports = [json.dumps({"warm_pack_performance": {"cuda_memory": {"devices": [{"peak_allocated_mib": 3.5}, {"peak_allocated_mib": "12.25"}, {"other": 1}]}}}), "{}", "bad", None, json.dumps({"warm_pack_performance": {"cuda_memory": {"devices": []}}})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reports)], "i int, r string")
    assert {r["i"]: r["m"] for r in df.select("i", evals.peak_memory(F.col("r")).alias("m")).collect()} == {0: 12.25, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    rows = [("a", 1, 2.0, 2, 2, b"\x01\x02"), ("a", 1, 1.0, 2, 2, b"\x03"), ("a", 2, 1.0, 2, 2, None), ("a", 3, 1.0, 2, 2, b"\x03"), ("a", 3, 2.0, 2, 2, b"\x01\x02")]
    got = {r["segment_id"]: r["frame_hash"] for r in segment.frame_hash(spark.createDataFrame(rows, "asset string, segment_id long, t double, height int, width int, pixels binary")).collect()}
    one = lambda p: hashlib.sha1(b"(2, 2, 3)" + p).hexdigest()
    assert got == {1: hashlib.sha1((one(b"\x03") + one(b"\x01\x02")).encode()).hexdigest()[:16], 2: hashlib.md5(b"empty").hexdigest()[:12], 3: got[1]}
