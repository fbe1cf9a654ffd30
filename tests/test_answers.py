import json

from pyspark.sql import functions as F

from lodestrata.operators import answers as said

ANSWER = "**问题：** which cup is red?\n\n结论：the left one\n证据：\n- a red cup stands left (timestamp=3.0-7.5)\n* then `it` falls timestamp=8.0-9.0\n记忆补充：\n- seen before\n结论：the left cup"


def test_lines_and_sections(spark):
    rows = spark.createDataFrame([(1, ANSWER), (2, ""), (3, None), (4, "just a line")], "answer_id long, answer string")
    got = [(r["answer_id"], r["part"], r["said"], tuple(r["key"]) if r["key"] else None) for r in said.lines(rows).orderBy("answer_id", "place").collect()]
    assert got == [
        (1, "question", "which cup is red?", None), (1, "conclusion", "the left one", None), (1, "evidence", "a red cup stands left", (3.0, 7.5)), (1, "evidence", "then it falls", (8.0, 9.0)),
        (1, "memory", "seen before", None), (1, "conclusion", "the left cup", None), (4, "evidence", "just a line", None),
    ]
    one = {r["answer_id"]: r.asDict() for r in said.sections(rows).collect()}
    assert one[1] == {"answer_id": 1, "question": "which cup is red?", "conclusion": "the left cup", "evidence": ["a red cup stands left", "then it falls"], "memory": ["seen before"]}
    assert one[4]["evidence"] == ["just a line"] and set(one) == {1, 4}


def test_evidence_texts(spark):
    row = spark.createDataFrame([("t ", "cap", None, "room", ["a", "b"], [])], "text string, caption string, ocr string, scene string, things array<string>, deeds array<string>")
    got = row.select(said.evidence_text(F.col("text"), F.col("caption"), F.col("ocr"), F.col("things"), F.col("deeds")).alias("x"), said.told(F.col("text"), F.col("caption"), F.col("ocr"), F.col("scene"), F.col("things"), F.col("deeds")).alias("y")).first()
    assert tuple(got) == ("t  cap a b", "cap；t；场景：room；人物与物体：a、b")
    rows = spark.createDataFrame([(1, 0, 1.0, 2.0, " x "), (1, 1, 2.0, 2.0, "y"), (1, 2, -1.0, 2.0, "z"), (2, 0, 0.0, 0.25, None)], "answer_id long, place int, start_sec double, end_sec double, text string")
    assert [(r["answer_id"], r["tag"], r["text"]) for r in said.normalised(rows).collect()] == [(1, "timestamp=1.0-2.0", "x"), (2, "timestamp=0.0-0.3", "")]
    judged = said.accepted(spark.createDataFrame([(1, True, "fine"), (2, True, "fine"), (3, False, "short")], "answer_id long, ok boolean, reason string"), spark.createDataFrame([(1, "timestamp=1.0-2.0"), (2, "timestamp=1.0-2.0"), (2, "no time"), (3, "none")], "answer_id long, tag string"))
    assert {r["answer_id"]: (r["ok"], r["reason"]) for r in judged.collect()} == {1: (True, "fine"), 2: (False, "evidence without time"), 3: (False, "short")}
    items = said.payload(rows.selectExpr("answer_id as query_id", "place", "place as segment_id", "start_sec", "end_sec", "0.5D as score", "text"))
    assert {r["query_id"]: (len(r["items"]), len(r["evidence_tags"])) for r in items.collect()} == {1: (3, 3), 2: (1, 1)}


def test_gates_of_candidates(spark):
    rows = [("a", "dpo", True, True), ("a", "sft", True, False), ("b", "dpo", True, False), ("b", "sft", True, False), ("c", "dpo", False, True), ("c", "sft", False, False)]
    got = said.choose_adapter(spark.createDataFrame(rows, "experiment string, kind string, validated boolean, preference_passed boolean"))
    assert {r["experiment"]: r["selected"] for r in got.collect()} == {"a": "dpo", "b": "sft", "c": None}
    fields = "sweep_id int, source_sha256 string, candidates int, frozen_seen boolean, same_spec boolean, final_skipped boolean, final_preference double, final_dev double, validated boolean, passed int, cases int, runs int, dev_std double"
    good = [1, "ab", 8, False, True, False, 1.0, 1.0, True, 5, 5, 3, 0.0]
    bad = {1: ("", "no source fingerprint"), 2: (7, "too few candidates"), 3: (True, "frozen test seen"), 4: (False, "specs differ"), 5: (True, "frozen preference"), 6: (0.9, "frozen preference"), 7: (0.5, "dev preference"), 8: (False, "product comparison"), 9: (4, "regression"), 11: (2, "seeds"), 12: (0.1, "seeds")}
    rows = [good] + [[100 + i, *good[1:i], v, *good[i + 1 :]] for i, (v, _) in bad.items()] + [[200] + [None] * 12]
    got = {}
    for r in said.sweep_failures(spark.createDataFrame(rows, fields)).collect():
        got.setdefault(r["sweep_id"], []).append(r["failure"])
    assert got.pop(200) == ["no source fingerprint", "too few candidates", "frozen test seen", "specs differ", "frozen preference", "dev preference", "product comparison", "regression", "seeds"]
    assert got == {100 + i: [name] for i, (_, name) in bad.items()}
    empty = spark.createDataFrame([], "split string, label double")
    assert [r["failure"] for r in said.supervision_failures(empty).collect()] == ["empty"]


def test_manifest_has_sixteen_fields(spark):
    meta = json.dumps({"agent_run": {"mode": "plan"}, "vlm": {"backend": "v"}, "query_intent": {"kind": "locate"}, "source_sha256": "ab"})
    pack = spark.createDataFrame([("v.mp4", 3.5, [1, 2], [1], "sum", meta)], "video_path string, duration_sec double, segments array<int>, clips array<int>, summary string, metadata string")
    row = said.manifest(pack).first().asDict()
    assert len(row) == 16 and (row["num_segments"], row["num_clips"], row["agent_mode"], row["vlm_backend"], row["query_intent"], row["source_sha256"], row["asr_backend"]) == (2, 1, "plan", "v", '{"kind":"locate"}', "ab", None)
