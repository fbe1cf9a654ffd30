import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import replies
from lodestrata.operators import segment, verify
from lodestrata.plans import answering

GOOD = {"summary": " A red boat leaves. ", "ocr_text": "PIER 4", "entities": ["boat", "pier", " boat ", ""], "actions": "leaves", "scene": "harbour", "confidence": 1.4, "uncertainties": None}
EMPTY = dict(ocr_text="", scene="", entities=[], actions=[], uncertainties=[], confidence=0.0)


def want(**fields):
    return EMPTY | fields


BOAT = want(summary="A red boat leaves.", ocr_text="PIER 4", entities=["boat", "pier"], actions=["leaves"], scene="harbour", confidence=1.0)
BROKEN = '{"summary": "inner \\"said\\"\\nline", "ocr_text": [bad, "entities": ["x", "y\\"z"], "confidence": 0.9'
CASES = [
    (json.dumps(GOOD), BOAT),
    (f"<think>{{\"summary\": \"no\"}}</think>\n```JSON\n{json.dumps(GOOD)}\n```", BOAT),
    (f"Here it is: {json.dumps(GOOD)} I hope it helps", BOAT),
    # Cut off: fields that are whole are kept, the mark of a failed reading stays, its confidence does not.
    ('{"summary": "seen", "scene": "pier", "entities": ["a", "b"], "actions": ["half', want(summary="seen", scene="pier", entities=["a", "b"], uncertainties=[replies.NO_JSON])),
    ('{"scene": "pier", "summary": "half of', want(summary='{"scene": "pier", "summary": "half of', uncertainties=[replies.NO_JSON], confidence=0.35)),
    # JSON as text inside JSON: what the outer one says itself comes first, but for the confidence of a failed reading.
    (json.dumps({"summary": BROKEN, "confidence": 0.35, "scene": "outer", "actions": []}), want(summary='inner "said"\nline', entities=["x", 'y"z'], scene="outer", confidence=0.9)),
    (json.dumps({"summary": BROKEN, "confidence": 0.2}), want(summary='inner "said"\nline', entities=["x", 'y"z'], confidence=0.2)),
    ("only words", want(summary="only words", uncertainties=[replies.NO_JSON], confidence=0.35)),
    ("[1, 2]", want(summary="[1, 2]", uncertainties=[replies.NO_JSON], confidence=0.35)),
    ('{"summary": 5, "confidence": "nan", "entities": [1, null, true]}', want(summary="5", entities=["1", "true"])),
    ("{}", want(summary="")),
    ("", None),
    ("  <think>just thoughts</think> ", None),
    (None, None),
    (json.dumps({"summary": "s" * 5000, "ocr_text": "o" * 5000, "scene": "c" * 500, "entities": [f"{i}" + "e" * 300 for i in range(40)]}), want(summary="s" * 1200, ocr_text="o" * 2400, scene="c" * 240, entities=[(f"{i}" + "e" * 300)[:160] for i in range(20)])),
    ('{"summary": "' + "long \\\\ " * 40_000 + '", "entities": ["cut', want(summary=("{\"summary\": \"" + "long \\\\ " * 40_000)[:1200].strip(), uncertainties=[replies.NO_JSON], confidence=0.35)),
]


def test_replies_of_every_form(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(CASES)], "id long, reply string")
    got = {r["id"]: r["x"] and r["x"].asDict() for r in df.select("id", replies.normalise(F.col("reply")).alias("x")).collect()}
    for i, (reply, fields) in enumerate(CASES):
        assert got[i] == fields, reply and reply[:100]


def test_long_broken_strings_do_not_exhaust_the_stack(spark):
    inner = '{"summary": "' + "word \\\\n " * 100_000 + '", "entities": [oops'
    df = spark.createDataFrame([(json.dumps({"summary": inner}),)], "reply string")
    r = df.select(replies.normalise(F.col("reply")).alias("x")).first()["x"]
    assert r["summary"].startswith("word \\n word") and len(r["summary"]) <= 1200 and r["entities"] == []


def test_described_segments(spark):
    segments = spark.createDataFrame([(1, "a", 0.0, 5.0, "old"), (2, "a", 5.0, 9.0, "kept"), (3, "a", 9.0, 12.0, "stays")], "segment_id long, asset string, start_sec double, end_sec double, text string")
    said = spark.createDataFrame([(1, "short"), (1, json.dumps(GOOD)), (2, None), (3, "{}"), (9, "nothing there")], "segment_id long, reply string")
    got = {r["segment_id"]: r for r in segment.described(segments, said).collect()}
    assert len(got) == 3
    assert got[1]["text"] == "A red boat leaves. 场景：harbour 人物与物体：boat、pier 动作与变化：leaves" and got[1]["structured"] == "A red boat leaves. PIER 4 harbour boat pier leaves" and got[1]["confidence"] == 1.0
    assert (got[2]["text"], got[2]["structured"], got[2]["caption"]) == ("kept", None, None)
    assert (got[3]["text"], got[3]["structured"], got[3]["caption"]) == ("stays", None, "")


def test_structured_rule_through_the_whole_plan(spark):
    """A question about a stage with two concepts that only the fields of replies name."""
    rows = [(i, "show", i * 60.0, i * 60.0 + 60, f"第{i}段 普通的画面", 10.0, 5.0, 1.0, 0.01) for i in range(10)]
    segments = spark.createDataFrame(rows, "segment_id long, asset string, start_sec double, end_sec double, text string, brightness double, contrast double, motion double, vlm_score double")
    asked = spark.createDataFrame([(1, "show", "开头他戴着眼罩喝的是什么饮料？")], "query_id long, asset string, query string")
    said = spark.createDataFrame([(0, json.dumps({"summary": "一个人蒙眼坐着", "entities": ["吸管"], "actions": ["猜测"]}))], "segment_id long, reply string")
    without = answering.answer(segments, asked).first()
    told = segment.described(segments, said)
    kept = told.drop("text").join(segments.select("segment_id", "text"), "segment_id")  # texts as before, so that fields alone decide
    r = answering.answer(kept, asked).first()
    assert without["gate_reason"] != "structured" and (r["gate_reason"], r["sufficient"]) == ("structured", True)


@pytest.mark.parametrize("structured,reason", [("戴着 饮料", "structured"), ("饮料", "insufficient"), ("", "insufficient"), (None, "insufficient")])
def test_structured_rule(spark, structured, reason):
    row = [(1, 1, 7, "开头戴着眼罩喝了什么饮料呢", "别的内容", structured, 0.0, "stage", "stage_local")]
    items = spark.createDataFrame(row, "query_id long, place int, segment_id long, query string, text string, structured string, vlm_score double, kind string, coverage_mode string")
    assert verify.evidence_gate(items).first()["reason"] == reason
