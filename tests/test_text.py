import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as tx


@pytest.fixture(scope="module")
def one(spark):
    return lambda column, value: spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "Hello a WORLD 42 x9", "比较可乐 ok 三四五", "é à B52—c3", None])
def test_tokens_agree_with_plain_python(one, text):
    assert one(tx.tokens, text) == (None if text is None else _tokens(text))


def _tokens(text):
    out = []
    for t in re.findall("[a-zA-Z0-9]+|[一-鿿]+", text.lower()):
        if re.fullmatch("[一-鿿]+", t):
            out += [t] if len(t) <= 2 else [t[i : i + 2] for i in range(len(t) - 1)]
        elif len(t) > 1:
            out.append(t)
    return out


def test_informative_leaves_generic_terms_out(one):
    assert one(tx.informative, "这个视频 可乐 what cola") == ["可乐", "what", "cola"]


def test_sentences(one):
    assert one(tx.sentences, "One. Two!\n\n三。四") == ["One.", "Two!", "三。", "四"]


def test_times(one):
    assert one(tx.time_references, "a (timestamp=1.0-2.5) b timestamp=3-4") == ["1.0-2.5", "3-4"]
    assert tuple(one(tx.time_key, "1.0-2.5")) == (1.0, 2.5)
    assert [tuple(x) for x in one(tx.time_ranges, "1–2, 5-4, 1 - 2")] == [(1.0, 2.0)]
    assert one(tx.clock, "01:02:03,500") == 3723.5
    assert one(tx.clock, "02:03") == 123.0
    assert one(tx.clock, "x") is None


def test_claims(one):
    assert one(lambda c: tx.clauses(tx.claim_line(c)), "- 结论：男子戴着眼罩，喝可乐 (timestamp=1.0-2.0)") == ["男子戴着眼罩"]
    assert set(one(tx.units, "展示 blue-cup 眼罩佩戴")) == {"blue-cup", "眼罩", "罩佩", "佩戴"}


def test_support(spark):
    df = spark.createDataFrame([("喝了一口可乐", "他喝了一口可乐。"), ("blue cup on desk", "a red cup"), ("x", "y")], "c string, e string")
    assert [round(r["s"], 3) for r in df.select(tx.support(F.col("c"), F.col("e")).alias("s")).collect()] == [1.0, 0.25, 0.0]


def test_lists_and_numbers(spark):
    df = spark.createDataFrame([([" a", "b", "a ", "", None, "c" * 200],)], "v array<string>")
    assert df.select(tx.string_list(F.col("v")).alias("v")).first()["v"] == ["a", "b", "c" * 160]
    df = spark.createDataFrame([("0.4",), ("7",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(tx.unit_interval(F.col("v"))).collect()] == [0.4, 1.0, 0.0, 0.0]


def test_model_reply(one):
    got = one(lambda c: tx.model_json(c, "summary string, entities array<string>"), '<think>no</think>```json\n{"summary": "s", "entities": ["a"]}\n```')
    assert got["summary"] == "s" and got["entities"] == ["a"]
