"""Rows that agree in id and text share a key, others don't, and repeated rows cost as much as any."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import embeddings, minhash, substring, suffix
from lodestrata.llm.common import KEY, Scratch, keyed, row_keys


def test_keys_tell_nulls_from_values_and_places(spark):
    rows = [("a", None), (None, "a"), (None, None), ("", "a"), ("a", ""), ("", ""), ("ab", "c"), ("a", "bc"), ("a", "a")]
    df = spark.createDataFrame(rows, "id string, text string")
    found = df.select(F.struct(*row_keys("id", "text")).alias("k")).collect()
    assert len({tuple(r["k"]) for r in found}) == len(rows)
    assert len({r["k"][0] for r in found} | {r["k"][1] for r in found}) == 2 * len(rows)
    assert keyed(df.withColumn("ROW_KEY", F.lit(1)), "id")[1] == ["row_key_", "row_key_too"]


def test_operators_on_string_ids_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [("a", None), (None, "a"), (None, None), ("", "a"), ("a", ""), ("x", long), (None, long), ("y", f"lead {long}")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = Counter((r["doc_id"], r["text"], r["n_shingles"]) for r in minhash.near_duplicates(df).collect())
    assert got == Counter((i, t, 0 if not t else 1 if t == "a" else 56 if t == long else 57) for i, t in rows)
    lean = Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert lean == Counter((i, t, len((t or "").split()), 60 if t and long in t else 0) for i, t in rows)
    cut = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in suffix.remove_repeats(df).collect())
    # The two bare copies match with each other as a whole, the third from its space on.
    assert cut == Counter((i, t, len(long) if t and long in t else 0) for i, t in rows)


def test_vectors_with_null_and_string_ids(spark):
    rows = [(None, [1.0, 0.0], "a"), ("p", [1.0, 0.0], "a"), ("p", [1.0, 0.0], "a"), ("q", [1.0, 0.01], "a"), ("r", [1.0, 0.0], None), ("s", None, "a"), ("t", [1.0, 0.0], "b"), (None, [0.0, 1.0], "b")]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string").withColumn("usable", F.lit("mine"))
    out = embeddings.near_duplicates(df)
    assert out.columns == ["vec_id", "embedding", "label", "usable", "n_links", "component_id", "kept"]
    got = Counter((r["vec_id"], r["label"], r["n_links"], r["component_id"], r["kept"], r["usable"]) for r in out.collect())
    assert got == Counter([(None, "a", 3, "p", False, "mine"), ("p", "a", 3, "p", True, "mine"), ("p", "a", 3, "p", True, "mine"), ("q", "a", 3, "p", False, "mine"), ("r", None, 0, "r", True, "mine"), ("s", "a", 0, "s", True, "mine"), ("t", "b", 0, "t", True, "mine"), (None, "b", 0, None, True, "mine")])


def _spans(spark, module, copies, window, gram):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    df = spark.range(copies).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    own, key = keyed(df, "doc_id", "text")
    return module.repeated_spans(own, key, "text", window, gram, Scratch(spark, "copies")).select(F.size("spans").alias("n")).collect()


@pytest.mark.parametrize("module,window,gram", [(substring, 35, 8), (suffix, 200, 64)])
def test_cells_of_repeated_rows_do_not_grow(spark, module, window, gram):
    few, many = _spans(spark, module, 2, window, gram), _spans(spark, module, 3000, window, gram)
    assert len(few) == len(many) == 1 and few == many


@pytest.mark.parametrize("operator,words", [(substring, True), (suffix, False)])
def test_three_thousand_equal_rows(spark, operator, words):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(1, "alone " * 3)], "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_removed"]) for r in operator.remove_repeats(df).select("doc_id", "n_removed").collect())
    assert got == Counter({(None, 80 if words else len(text)): 3000, (1, 0): 1})


def test_equal_rows_are_one_class(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    got = minhash.near_duplicates(df).groupBy("n_shingles", "component_id", "kept").count().collect()
    assert [tuple(r) for r in got] == [(2, None, True, 3000)]
    assert KEY == ["k", "k2"]
