"""Findings of the third round: ties, texts kept out of rankings, sizes of plans."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import datasets, memory, retrieve
from lodestrata.plans import catalog


def test_fastest_of_equal_latencies_is_the_smallest_variant(spark):
    rows = [(i, 0.5 if i in (3, 7, 9) else float(i + 1), True) for i in range(9, -1, -1)] + [(1, None, True), (0, 0.1, False), (None, 0.5, True)]
    runs = spark.createDataFrame(rows, "variant long, latency double, verified boolean")
    for n in (1, 4):
        got = datasets.fastest_verified(runs.repartition(n).sortWithinPartitions(F.desc("variant"))).first()
        assert (got["variant"], got["latency"]) == (3, 0.5)


DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["context_pack", "context_pack_whole", "gate_evidence", "gate_structured", "ctx_prompt", "score_examples", "select_evidence"])
def test_texts_take_no_part_in_rankings(spark, name):
    """Candidates are ranked into a table of numbers; texts meet only the few that were chosen, so no ranking is left in the plan
    that has the texts (select_evidence ends with a ranking of what it chose, and has none)."""
    plan = _plan(catalog.QUERIES[name](spark, DIR))
    assert "text#" not in plan or "Window" not in plan


def test_counted_words_agree_with_candidates(spark):
    texts = spark.createDataFrame([("a", 1, "Cola 可乐好喝 and water"), ("a", 2, None), ("b", 3, "cola cola"), (None, 4, "cola")], "asset string, segment_id long, text string")
    asked = spark.createDataFrame([(1, "a", "cola water tea"), (2, "a", ""), (3, "c", "cola")], "query_id long, asset string, query string")
    got = {(r["query_id"], r["segment_id"]): (r["hits"], r["n_terms"], r["text_len"]) for r in retrieve.counted(texts, asked).collect()}
    assert got == {(1, 1): (2, 3, 19), (1, 2): (0, 3, 0), (2, 1): (0, 0, 19), (2, 2): (0, 0, 0)}


def test_words_are_counted_without_a_shuffle(spark):
    texts = spark.createDataFrame([("a", 1, "cola cola tea 可乐好"), ("a", 2, None), (None, 3, "tea")], "asset string, segment_id long, text string")
    counted = retrieve.term_counts(texts)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counted.collect()), key=str) == sorted([("a", 1, "cola", 2), ("a", 1, "tea", 1), ("a", 1, "可乐", 1), ("a", 1, "乐好", 1), (None, 3, "tea", 1)], key=str)


def test_texts_are_dealt_once_for_their_keywords(spark):
    rows = spark.createDataFrame([(1, "b a b c"), (1, "bb aa bb"), (2, None), (3, "zz yy zz yy")], "doc_id long, text string")
    found = memory.top_keywords(rows, ["doc_id"], k=2)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["doc_id"]: r["keywords"] for r in found.collect()} == {1: ["bb", "aa"], 3: ["zz", "yy"]}


def test_dense_search_in_blocks_keeps_ties_and_odd_vectors(spark):
    """More copies of a vector than k, vectors with nulls, of other lengths and of length zero, against every pair one by one."""
    some = [[float((i * j) % 7 - 3) for j in range(1, 5)] for i in range(1, 9)]
    rows = [(i, "x", some[i % 8]) for i in range(60)] + [(100, "x", [1.0, None, 2.0, 0.5]), (101, "x", [1.0, 2.0]), (102, "x", [0.0] * 4), (103, "y", some[0]), (104, None, some[0]), (105, "x", None)]
    v = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    asked = v.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query"))
    u = v.filter("embedding is not null").select("vec_id", "label", retrieve.unit(F.col("embedding")).alias("v"))
    q = asked.filter("query is not null").select("query_id", "label", retrieve.unit(F.col("query")).alias("q"))
    every = u.join(q, "label").filter(F.size("v") == F.size("q")).select("query_id", "vec_id", F.round(retrieve.dot(F.col("v"), F.col("q")), 9).alias("score"))
    want = retrieve.top_k(every, ["query_id"], [F.desc("score"), F.asc("vec_id")], 3)
    found = retrieve.dense_top_k(v, asked, 3)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
