import math
from collections import Counter

from pyspark.sql import functions as F
from test_dedup import groups, shingles, words

import corpus_pipeline
from lodestrata.llm import queries


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, "/root/testdata/sf0.001")
        if name != "sequences":
            assert kept.columns == docs.columns
            kept = kept.persist()
            assert kept.count() > 0
        if name in ("language", "near_duplicates"):
            assert kept.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert {r["doc_id"] for r in kept.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").distinct().collect()}


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, "en", "a", 0), (None, "the cat sat on the mat", None, None, 3), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "the cat and the dog", "en", "b", None), (3, "the cat and the dog", "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    docs.collect()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in queries.queries()} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on all that the one before it kept, over the smallest documents with clashing columns beside."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kept", F.lit("mine")).withColumn("score", F.col("doc_id") * 2).withColumn("copy", F.lit("c"))
    stages = dict(corpus_pipeline.STAGES)

    def step(name, rows):
        stages[name](spark, rows, "").write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sequences":
            assert out.columns == docs.columns
            assert out.filter("kept <> 'mine' or score <> doc_id * 2 or copy <> 'c'").count() == 0
        return out, [r.asDict() for r in out.collect()]

    given = {r["doc_id"]: r for r in docs.collect()}
    spoken, rows = step("language", docs)
    texts = {r["doc_id"]: r["text"] for r in rows}
    letter = {i for i, r in given.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    clean = {i for i in letter if given[i]["lang"] and len(given[i]["text"].split()) >= 20}
    assert set(texts) <= letter and len(clean - set(texts)) <= 0.02 * len(clean)
    assert all(texts[i] == given[i]["text"] for i in texts)

    unique, rows = step("near_duplicates", spoken)
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    root = groups(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert sorted(r["doc_id"] for r in rows) == sorted({i for i in root if root[i] == i}) and len(rows) < len(texts)

    lean, found = step("passages", unique)
    split = {r["doc_id"]: words(r["text"]) for r in rows}
    count = Counter(tuple(w[i : i + 50]) for w in split.values() for i in range(len(w) - 49))
    for r in found:
        w = split[r["doc_id"]]
        gone = {p for s in range(len(w) - 49) if count[tuple(w[s : s + 50])] > 1 for p in range(s, s + 50)}
        want = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else texts[r["doc_id"]]
        assert r["text"] == want and r["n_chars"] == len(want)

    mixed, copies = step("mix", lean)
    assert {r["doc_id"]: r["text"] for r in copies}.items() <= {r["doc_id"]: r["text"] for r in found}.items()
    size, after = Counter(r["source"] for r in found), Counter(r["source"] for r in copies)
    share = {s: math.sqrt(n) for s, n in size.items()}
    big = max(size, key=size.get)
    assert abs(after[big] / sum(after.values()) - share[big] / sum(share.values())) < 0.5 * size[big] / sum(size.values())

    _, packed = step("sequences", mixed)
    number = Counter(r["doc_id"] for r in copies)
    length = {r["doc_id"]: len(words(r["text"])) + 1 for r in copies}
    total = Counter()
    bins = {}
    for r in packed:
        total[r["doc_id"]] += r["n_tokens"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert total == Counter({i: n * length[i] for i, n in number.items()})
    for items in bins.values():
        assert sum(r["n_tokens"] for r in items) <= 2048
        assert len({r["source"] for r in items}) == len({r["cluster"] for r in items}) == len(items)
