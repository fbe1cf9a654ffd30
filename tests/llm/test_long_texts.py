"""Texts far longer than a piece, a slice or a batch; repeated rows, null ids and clashing columns where other tests lack them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, langid, lm, minhash, mixing, packing, quality, substring, suffix, tokencount


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(12)
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(9999)) for _ in range(400_000))  # about 2.6 MB


@pytest.fixture(scope="module")
def docs(spark, long_text):
    words = long_text.split()
    near = " ".join([*words[:1000], "CHANGED", *words[1001:]])
    passage = " ".join(words[200_000:200_060])
    rows = [(1, long_text), (2, near), (3, f"start {passage} end"), (4, "short one"), (None, long_text)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_words_of_a_long_text_are_hashed_in_parts(monkeypatch):
    text = (" ".join(random.Random(1).choice(["a", "bb", "C" * 90, "é"]) for _ in range(500))).encode()
    data = np.frombuffer(text, np.uint8)
    s, e, _ = common.word_bounds(data, np.array([0, len(data)]))
    whole = common.word_hashes(data, s, e, True)
    monkeypatch.setattr(common, "CHUNK_BYTES", 16)
    assert np.array_equal(common.word_hashes(data, s, e, True), whole)


def test_code_lengths_by_slices(monkeypatch):
    model = langid.Model({"x": [b"the cat and the hat " * 3], "y": [b"le chat et la ville " * 3]}, order=3)
    texts = [b"the cat sat " * 40, b"", b"la ville et " * 7, b"x"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = model.code_lengths(data, offsets)
    for size in (1, 5, 64):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.allclose(model.code_lengths(data, offsets), whole)


def test_suffix_by_slices(spark, monkeypatch):
    rng = random.Random(4)
    part = bytes(rng.randrange(97, 123) for _ in range(120)).decode()
    noise = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    rows = [(1, noise(700) + part + noise(300)), (2, part[:90]), (3, noise(64) + part), (4, part + part)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r["doc_id"], r["n_removed"], r["lean"]) for r in suffix.remove_repeats(df, length=40, gram=12).collect()}
    monkeypatch.setattr(suffix, "SLICE", 100)
    assert {(r["doc_id"], r["n_removed"], r["lean"]) for r in suffix.remove_repeats(df, length=40, gram=12).collect()} == want
    assert {(i, n) for i, n, _ in want} == {(1, 120), (2, 90), (3, 120), (4, 240)}


def test_long_texts_through_dedup(docs, long_text):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (None, 1, False)}
    lean = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect())
    assert lean == Counter([(1, 400_000, 400_000), (2, 400_000, 399_999), (3, 62, 60), (4, 2, 0), (None, 400_000, 400_000)])


def test_long_texts_through_models(docs, long_text):
    got = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") == 1).collect()}
    assert got[1]["n_tokens"] == got[1]["n_known"] == got[1]["train_tokens"] == 400_001 and got[1]["score"] == pytest.approx(got[None]["score"])
    model = langid.Model({"x": [b"the cat"], "y": [b"le chat"]}, order=2)
    assert {r["doc_id"]: r["lang_pred"] in ("x", "y") for r in langid.identify(docs, model).collect()} == dict.fromkeys([1, 2, 3, 4, None], True)
    counts = {r["doc_id"]: r for r in quality.measure(docs).collect()}
    assert counts[1]["n_words"] == 400_000 and counts[1]["word_chars"] == len(long_text) - 399_999
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokencount.encoded_lengths(docs.withColumn("n_tokens", F.lit("mine"))).collect()}
    assert sizes[1] == sizes[None] > 400_000 > sizes[4] > 0
    pieces = packing.pack(docs.withColumn("source", F.col("doc_id").cast("string"))).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {1: 400_001, 2: 400_001, 3: 63, 4: 3, None: 400_001}


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "one two three four five six", "s", "en")] * 50 + [(None, "other words here", None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("copies", F.lit("mine")).withColumn("shuffle_key", F.lit("mine"))
    mixed = mixing.replicate(df)
    assert {"doc_id", "text", "source"} <= set(mixed.columns) and mixed.count() >= 0
    hist = {r["n_tokens"]: r["n_docs"] for r in tokencount.histogram(tokencount.encoded_lengths(df)).collect()}
    assert sorted(hist.values()) == [30, 50]
    model = langid.fit(df)
    got = langid.identify(df.withColumn("score", F.lit("mine")), model).groupBy("doc_id", "lang_pred").count().collect()
    assert {(r["doc_id"], r["count"]) for r in got} == {(1, 50), (None, 30)}
    assert Counter(r["n_words"] for r in quality.measure(df).collect()) == {6: 50, 3: 30}
