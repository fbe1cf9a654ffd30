import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import langid, lm, mixing, quality, tokencount

ROWS = [(1, "the cat sat on the mat. the cat ran"), (2, "THE dog sat"), (3, ""), (4, None), (5, "a\x0bb  c\n\nd"), (6, "the cat sat on the mat. the cat ran"), (7, "é " * 50), (None, "the end")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2).withColumn("score", F.lit("x"))


@pytest.mark.parametrize("order,size", [(1, 1 << 20), (2, 40), (3, 40)])
def test_language_model_against_plain_python(spark, docs, order, size):
    train = {1, 2, 5, 6, None}
    got = lm.score(docs, F.coalesce(F.col("doc_id").isin(1, 2, 5, 6), F.lit(True)), order=order, prior=3.0, block_bytes=size).collect()
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in ROWS}
    counts = Counter()
    for i in train:
        w = ["<s>"] * (order - 1) + toks[i]
        counts[("<s>",) * 1] += 1
        for n in range(len(toks[i])):
            for k in range(1, order + 1):
                counts[(k, tuple(w[n + order - k : n + order]))] += 1
    N, V = sum(len(toks[i]) for i in train), len({x for i in train for x in toks[i]})
    assert len(got) == len(ROWS)
    for r in got:
        w = ["<s>"] * (order - 1) + toks[r["doc_id"]]
        base = total = 0
        for n in range(order - 1, len(w)):
            p = q = (counts[(1, (w[n],))] + 0.1) / (N + 0.1 * (V + 1))
            for k in range(2, order + 1):
                h = tuple(w[n - k + 1 : n])
                seen = len(train) if set(h) == {"<s>"} else counts[(k - 1, h)] if "<s>" not in h else sum(toks[i][: len([x for x in h if x != "<s>"])] == [x for x in h if x != "<s>"] for i in train)
                p = (counts[(k, (*h, w[n]))] + 3 * p) / (seen + 3)
            base += math.log10(q)
            total += math.log10(p)
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(toks[r["doc_id"]]), N, sum(counts[(1, (x,))] > 0 for x in toks[r["doc_id"]]))
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(total)
        assert r["held_out"] == (r["doc_id"] not in train)


def test_language_model_of_nothing(spark, docs):
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    assert {r["train_tokens"] for r in lm.score(docs, F.lit(False)).collect()} == {0}


def test_states_sum_to_one():
    """The arcs of a state and its failure arc add up to one over all words and the unseen one."""
    texts = ["a b a c", "a b b"]
    words, first = lm.tokens(texts)
    keys, counts = np.unique(np.concatenate([*lm.grams(words, first, 2)[0], [lm._START & ~np.uint64(1)]]), return_counts=True)
    counts = counts.astype(np.uint64)
    counts[np.searchsorted(keys, lm._START & ~np.uint64(1))] = 2
    total = 0
    for w in ("a", "b", "c", "unseen", None):
        t, f = lm.tokens([f"a {w}"] if w else ["a"])
        all_keys = np.unique(np.concatenate([*lm.grams(t, f, 2)[0], [lm._START & ~np.uint64(1)]]))
        at = np.searchsorted(keys, all_keys).clip(0, len(keys) - 1)
        c = np.where(keys[at] == all_keys, counts[at], 0)
        full = lm.walk(t, f, all_keys, c, 2, 9, 4, 3.0)[3][0]
        alone, g = lm.tokens(["a"])
        n = 2
        p = []
        for stop in (1, n):
            sub, one = t[:stop], f
            k = np.unique(np.concatenate([*lm.grams(sub, one, 2)[0], [lm._START & ~np.uint64(1)]]))
            j = np.searchsorted(keys, k).clip(0, len(keys) - 1)
            p.append(lm.walk(sub, one, k, np.where(keys[j] == k, counts[j], 0), 2, 9, 4, 3.0)[3][0])
        total += 10 ** (p[1] - p[0])
        assert full <= 0
    assert total == pytest.approx(1.0)


def test_language_codes_are_exact():
    """Code lengths from the tables equal a walk of the tree, and the model separates languages held out from it."""
    samples = {"x": [b"the cat and the hat", b"that is the one"], "y": [b"le chat et la ville", b"une belle ville"]}
    model = langid.Model(samples, order=3)
    for text in (b"the hat", b"la belle", b"zq\xc3\xa9", b""):
        data = np.frombuffer(text, np.uint8)
        got = model.code_lengths(data, np.array([0, len(data)]))[0]
        for j, name in enumerate(model.languages):
            want = 0.0
            for i in range(len(text)):
                want += walk(samples[name], (b"\n" * 3 + text)[: i + 3], text[i], 3)
            assert got[j] == pytest.approx(want, rel=1e-5)
    assert model.code_lengths(np.frombuffer(b"that hat", np.uint8), np.array([0, 8])).argmin() == 0


def walk(texts, before, byte, order):
    def follow(c):
        seen = Counter()
        for t in texts:
            full = b"\n" * order + t
            for i in range(order, len(full)):
                if full[i - len(c) : i] == c:
                    seen[full[i]] += 1
        return seen

    def bits(c, x):
        seen = follow(c)
        shorter = (lambda y: bits(c[1:], y)) if c else (lambda y: 8.0)
        if not seen:
            return shorter(x)
        n, t = sum(seen.values()), len(seen)
        if seen[x]:
            return -math.log2(seen[x] / (n + t))
        left = 1 - sum(2 ** -shorter(y) for y in seen)
        return -math.log2(t / (n + t)) + math.log2(max(left, 1e-6)) + shorter(x)

    return bits(before[-order:], byte)


def test_identify_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", None), (5, "12 34 !!", "en"), (6, "THE CAT", None), (1, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in langid.identify(df, langid.fit(df.filter("doc_id < 6"))).collect())
    assert [g[:2] for g in got] == [(1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]
    assert all(0 <= g[2] <= 1 for g in got)
    assert langid.identify(df, langid.fit(df.limit(0))).filter("lang_pred = 'und'").count() == 7


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    right = got.filter("lang = lang_pred").count()
    assert right >= 0.95 * got.count() > 0
    assert [r["held_out"] for r in docs.select("doc_id", langid.held_out().alias("held_out")).orderBy("doc_id").limit(5).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(5)]


def test_language_sample_survives_copies_and_long_texts(spark, monkeypatch):
    """Copies count once, a text that does not fit is passed over, and no language falls out of the model."""
    taken = {}
    monkeypatch.setattr(langid, "Model", lambda samples, order=4: taken.update(samples))
    rows = [(f"copy of {name}", name) for name in "abcdefgh" for _ in range(2000)] + [(f"text {i} of a", "a") for i in range(30)] + [("long " * 100, "a"), ("y" * 300, "only_long"), ("x" * 200, "only_long")]
    df = spark.createDataFrame(rows, "text string, lang string")
    langid.fit(df, docs=600, size=10_000)
    assert {k: len(v) for k, v in taken.items()} == {**dict.fromkeys("bcdefgh", 1), "a": 32, "only_long": 2}
    taken.clear()
    langid.fit(df, docs=600, size=150)
    assert set(taken) == {*"abcdefgh", "only_long"} and taken["only_long"] == [b"x" * 200]
    assert 138 <= sum(map(len, taken["a"])) <= 150 and all(len(set(v)) == len(v) for v in taken.values())
    taken.clear()
    langid.fit(df, docs=2, size=10_000)
    assert {k: len(v) for k, v in taken.items()} == {**dict.fromkeys("bcdefgh", 1), "a": 2, "only_long": 2}


def test_mixing_draws_by_inversion(spark):
    rows = [(i, f"s{0 if i < 60 else i % 3}" if i % 10 else None) for i in range(100)] + [(None, "s0"), (5, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("parts", F.lit(1)).withColumn("cdf", F.lit(2)).withColumn("copy", F.lit(0))
    n = Counter(s for _, s in rows)
    weight = sum(math.sqrt(x) for x in n.values())
    want = Counter()
    for i, s in rows:
        rate = math.sqrt(n[s]) * len(rows) / (weight * n[s])
        u = int(hashlib.md5(f"17|{'' if i is None else i}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want[(i, s)] += k
    got = mixing.replicate(df).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == +want
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    assert {r["parts"] for r in got} == {1}


def test_mixing_large_rates_and_weights(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(60)], "doc_id long, source string")
    got = Counter(r["source"] for r in mixing.replicate(df, weights={"a": 1.0}, total=4000.0).collect())
    assert set(got) == {"a"} and abs(got["a"] - 4000) < 5 * math.sqrt(4000)
    assert mixing.replicate(df.limit(0)).count() == 0 and mixing.replicate(df, weights={}).count() == 0


def test_token_counts(spark, docs):
    enc = tokencount.encoder(open(tokencount.VOCABULARY, "rb").read())
    lengths = [len(enc.encode_ordinary(t or "")) for _, t in ROWS]
    hist = tokencount.digest(docs)
    for r in hist.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["docs_at_most"], r["total_truncated"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(x <= n for x in lengths), sum(min(x, n) for x in lengths))
    assert {r["limit"]: r["total"] for r in tokencount.truncated_totals(hist, [0, 3, 7, 10**6]).collect()} == {k: sum(min(x, k) for x in lengths) for k in (0, 3, 7, 10**6)}
    assert {r["share"]: r["n_tokens"] for r in tokencount.quantiles(hist, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[len(lengths) // 2 - 1], 1.0: max(lengths)}
    assert tokencount.digest(docs.limit(0)).count() == 0


def test_quality_counts_against_plain_python(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c dd É x# | $").strip() for _ in range(rng.randint(0, 80))) for _ in range(40)] + ["a\nb\na\n \n \nb", "x y z x y z x y z", "a a a a", "a a a", None, "", "\x0b\x0c", "l1 w\nl1 w\nl1 w"]
    got = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_learns_a_rule_and_keeps_the_rest(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word().upper() if i % 4 == 0 else word() for _ in range(60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(90)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert got == {i: i % 4 != 0 for i in range(120)}
    assert quality.judge(docs, labels.limit(0)).filter("kept").count() == 120
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_finds_a_thin_tail_beside_a_broad_imprecise_sign(spark):
    """1 % of the rows are bad by the extreme of one statistic; another statistic tells more bad rows, but never well enough."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        thin = i % 100 == 0
        noisy = rng.random() < 0.3
        bad = thin or (noisy and rng.random() < 0.6)
        rows.append((1.0 if thin else rng.random() * 0.9, (5.0 if noisy else 0.0) + rng.random(), bad, i % 3 > 0))
    df = spark.createDataFrame(rows, "a double, b double, bad boolean, fold boolean")
    rules = quality.learn(df, features=["a", "b"])
    assert len(rules) == 1
    caught = [r for r in rows if all((r["ab".index(f)] <= t) if op == "<=" else (r["ab".index(f)] > t) for f, op, t in rules[0])]
    assert sum(r[0] == 1.0 for r in caught) == 60 and sum(r[2] for r in caught) >= 0.9 * len(caught)


def test_language_model_deals_equal_rows_to_all_blocks(spark):
    """A partition of one repeated row is many blocks, and summing a range in steps changes nothing."""
    rows = spark.range(400).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one row said again " * 5).alias("text")).coalesce(1)
    got = lm.score(rows, F.lit(True), block_bytes=2000).select("n_tokens", "n_known", "train_tokens", F.round("score", 6).alias("score")).distinct().collect()
    assert len(got) == 1 and got[0]["train_tokens"] == 400 * 21
    sent = rows.select(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(20)).alias("b")).groupBy("b").count().collect()
    assert len(sent) == 20 and max(r["count"] for r in sent) < 60


def test_ranges_summed_in_steps(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(6)
    keys = [np.unique(rng.integers(0, 3000, 700).astype(np.uint64) * np.uint64(2**51) + np.uint64(1)) for _ in range(9)]
    counts = [rng.integers(0, 400, len(k)).astype(np.uint64) for k in keys]
    pdf = pd.DataFrame([(i, 4, k.tobytes(), *lm._small(c)) for i, (k, c) in enumerate(zip(keys, counts))], columns=["block", "part", "keys", "low", "high"])
    whole = lm._sum(pdf)
    monkeypatch.setattr(lm, "SUMMED", 50)
    assert lm._sum(pdf).equals(whole)
    total = Counter()
    for k, c in zip(keys, counts):
        for x, n in zip(k.tolist(), c.tolist()):
            total[x] += n
    for i, (k, r) in enumerate(zip(keys, whole.itertuples())):
        assert lm._counts([r.low], [r.high]).tolist() == [total[x] for x in k.tolist()]
    assert (whole.iloc[-1]["all_tokens"], whole.iloc[-1]["kinds"]) == (sum(total.values()), sum(n > 0 for n in total.values()))


def test_rows_sent_grow_with_the_blocks(monkeypatch):
    """From RANGES * 2 blocks on a block sends as many rows as before, in one batch."""
    monkeypatch.setattr(lm, "RANGES", 16)
    text = [" ".join(f"w{i}" for i in range(300))]
    words, first = lm.tokens(text)
    vocab, index = np.unique(words, return_inverse=True)
    import pyarrow as pa

    def rows(blocks):
        bits = (min(max(1, blocks // 2), max(lm.RANGES, blocks // 16)) - 1).bit_length()
        one = pa.RecordBatch.from_arrays([pa.array([1]), *(pa.array([x], pa.binary()) for x in (np.ones(1, bool).tobytes(), first.astype(np.int64).tobytes(), vocab.tobytes(), index.astype(np.uint16).tobytes()))], ["block", "train", "first", "vocab", "index"])
        sent = [b for w in range(lm.WAVES) for b in lm._send(3, bits, w)([one])]
        assert len(sent) <= lm.WAVES
        return blocks * sum(b.num_rows for b in sent)

    assert rows(40) * 4 == rows(160)
