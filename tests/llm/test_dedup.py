import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import embeddings, minhash, packing, substring, suffix
from lodestrata.llm.common import Scratch, components, merge_spans

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1, n=40):
    """Texts with copies, near copies, shared passages, repeats inside a text, odd white space and letters, nulls and empties."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage = prose(80)
    texts = [prose(rng.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 4):
        w = texts[i].split()
        w[len(w) // 2] = "CHANGED"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1], f"{prose(30)} {passage} {prose(5)}", f"{prose(3)}\n\t{passage}", f"{passage} {passage}", "a b c d " * 60, "é ü " * 120, None, None, "", "  \n", "one", "ONE", "one two three"]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumn("K", F.lit("kept")).withColumn("n_words", F.lit(-1)) if extra else df


def words(text):
    return [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = words(fold(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("n", [4, 5])
def test_minhash_against_all_pairs(spark, n):
    rows = corpus()
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows), words=n).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"], r["K"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i, "kept") for i in sets}


def test_minhash_chain_beyond_the_pivot(spark):
    """Copies that each link with a base but not with one another are one component."""
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(300)]
    rows = [(50, " ".join(base))]
    for i in range(12):
        w = list(base)
        for j in range(9):
            w[i * 20 + j * 2] = f"x{i}{j}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_minhash_buckets_of_many_components_and_blocks(spark, monkeypatch):
    """Groups that are close to one another without being linked, in buckets of several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for centre in range(6):
        middle = list(base)
        for j in range(rng.randint(2, 6)):
            middle[centre * 30 + j * 4] = f"c{centre}"
        for _ in range(7):
            w = list(middle)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(200)] = f"n{rng.randrange(1000)}"
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows = list(dict(rows).items())
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    assert 1 < len(set(want.values())) < len(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_minhash_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"], r["kept_"]) for r in minhash.near_duplicates(frame(spark, rows).withColumn("kept_", F.lit("mine"))).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 3, False, "mine")] * 2 + [(3, 2, 3, True, "mine")] * 2 + [(None, 0, None, True, "mine")], key=str)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_fewest_matches_follow_the_posterior():
    steps = minhash.least_matches(64, 0.8, 1e-6, 32)
    assert [n for n, _ in steps] == [32, 64] and 0 < steps[0][1] < 0.8 * 32 and steps[0][1] < steps[1][1] < 0.8 * 64


@pytest.mark.parametrize("window,gram", [(35, 8), (10, 3)])
def test_substring_against_all_windows(spark, window, gram):
    rows = corpus(2)
    count = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    got = {r["doc_id"]: r for r in substring.remove_repeats(frame(spark, rows), window=window, gram=gram).collect()}
    for i, t in rows:
        w = words(t)
        gone = {p for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["lean_text"]) == (len(w), len(gone), None if t is None else " ".join(x for p, x in enumerate(w) if p not in gone))
        assert sum(s["e"] - s["s"] for s in r["spans"]) == len(gone)
    assert sum(r["n_removed"] for r in got.values()) > 100


def test_substring_repeated_rows_and_empty_table(spark):
    rows = [(1, " ".join(WORDS[:50]))] * 2
    assert [r["n_removed"] for r in substring.remove_repeats(frame(spark, rows)).collect()] == [50, 50]
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    assert substring.remove_repeats(frame(spark, [(1, "a")])).first()["n_removed"] == 0


@pytest.mark.parametrize("length,gram", [(60, 20), (200, 64)])
def test_suffix_against_all_strings(spark, monkeypatch, length, gram):
    monkeypatch.setattr(suffix, "PAGE_BYTES", 4000)
    whole = suffix.repeated_positions
    monkeypatch.setattr(suffix, "repeated_positions", lambda *x: whole(*x, range_suffixes=3000))
    rows = corpus(4)
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[p : p + length] for b in raw.values() for p in range(len(b) - length + 1))
    got = {r["doc_id"]: r for r in suffix.remove_repeats(frame(spark, rows), length=length, gram=gram).collect()}
    for i, b in raw.items():
        gone = {p for s in range(len(b) - length + 1) if count[b[s : s + length]] > 1 for p in range(s, s + length)}
        runs = sum(1 for p in gone if p - 1 not in gone)
        assert (got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), bytes(got[i]["lean"])) == (len(b), len(gone), runs, bytes(x for p, x in enumerate(b) if p not in gone))
    assert sum(r["n_removed"] for r in got.values()) > 500


def test_suffix_empty_and_limits(spark):
    assert suffix.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(frame(spark, []), length=300)


def test_merge_orders_suffixes():
    text = np.frombuffer(b"mississippimississippi", np.uint8).astype(np.uint64)
    n = len(text)
    order = sorted(range(n), key=lambda i: bytes(text[i:].astype(np.uint8)))
    rank = np.zeros(n + 4, np.uint64)
    rank[order] = np.arange(1, n + 1)
    pad = np.concatenate([text, np.zeros(4, np.uint64)])
    at = np.arange(n)
    kind = at % 3
    own = np.where(kind > 0, rank[:n], 0)
    got = suffix.merged(kind, pad[at], pad[at + 1], np.where(kind == 2, 0, rank[at + 1]), rank[at + 2], own)
    assert got.tolist() == order


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    near = base[:10] + 0.05 * rng.normal(size=(10, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(np.concatenate([base, near, base[:3] * 2, base[:2]]))]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [float("inf")] + [1.0] * 15, 0), (104, base[0].tolist(), None), (105, [], 0), (106, base[0][:8].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("x")).withColumn("side", F.lit(1))
    ok = {i: np.array(v) for i, v, lab in rows if lab is not None and v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and cos(ok[a], ok[b]) >= 0.93]
    want = groups([r[0] for r in rows], links)
    n = Counter(x for ab in links for x in ab)
    for tile in (4096, 4):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, tile=tile).collect()}
        assert got == {i: (n[i], want[i], want[i] == i) for i in want}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    for _ in range(20):
        items = [(rng.randint(1, 50), rng.choice([0, 0, 0, 1, 2, 3]), rng.randint(0, 40)) for _ in range(200)]
        bins = []
        for (size, source, cluster), i in zip(items, packing.pack_items(items, 50)):
            fits = [b["left"] for b in bins if b["left"] >= size and source not in b["s"] and cluster not in b["c"]]
            if fits:
                assert bins[i]["left"] == min(fits) and source not in bins[i]["s"] and cluster not in bins[i]["c"]
            else:
                assert i == len(bins)
                bins.append({"left": 50, "s": set(), "c": set()})
            bins[i]["left"] -= size
            bins[i]["s"].add(source)
            bins[i]["c"].add(cluster)


def test_packing_keeps_all_and_respects_conflicts(spark):
    rows = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in corpus(6)] + [(900, "x " * 5000, "s1"), (900, "x " * 5000, "s1"), (None, "a b", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("piece", F.lit("x"))
    got = packing.pack(df, capacity=300, shard_rows=30).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").encode().split()) + 1 for _, t, _ in rows)
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for rs in bins.values():
        assert sum(r["n_tokens"] for r in rs) <= 300
        assert len({r["source"] for r in rs}) == len(rs) and len({r["cluster"] for r in rs}) == len(rs)
        spans = sorted((r["bin_offset"], r["n_tokens"]) for r in rs)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(Scratch(spark, "t"), edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_spans():
    s, e = merge_spans(np.array([5, 0, 2]), np.array([7, 3, 4]))
    assert s.tolist() == [0, 5] and e.tolist() == [4, 7]
