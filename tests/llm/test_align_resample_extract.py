import bisect
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import crosstoken, extract, resample

WORDS = [f"wörd{i}" for i in range(60)] + ["the", "Tokens", "don't", "x,y", "12345", "漢字", "naïveté"]


def texts(seed=5, n=40):
    rng = random.Random(seed)
    some = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    odd = [None, "", " ", "\n", " lead", "trail ", "two  spaces", "a\tb\n\nc d", "<|endoftext|> </s> <0x41> <s>", "a▁b c", "x y", "é" * 50, "\x00 \x85 q", "'s 't I'll", "  "]
    return [(i, t) for i, t in enumerate([*some, *odd, some[0], some[0]])]


# ---------------------------------------------------------------- two tokenizers


def whole_alignment(rows):
    """Each text encoded as a whole, links of all overlapping tokens, groups between common ends."""
    a = crosstoken.byte_level(open(crosstoken.BYTE_LEVEL, encoding="utf-8").read())
    b = crosstoken.pieces(open(crosstoken.PIECES, "rb").read())
    entry = lambda v: [v.flat[s : s + n].tobytes() for s, n in zip(v.start, v.size)]
    ea, eb = entry(a), entry(b)
    spans = lambda ids, e: list(zip(np.cumsum([0, *(len(e[x]) for x in ids)]).tolist(), np.cumsum([len(e[x]) for x in ids]).tolist()))
    found, held = [], Counter()
    for i, t in rows:
        ta, tb = (a.encode([t])[0], b.encode([t])[0]) if t else ([], [])
        if t and (b"".join(ea[x] for x in ta), b"".join(eb[x] for x in tb)) != ((" " + t).encode(),) * 2:
            ta = tb = []
        la, lb = spans(ta, ea), spans(tb, eb)
        ends = sorted({e for _, e in la} & {e for _, e in lb})
        groups = [([], []) for _ in ends]
        for side, ids, place in ((0, ta, la), (1, tb, lb)):
            for x, (_, e) in zip(ids, place):
                groups[bisect.bisect_left(ends, e)][side].append(x)
        links = [(x, y) for x, (s, e) in zip(ta, la) for y, (u, v) in zip(tb, lb) if u < e and s < v]
        held.update(set(links))
        found.append((i, len(ta), len(tb), len(ends), links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [(i, n, m, g, len(ln), sum(held[x] == most[x[0]] for x in ln), sum(held[x] for x in ln), s) for i, n, m, g, ln, s in found]


@pytest.mark.parametrize("block,part", [(1 << 20, 1 << 20), (300, 40)])
def test_alignment_against_whole_texts(spark, block, part, monkeypatch):
    """Small blocks and parts too: texts longer than a part are cut into several, one longer than a block is one by itself."""
    monkeypatch.setattr(crosstoken, "PART_CHARS", part)
    rows = [*texts(), (None, "no id here"), (3, "an id again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n_a", F.lit("mine"))
    got = [tuple(r) for r in crosstoken.align(df, block_chars=block).collect()]
    assert sorted(got, key=str) == sorted(whole_alignment(rows), key=str)


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert crosstoken.align(df).count() == 0
    none = spark.createDataFrame([("x", None), (None, "")], "doc_id string, text string")
    assert {tuple(r)[1:] for r in crosstoken.digest(none).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_long_texts_are_cut_into_the_same_units(spark):
    text = " ".join(random.Random(2).choice(WORDS) for _ in range(5000)) + "  \n end"
    whole = next(crosstoken.units(text, 1 << 30))
    assert " ".join(whole) == text
    assert [u for part in crosstoken.units(text, 100) for u in part] == whole
    assert len(list(crosstoken.units("x" * 1000, 10))) == 1
    df = spark.createDataFrame([(1, text * 60)], "doc_id long, text string")  # some MB
    r = crosstoken.align(df).first()
    assert r["groups"].count(";") + 1 == r["n_groups"] and r["n_links"] >= max(r["n_a"], r["n_b"])
    assert r["n_best"] == r["n_links"] == r["count_sum"]  # one document holds every pair once


def test_union_find_is_the_smallest_node_reached():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 30), (400, 390), (1000, 3000)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        root = list(range(n))
        for _ in range(n):
            before = list(root)
            for a, b in zip(x.tolist(), y.tolist()):
                root[a] = root[b] = min(root[a], root[b])
            if before == root:
                break
        assert crosstoken.union_find(n, x, y).tolist() == root
    chain = np.random.default_rng(1).permutation(2000)
    assert not crosstoken.union_find(2000, chain[:-1], chain[1:]).any()


# ---------------------------------------------------------------- resampling


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) > 127 or c.isascii() and c.isalnum() else " " for c in low).split(" ")


def plain_resample(rows, goal, longest, buckets, least, percent):
    def runs(text):
        w = [x for x in plain_words(text) if x]
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1))

    own = [(i, *runs(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, c in own:
        s.update(c)
    for x in goal:
        t.update(runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n, c in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("longest,slice_bytes", [(1, 1 << 20), (3, 1 << 20), (3, 16)])
def test_resample_against_plain_python(spark, longest, slice_bytes, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", slice_bytes)
    rows = [*texts(7), (None, "THE the end of it all"), (5, "twice 5 here")]
    goal = ["the Tokens don't", None, "", "naïveté 12345 " * 3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("rank", F.lit("mine")).withColumn("buckets", F.lit("kept"))
    got = resample.resample(df, spark.createDataFrame([(x,) for x in goal], "text string"), longest=longest, buckets=97, least_words=3, percent=40)
    assert got.columns == ["doc_id", "text", "buckets", "n_features", "weight", "score", "rank"]
    found = got.collect()
    assert {r["buckets"] for r in found} == {"kept"}
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found) == Counter(plain_resample(rows, goal, longest, 97, 3, 40))


def test_resample_repeated_rows_and_nothing(spark):
    """Equal rows each get a rank of their own, and are not one task."""
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c " * 8).alias("text"))
    goal = spark.createDataFrame([], "text string")
    ranks = sorted(r["rank"] for r in resample.resample(rows, goal, percent=50).filter("rank is not null").select("rank").collect())
    assert ranks == list(range(1, 1501))
    assert resample.digest(rows.limit(0), goal).count() == 0
    none = resample.digest(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), goal).collect()
    assert {(r["n_features"], r["weight"], r["rank"]) for r in none} == {(0, 0, None)}


def test_ring_over_slices_of_one_text():
    text = " ".join(random.Random(3).choice(WORDS) for _ in range(3000)).encode()
    one, many = resample.Ring(4), resample.Ring(4)
    whole = one.feed([w for part in resample.words_of(text, 1 << 30) for w in part])
    assert [x for part in resample.words_of(text, 50) for x in many.feed(part)] == whole
    assert len(list(resample.words_of(b"x" * 1000, 10))) == 1


# ---------------------------------------------------------------- pages

LINE = "It was late when the boats came back to the harbour, and nobody on the pier had thought to light a lamp for them. "
PAGES = [
    (None, ""),
    ("", ""),
    ("<", "<"),
    ("plain words", "plain words"),
    ("<nav>menu</nav><script>x</script>", ""),
    ("<p>a<b>b</b>c<br>d &amp; &lt;x&gt;&nbsp;e<script>var x='</p>'</script><!-- gone --> f", "abc d & <x> e f"),
    # Tags left open, headings in the article's own header, cells and items without ends, a quoted > and odd attributes.
    (
        f"<html><body class=home><header><h2>Site</h2><a href=/>Home</a></header><main><article class='post no-comments'><header><h1>Boats &amp; lamps</h1></header><p title=\"a > b 'class=ad'\">{LINE}<p hiddenish>{LINE}<table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul></article>"
        f"<section class=comments><article class=comment><p>{LINE * 30}</article></section></main><footer>&copy; all</footer>",
        " ".join(f"Boats & lamps {LINE}{LINE} 1 2 3 x y".split()),
    ),
    # No semantic elements: sections beside each other, a heading beside them, short lines inside.
    (
        f"<div id=header><a href=/>Home</a> <a href=/b>Blog</a></div><div class='wrap has-sidebar'><div class=content><h1>Title</h1><div><p>{LINE * 2}<p>{LINE}</div><div><p>{LINE * 4}<p>So.</div></div>"
        f"<div class=sidebar><ul><li><a>One</a><li><a>Two</a></ul></div></div><div id=comments><p>{LINE * 9}</div><div class=cookie-banner>{LINE}</div><div style='display: none'>{LINE}</div><form><p>{LINE}</form>",
        " ".join(f"Title {LINE * 3} {LINE * 4} So.".split()),
    ),
    # A list of links without any name loses against text.
    (f"<body><div>{''.join(f'<div><a href=/{i}>Link number {i}</a></div>' for i in range(30))}</div><div><p>{LINE * 3}</p><p>{LINE * 2}</p></div>", " ".join((LINE * 5).split())),
]


def test_main_text_of_pages(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[5][0])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).repartition(2)
    out = extract.extract(df)
    assert out.columns == ["page_id", "url", "html", "text"]
    got = out.collect()
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] is not None} == dict(enumerate(t for _, t in PAGES))
    assert [r["text"] for r in got if r["page_id"] is None] == [PAGES[5][1]] * 2
    assert {(r["page_id"], r["n_chars"]) for r in extract.digest(df).collect() if r["page_id"] is not None} == {(i, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert extract.digest(df.limit(0)).count() == 0
    assert [r["html"] for r in extract.extract(df.select("html"), text_col="html").collect() if r["html"].startswith("plain")] == ["plain words"]


def test_density_prefers_long_plain_text():
    page = extract.Page(f"<div><p>{LINE}</p></div><div><p><a>one</a></p><p><a>two</a></p></div>")
    chars, density = extract._densities(page, extract._left_out(page))
    tags = page.tag
    first, second = [i for i, t in enumerate(tags) if t == "div"]
    c, all_chars = len(LINE.replace(" ", "")), len(LINE.replace(" ", "")) + 6
    assert chars[first] == c
    assert density[first] == pytest.approx(c * math.log(c) / math.log(math.log(6 / all_chars * c + math.e)))  # one block below, no links
    assert density[second] < density[first] / 10


def test_long_page():
    body = "".join(f"<p>{LINE}<b>{i}</b>" for i in range(20_000))
    text = extract.main_text(f"<nav><a href=/>x</a></nav><article>{body}")
    assert len(text) > 2_000_000 and text.endswith("19999")


def test_numbers_in_few_bytes():
    for x in ([], [0], [255], [256, 0, 3], [65535, 65536], [2**24 - 1, 1], [2**40, 7]):
        blob = crosstoken._narrow(np.array(x, np.int64))[0].as_py()
        assert crosstoken._wide(blob).tolist() == x and blob[0] == max([1, *(-(-v.bit_length() // 8) for v in x)])
