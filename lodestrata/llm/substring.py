"""Substring dedup by seed and extend: winnowed anchors find repeated passages, extension finds their full reach.

Every window of `window` words has one anchor: the smallest hash among its grams of `gram` words (leftmost if equal), which
depends on the window's words alone, so equal windows anywhere have equal anchors. Consecutive windows with one anchor form a
stretch. A passage's interior gives the same stretches in every copy; only at its two ends do stretches differ. So:

1. seeds: anchors are joined across all documents; an anchor that occurs once holds no repeated window;
2. whole stretches that occur twice or more are repeats in full;
3. the others are extended: one of each kind is cut into its windows, left and right of the anchor, and a window repeats if
   it lies in two kinds (or in a kind that itself occurs twice). Extension counts reaches per anchor and never forms pairs of
   occurrences, so an anchor in a third of all rows costs as much a row as any other;
4. maximal repeats are the unions of repeated windows of a document.

Hashes are 64 bits for the anchor and 64 for the stretch or window under it, compared together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, Roller, Scratch, keyed, merge_spans, pieces, signed, sliding_min, tune, word_bounds, word_hashes

WINDOW_WORDS = 35
GRAM_WORDS = 8
#: Tasks that share the occurrences of one kind of stretch.
SALTS = 16


def stretches(symbols: np.ndarray, first: np.ndarray, window: int, gram: int, spread: bool = True):
    """(document, first window, windows, anchor hash, stretch hash, Roller, place of the anchor) of texts whose symbols start at first[i]."""
    roll = Roller(symbols)
    grams = roll.windows(gram, spread)
    bits = np.uint64(max(24, int(len(symbols)).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    best = sliding_min(key, window - gram + 1)
    n = len(best)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    fits = np.arange(n) + window <= first[1:][doc] if n else np.empty(0, bool)
    at = np.nonzero(fits)[0]
    if not len(at):
        e = np.empty(0, np.int64)
        return e, e, e, e.view(np.uint64), e.view(np.uint64), roll, e
    pos, d = (best[at] & low).astype(np.int64), doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (d[1:] != d[:-1])
    i = np.nonzero(new)[0]
    count = np.diff(np.append(i, len(at)))
    start = at[i]
    return d[i], start - first[d[i]], count, grams[pos[i]], roll.ranges(start, start + count - 1 + window) if spread else None, roll, pos[i]


def _find(window: int, gram: int):
    def run(batches):
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(2)]
            for a, b, data, offsets in pieces(batch.column(2)):
                s, e, first = word_bounds(data, offsets)
                d, start, count, seed, whole, *_ = stretches(word_hashes(data, s, e, False), first, window, gram)
                yield pa.RecordBatch.from_arrays([*(pa.array(k[a:b][d]) for k in keys), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(signed(seed)), pa.array(signed(whole))], [*KEY, "start", "n", "seed", "whole"])

    return run


def _cut(window: int):
    """Windows of the stretches listed with each text."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            for a, b, data, offsets in pieces(batch.column(0)):
                s, e, first = word_bounds(data, offsets)
                roll = Roller(word_hashes(data, s, e, False))
                part = lists.slice(a, b - a)
                flat, sizes = part.flatten(), np.diff(part.offsets.to_numpy())
                start, n, seed, whole, many = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "n", "seed", "whole", "many"))
                base = np.repeat(first[:-1], sizes) + start
                row = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = base[row] + off
                h = roll.ranges(at, at + window)
                yield pa.RecordBatch.from_arrays([pa.array(seed[row]), pa.array(whole[row]), pa.array(off.astype(np.int32)), pa.array(many[row]), pa.array(signed(h))], ["seed", "whole", "off", "many", "h"])

    return run


def repeated_spans(docs: DataFrame, key: list[str], text: str, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """(key, spans array<struct<s,e>>) in words, one row a key with a repeated window; spans may overlap. key: two columns."""
    spark = docs.sparkSession
    tune(spark)
    base = docs.select(*(F.col(a).alias(b) for a, b in zip(key, KEY)), F.col(text).alias("t")).filter("t is not null")
    seen = scratch.save(base.mapInArrow(_find(window, gram), "k long, k2 long, start int, n int, seed long, whole long"), "seen")
    # Only hashes are grouped, with a partial sum in each task, so a seed in very many rows arrives as a few rows.
    live = scratch.save(seen.groupBy("seed").agg(F.count("*").alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("c > 1").select("seed", (F.col("lo") == F.col("hi")).alias("same")), "live")
    found = scratch.save(seen.join(live, "seed"), "found")
    scratch.drop("seen", "live")
    kinds = scratch.save(found.filter("not same").groupBy("seed", "whole").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "start", "n")).alias("x")).select("seed", "whole", (F.col("c") > 1).alias("many"), "x.*"), "kinds")
    lists = kinds.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "seed", "whole", "many")).alias("l"))
    cut = base.join(lists, KEY).dropDuplicates(KEY).select("t", "l").mapInArrow(_cut(window), "seed long, whole long, off int, many boolean, h long")
    cut = scratch.save(cut, "cut")
    again = cut.groupBy("seed", "h").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("c")).filter("c > 1").select("seed", "h")
    offs = cut.filter("not many").join(again, ["seed", "h"]).groupBy("seed", "whole").agg(F.collect_set("off").alias("offs"))
    # A kind that occurs once is one row of `kinds`: its place is known there.
    once = kinds.filter("not many").join(offs, ["seed", "whole"]).select(*KEY, F.explode("offs").alias("o"), "start").select(*KEY, (F.col("start") + F.col("o")).alias("s"), (F.col("start") + F.col("o") + window).alias("e"))
    # A kind in very many rows is dealt with a salt.
    salt = F.pmod(F.xxhash64(*KEY, "start"), F.lit(SALTS)).cast("int")
    repeated = kinds.filter("many").select("seed", "whole", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    often = found.filter("not same").withColumn("salt", salt).join(repeated, ["seed", "whole", "salt"], "left_semi")
    full = found.filter("same").select(*KEY, "start", "n").union(often.select(*KEY, "start", "n")).select(*KEY, F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + window).alias("e"))
    # Repeated rows share a key and bring the same spans, each of which is kept once: in a task first, then for the key.
    out = scratch.save(full.union(once).groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    scratch.drop("found", "kinds", "cut")
    scratch.reclaim()
    return out.withColumnsRenamed(dict(zip(KEY, key)))


def span_arrays(column, i: int) -> tuple[np.ndarray, np.ndarray]:
    value = column[i]
    if not value.is_valid:
        e = np.empty(0, np.int64)
        return e, e
    flat = value.values
    return merge_spans(flat.field("s").to_numpy().astype(np.int64), flat.field("e").to_numpy().astype(np.int64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """Documents without the words that a repeated window covers.

    Returns every column of docs plus `lean_text` (kept words joined by one space), `n_words`, `n_removed` and `spans` (the
    maximal repeats, in words). A null text stays null, with 0 words; an empty one stays empty. Windows are judged on the
    input: of repeated rows all copies lose the passage. A null id is an id like others. A text in which nothing repeats
    keeps its words, also joined by one space. Columns of these four names in docs are replaced.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    docs = docs.drop("lean_text", "n_words", "n_removed", "spans")
    own, key = keyed(docs, id_col, text_col)
    spans = repeated_spans(own, key, text_col, window, gram, scratch)
    joined = own.join(spans, key, "left").drop(*key)
    names = [f for f in joined.schema if f.name != "spans"]
    at = [f.name for f in names].index(text_col)

    def strip(batches):
        for batch in batches:
            texts, found = batch.column(at), batch.column(len(names))
            lean, words, gone, kept_spans = [], [], [], []
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                w = (value or "").encode().split()
                s, e = span_arrays(found, i)
                kept, last = [], 0
                for x, y in zip(s.tolist(), e.tolist()):
                    kept += w[last:x]
                    last = y
                kept += w[last:]
                lean.append(None if value is None else b" ".join(kept).decode())
                words.append(len(w))
                gone.append(len(w) - len(kept))
                kept_spans.append([{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist())])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lean, pa.string()), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], [*(f.name for f in names), "lean_text", "n_words", "n_removed", "spans"])

    schema = T.StructType(list(docs.schema)).add("lean_text", "string").add("n_words", "long").add("n_removed", "long").add("spans", T.ArrayType(T.StructType().add("s", "long").add("e", "long")))
    return joined.mapInArrow(strip, schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of remove_repeats."""
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("lean_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: For digest(): every window of 35 words as text, counted.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS t FROM w, unnest(range(1, len(ws) - 33)) AS r(p)),
dup AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM win SEMI JOIN dup USING (t))),
gl AS (SELECT doc_id, list(q) AS g, count(*) AS n FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS q FROM w),
kept AS (
  SELECT p.doc_id, string_agg(ws[q], ' ' ORDER BY q) AS t FROM pos p ANTI JOIN gone g USING (doc_id, q) GROUP BY p.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(gl.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN gl USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
