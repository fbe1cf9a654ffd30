"""Suffix-array dedup of repeated byte strings, with a distributed difference-cover construction.

1. Candidates. A repeated string of `length` bytes has a repeated anchor (its smallest hash among grams of `gram` bytes), so only
   windows under an anchor that occurs twice can repeat. Runs of such windows are cut at their anchors (or at one in `CUT`),
   which lie at the same places in every copy, and equal chunks become one text with a weight. Of the unlike chunks, the runs
   of windows whose bytes around the anchor occur again among them go on.
2. These runs are dealt into pages. The suffixes of all pages are sorted by the difference cover {1, 2} mod 3: triples at
   these positions are sorted into names over key ranges (ranges of the hash-free, lexicographic order, so that sorted ranges
   are the sorted whole), names make a string of two thirds the length, and so on; after five levels a name stands for 243
   bytes, more than `length`, and orders suffixes as far as needed. On the way back, positions 0 mod 3 are ordered by a symbol
   and the rank behind it and merged with the others by the usual comparisons, again by ranges.
3. Neighbours in the final order are compared by their first `length` bytes (by a 64-bit fingerprint): a suffix repeats if it
   equals a neighbour or its chunk weighs two or more.

A page holds a bounded number of bytes and a range a bounded number of suffixes: ranges follow what a level asks for, counted
page by page. Between steps only arrays of numbers move, in binary columns. The driver sees splitters: one sample of so many
suffixes.
"""

import contextlib
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, Scratch, _byte_values, Roller, keyed, merge_spans, mix, pieces, signed, tune
from .substring import span_arrays, stretches

LENGTH = 200
GRAM = 64
#: One in so many anchors ends a chunk.
CUT = 1
PARTS = 4
CHUNK_WINDOWS = 4096
PAGE_BYTES = 2 << 20
RANGE_SUFFIXES = 1 << 20
LEVELS = 5
#: Parts of the ranges merged one after another, by level: what is on its way at a time stays a fraction of the whole.
WAVES: dict[int, int] = {}
#: Windows of a very long text that are taken up at a time.
SLICE = 1 << 20
#: Samples for each range that a level is parted into.
SAMPLES = 64


@contextlib.contextmanager
def _one_row_batches(spark):
    """Rows here are whole pages."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# ------------------------------------------------------------------ candidates


def _anchors(length: int, gram: int):
    def run(batches):
        values = _byte_values(False)
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(2)]
            for a, b, data, offsets in pieces(batch.column(2), 1 << 19):
                # A very long text is cut into slices that share no window, so stretches end there too.
                for lo in range(0, len(data) if b == a + 1 else 1, SLICE):
                    part, edge = (data[lo : lo + SLICE + length - 1], None) if b == a + 1 else (data, offsets)
                    d, start, n, seed, *_ = stretches(values[part], np.array([0, len(part)]) if edge is None else edge, length, gram, False)
                    code = (start + lo) * 512 + n * 2 + ((seed >> np.uint64(40)) % np.uint64(CUT) == 0)
                    yield pa.RecordBatch.from_arrays([*(pa.array(k[a:b][d]) for k in keys), pa.array(code), pa.array(signed(seed))], [*KEY, "code", "seed"])

    return run


def _chunks(length: int):
    """Runs of live stretches (start * 512 + windows * 2 + cut), cut where an anchor of the fixed kind begins."""

    def run(batches):
        for batch in batches:
            keys, texts, lists = [batch.column(j).to_numpy() for j in range(2)], batch.column(2), batch.column(3)
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                raw = texts[i].as_py().encode()
                code = np.sort(lists[i].values.to_numpy())
                start, n = code >> 9, code >> 1 & 255
                new = (code & 1) == 1
                new[0] = True
                new[1:] |= start[1:] != start[:-1] + n[:-1]
                first = np.nonzero(new)[0]
                size = np.add.reduceat(n, first)
                if size.max() > CHUNK_WINDOWS:  # long runs of one anchor are cut too
                    since = np.cumsum(n) - n
                    new |= np.diff((since - np.repeat(since[first], np.diff(np.append(first, len(n))))) // CHUNK_WINDOWS, prepend=0) > 0
                    first = np.nonzero(new)[0]
                    size = np.add.reduceat(n, first)
                at = start[first]
                bodies = [raw[x:y] for x, y in zip(at.tolist(), (at + size - 1 + length).tolist())]
                for x, y in zip(out, ([keys[0][i]] * len(at), [keys[1][i]] * len(at), at.tolist(), size.tolist(), [hashlib.blake2b(x, digest_size=16).digest() for x in bodies], bodies)):
                    x += y
            types = (*[pa.int64()] * 4, pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], [*KEY, "at", "n", "print", "body"])

    return run


def window_parts(symbols: np.ndarray, first: np.ndarray, length: int, gram: int, parts: int):
    """(text, first window, windows, key) of each text's stretches, parted by how far into the window the anchor lies.

    Windows of one part, wherever they occur, all hold the same bytes around the anchor; the key is a hash of these, so it
    says more than the anchor: of 200 bytes, 166 for four parts."""
    d, start, n, _, _, roll, anchor = stretches(symbols, first, length, gram, False)
    step = -(-(length - gram + 1) // parts)
    base = first[d] + start
    found = []
    for lo in range(0, length - gram + 1, step):
        hi = min(lo + step - 1, length - gram)
        a, b = np.maximum(base, anchor - hi), np.minimum(base + n - 1, anchor - lo)
        ok = np.nonzero(a <= b)[0]
        key = mix(roll.ranges(anchor[ok] - lo, anchor[ok] - hi + length) + np.uint64(lo))
        found.append((d[ok], a[ok] - first[d[ok]], b[ok] - a[ok] + 1, key))
    return tuple(np.concatenate(x) for x in zip(*found))


def _parts(length: int, gram: int):
    def run(batches):
        values = _byte_values(False)
        for batch in batches:
            pids = batch.column(0)
            for a, b, data, offsets in pieces(batch.column(1), 1 << 19):
                d, off, size, key = window_parts(values[data], offsets, length, gram, PARTS)
                yield pa.RecordBatch.from_arrays([pids.slice(a, b - a).take(pa.array(d)), batch.column(2).slice(a, b - a).take(pa.array(d)), pa.array(off.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(signed(key))], ["pid", "many", "off", "size", "key"])

    return run


def _runs(length: int):
    """Texts of the runs of windows that may occur in another chunk, or twice in this one, named by chunk and place."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            # Chunks side by side, further apart than any is long.
            off = flat.field("off").to_numpy().astype(np.int64) + (row << 20)
            s, e = merge_spans(off, off + flat.field("size").to_numpy())
            row = s >> 20
            prints, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a, b = (s - (row << 20)).tolist(), (e - (row << 20)).tolist()
            row = row.tolist()
            names = [prints[r] + x.to_bytes(4, "big") for r, x in zip(row, a)]
            texts = [bodies[r][x : y - 1 + length] for r, x, y in zip(row, a, b)]
            lows = batch.column(3).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary()), lows], ["print", "body", "low"])

    return run


def _pages(batches):
    """The texts of a partition, in order, put together to pages; a page is named by its partition and place there."""
    first, names, bodies, size = TaskContext.get().partitionId() << 32, [], [], 0

    def page():
        sizes = np.array([len(x) for x in bodies], np.int64)
        return _rows([(first, b"".join(bodies), b"".join(names), sizes.tobytes())], ["page", "text", "prints", "sizes"])

    for batch in batches:
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bodies and size + len(body) > PAGE_BYTES:
                yield page()
                first, names, bodies, size = first + 1, [], [], 0
            names.append(name)
            bodies.append(body)
            size += len(body)
    if bodies:
        yield page()


# ------------------------------------------------------------------ symbols and keys


def _padded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros(3, x.dtype)])


def cover(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions 1 mod 3, with one past the end if the last triple would lack an end mark, and positions 2 mod 3."""
    return np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)


def width(total: int):
    """Names and ranks count from 1 over all ranges; 0 is the end of a page."""
    return np.uint32 if total < 2**32 - 16 else np.uint64


def _symbols(level: int, blob: bytes, kind=np.uint32) -> np.ndarray:
    """The string of a level of a page; level 0: bytes + 1; level 1: three of them, which needs no sorting."""
    if level > 1:
        return np.frombuffer(blob, kind).astype(np.uint64)
    text = _padded(np.frombuffer(blob, np.uint8).astype(np.uint64) + np.uint64(1))
    if level == 0:
        return text[:-3]
    one, two = cover(len(text) - 3)
    at = np.concatenate([one, two])
    text = np.concatenate([text, np.zeros(1, np.uint64)])
    return (text[at] << np.uint64(18) | text[at + 1] << np.uint64(9) | text[at + 2]) + np.uint64(1)


def _triples(level: int, s: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """High and low words of the triples at the cover, in order of the next string."""
    one, two = cover(len(s))
    at = np.concatenate([one, two])
    p = np.concatenate([_padded(s), np.zeros(1, np.uint64)])
    a, b, c = p[at], p[at + 1], p[at + 2]
    if level == 1:  # 28 bits
        return a << np.uint64(28) | b, c.astype(np.uint32)
    if kind is np.uint32:
        return a << np.uint64(32) | b, c.astype(np.uint32)
    return a << np.uint64(21) | b >> np.uint64(21), (b & np.uint64((1 << 21) - 1)) << np.uint64(42) | c


def _some(n: int, step: int) -> np.ndarray:
    """One place in so many, so that a page is sampled by what it holds."""
    return np.arange(step // 2 if step // 2 < n else 0, n, step)


def needed(sizes: bytes, length: int, level: int) -> np.ndarray:
    """Whether a position's rank is asked for: at level 0 that of each window's start, above that of the positions at the cover
    by which those below are compared. The last bytes of a run only lengthen its windows and are named but never ranked."""
    sizes = np.frombuffer(sizes, np.int64)
    edge = np.cumsum(sizes)
    mask = np.arange(edge[-1]) + length <= np.repeat(edge, sizes)
    for _ in range(level):
        mask = _above(mask)
    return mask


def _above(mask: np.ndarray) -> np.ndarray:
    use = np.zeros(len(mask) + 3, bool)
    for i in range(3):
        use[i : i + len(mask)] |= mask
    return use[np.concatenate(cover(len(mask)))]


def _asked(length: int):
    """How many ranks each level of a page is asked for. Short runs of windows take far more of them above than two thirds of
    those below, so that a level's ranges can't be told from the number of windows."""

    def run(batches):
        for batch in batches:
            for sizes in batch.column(0).to_pylist():
                mask, n = needed(sizes, length, 0), []
                for _ in range(LEVELS):
                    n.append(int(mask.sum()))
                    mask = _above(mask)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.list_(pa.int64()))], ["n"])

    return run


def pair_order(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Order by two words; 32 bits of the second go behind the place of the first, so that single words are sorted."""
    if lo.dtype != np.uint32:
        return np.lexsort((lo, hi))
    return np.argsort(np.unique(hi, return_inverse=True)[1].astype(np.uint64) << np.uint64(32) | lo)


def _slices(part: np.ndarray, ranges: int):
    """(range, members in order) of the ranges with members."""
    if ranges < 1 << 16:
        part = part.astype(np.uint16)  # sorted by digits
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(ranges + 1))
    for r in range(ranges):
        if edge[r + 1] > edge[r]:
            yield r, order[edge[r] : edge[r + 1]]


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"page": pa.int64(), "part": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], types.get(n, pa.binary())) for i, n in enumerate(names)], names)


def _distinct(level: int, length: int, kind):
    """Of each page the distinct triples in order and, for each position at the cover, which one is there. Triples that the
    last names are made of are asked for where a rank is."""

    def run(batches):
        for batch in batches:
            for i, (page, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                hi, lo = _triples(level, _symbols(level, blob.as_py(), kind), kind)
                sizes = batch.column(2)[i].as_py()
                if level == LEVELS - 1:
                    at = needed(sizes, length, LEVELS)
                    hi, lo = hi[at], lo[at]
                order = pair_order(hi, lo)
                hi, lo = hi[order], lo[order]
                new = np.ones(len(order), bool)
                new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
                which = np.empty(len(order), np.uint32)
                which[order] = np.cumsum(new) - 1
                if level == LEVELS - 1:
                    full = np.zeros(len(at), np.uint32)
                    full[at] = which
                    which = full
                yield _rows([(page, hi[new].tobytes(), lo[new].tobytes(), which.tobytes(), sizes)], ["page", "hi", "lo", "which", "sizes"])

    return run


def _low(level: int, kind):
    return np.uint32 if level == 1 or kind is np.uint32 else np.uint64


def _sample_triples(low, step: int):
    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                hi, lo = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), low)
                at = _some(len(hi), step)
                yield pa.RecordBatch.from_arrays([pa.array(signed(hi[at])), pa.array(signed(lo[at].astype(np.uint64)))], ["hi", "lo"])

    return run


def _send_triples(low, cut_hi: np.ndarray, cut_lo: np.ndarray):
    def run(batches):
        for batch in batches:
            for page, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                hi, lo = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), low)
                a, b = np.searchsorted(hi, cut_hi, "left"), np.searchsorted(hi, cut_hi, "right")
                cut = [int(i + np.searchsorted(lo[i:j], v, "left")) for i, j, v in zip(a.tolist(), b.tolist(), cut_lo.astype(low))]
                for r, (i, j) in enumerate(zip([0, *cut], [*cut, len(hi)])):
                    if j > i:
                        yield _rows([(page, r, hi[i:j].tobytes(), lo[i:j].tobytes())], ["page", "part", "hi", "lo"])

    return run


def _name(low):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo = np.frombuffer(b"".join(pdf["hi"]), np.uint64), np.frombuffer(b"".join(pdf["lo"]), low)
        order = pair_order(hi, lo)
        new = np.ones(len(order), bool)
        new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
        name = np.empty(len(order), np.uint32)
        name[order] = np.cumsum(new)  # from 1
        edge = np.cumsum([0, *(len(x) // 8 for x in pdf["hi"])])
        return pd.DataFrame({"page": pdf["page"], "part": pdf["part"], "value": [name[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], "top": int(new.sum())})

    return run


def _bases(found: DataFrame) -> tuple[dict[int, int], int]:
    """How many numbers the ranges before each one use: the driver sums one number of each range."""
    tops = {r["part"]: r["top"] for r in found.groupBy("part").agg(F.max("top").alias("top")).collect()}
    base, total = {}, 0
    for part in sorted(tops):
        base[part] = total
        total += tops[part]
    return base, total


def _renamed(named: DataFrame, kinds: DataFrame, kind) -> DataFrame:
    """The next string of each page: the names of its distinct triples, put where the triples are."""
    base, _ = _bases(named)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["part"] == -1
        found = pdf[~own].sort_values("part")
        names = [np.frombuffer(v, np.uint32).astype(kind) + kind(base[p]) for p, v in zip(found["part"].tolist(), found["value"])]
        which = np.frombuffer(pdf[own]["value"].iloc[0], np.uint32)
        return pd.DataFrame({"page": [pdf["page"].iloc[0]], "data": [np.concatenate(names)[which].tobytes()], "sizes": [pdf[own]["sizes"].iloc[0]]})

    rows = named.select("page", "part", "value", F.lit(None).cast("binary").alias("sizes")).union(kinds.select("page", F.lit(-1).cast("long"), "which", "sizes"))
    return rows.groupBy("page").applyInPandas(run, "page long, data binary, sizes binary")


def _back(pdf: pd.DataFrame, value: np.ndarray, top: int) -> pd.DataFrame:
    """Numbers of a range for the pages they belong to; top: how many numbers the range uses."""
    edge = np.cumsum([0, *(len(x) // 4 for x in pdf["at"])])
    return pd.DataFrame({"page": pdf["page"], "part": pdf["part"], "at": pdf["at"], "value": [value[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], "top": top})


def _ranks(found: DataFrame, strings: DataFrame, kind) -> DataFrame:
    """Strings (page, data, sizes) with `ranks` of the level above, from the pieces that came back, numbered over all ranges."""
    base, _ = _bases(found)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["part"] == -1].iloc[0]
        pdf = pdf[pdf["part"] != -1]
        at = np.frombuffer(b"".join(pdf["at"]), np.uint32)
        value = np.frombuffer(b"".join(pdf["value"]), np.uint32).astype(kind)
        value += np.repeat(np.array([base[p] for p in pdf["part"]], kind), [len(x) // 4 for x in pdf["at"]])
        out = np.zeros(int(at.max()) + 1, kind)
        out[at] = value
        return pd.DataFrame({"page": [own["page"]], "data": [own["value"]], "ranks": [out.tobytes()], "sizes": [own["at"]]})

    rows = found.select("page", "part", "at", "value").union(strings.select("page", F.lit(-1).cast("long"), "sizes", "data"))
    return rows.groupBy("page").applyInPandas(run, "page long, data binary, ranks binary, sizes binary")


# ------------------------------------------------------------------ merging


def _ranked(level: int, text: bytes, ranks: bytes, kind) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a level and, at the cover, ranks of the suffixes there (0 elsewhere), both padded."""
    s = _symbols(level, text, kind)
    r = np.frombuffer(ranks, kind)
    one, two = cover(len(s))
    rank = np.zeros(len(s) + 4, np.uint64)
    rank[np.concatenate([one, two])[: len(r)]] = r
    rank[len(s)] = 0  # the mark past the end comes before all suffixes
    return np.concatenate([_padded(s), np.zeros(1, np.uint64)]), rank


def _sample_ranks(level: int, length: int, kind, step: int):
    def run(batches):
        for batch in batches:
            for text, ranks, sizes in zip(batch.column(1), batch.column(2), batch.column(3)):
                s, rank = _ranked(level, text.as_py(), ranks.as_py(), kind)
                at = np.nonzero(needed(sizes.as_py(), length, level))[0]
                at = at[at % 3 == 1]
                at = at[_some(len(at), step)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(x)) for x in (rank[at], s[at], rank[at + 1])], ["rank", "s", "next"])

    return run


def _pair(a: np.ndarray, b: np.ndarray, kind) -> np.ndarray:
    """Numbers in the order of pairs; both are below 2**32, or below 2**53."""
    if kind is np.uint32:
        return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    out = np.empty(len(a), np.complex128)
    out.real, out.imag = a, b
    return out


def _small(level: int, kind):
    return {0: np.uint8, 1: np.uint32}.get(level, kind)  # bytes of UTF-8, and one more, are below 256


def _send_suffixes(level: int, splitters: np.ndarray, wave: range, length: int, kind):
    small = _small(level, kind)
    cut_rank, cut_pair = splitters[:, 0].copy(), _pair(splitters[:, 1], splitters[:, 2], kind)

    def run(batches):
        for batch in batches:
            for page, text, ranks, sizes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                s, rank = _ranked(level, text.as_py(), ranks.as_py(), kind)
                all_at = np.nonzero(needed(sizes.as_py(), length, level))[0]
                part = np.empty(len(all_at), np.int64)
                zero = all_at % 3 == 0
                i = all_at[zero]
                part[zero] = np.searchsorted(cut_pair, _pair(s[i], rank[i + 1], kind), "right")
                part[~zero] = np.searchsorted(cut_rank, rank[all_at[~zero]], "right")
                if level == 0:
                    print_ = Roller(_byte_values(False)[np.frombuffer(text.as_py(), np.uint8)]).windows(length)
                for r, own in _slices(part, len(splitters) + 1):
                    if r in wave:
                        at = all_at[own]
                        rest = at % 3
                        blobs = (at.astype(np.uint32), s[at].astype(small), s[at + 1].astype(small), np.where(rest == 2, 0, rank[at + 1]).astype(kind), np.where(rest == 1, rank[at], rank[at + 2]).astype(kind), rank[at[rest == 2]].astype(kind))
                        yield _rows([(page, r, *(x.tobytes() for x in blobs), print_[at].tobytes() if level == 0 else b"")], ["page", "part", "at", "s0", "s1", "r1", "r2", "own", "prints"])

    return run


def merged(kind: np.ndarray, s0: np.ndarray, s1: np.ndarray, r1: np.ndarray, r2: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of suffixes: those at the cover by rank, the others put among them by the two comparisons of the difference cover."""
    zero, one, two = (np.nonzero(kind == i)[0] for i in range(3))
    cover_ = np.nonzero(kind)[0]
    cover_ = cover_[np.argsort(rank[cover_])]
    size = np.uint32 if rank.dtype == np.uint32 else np.uint64
    first = _pair(s0, r1, size)
    zero = zero[np.argsort(first[zero])]
    before = np.searchsorted(np.sort(first[one]), first[zero], "right")
    both = np.concatenate([two, zero])
    s01 = _pair(s0[both], s1[both], size) if s0.itemsize > 1 else s0[both].astype(np.uint64) << np.uint64(8) | s1[both]
    if size is np.uint32:
        if s0.itemsize > 1:
            s01 = np.unique(s01, return_inverse=True)[1]
        key = _pair(s01, r2[both], size)
        before = before + np.searchsorted(np.sort(key[: len(two)]), key[len(two) :], "right")
    else:
        order = np.lexsort((r2[both], s01))
        is_zero = order >= len(two)
        less = np.empty(len(zero), np.int64)
        less[order[is_zero] - len(two)] = np.cumsum(~is_zero)[is_zero]
        before = before + less
    before = np.maximum.accumulate(before) if len(before) else before
    place = np.concatenate([2 * np.arange(len(cover_)) + 1, 2 * before])
    return np.concatenate([cover_, zero])[np.argsort(place, kind="stable")]


def _merge(level: int, kind):
    small = _small(level, kind)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load = lambda x, t: np.frombuffer(b"".join(pdf[x]), t)
        rest = load("at", np.uint32) % 3
        s0, s1, r1, r2 = load("s0", small), load("s1", small), load("r1", kind), load("r2", kind)
        rank = np.where(rest == 1, r2, 0).astype(kind)
        rank[rest == 2] = load("own", kind)
        order = merged(rest, s0, s1, r1, r2, rank)
        if level:
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(1, len(order) + 1)
            out = _back(pdf, place, len(order))
            out["first"] = out["last"] = 0
            return out[["page", "part", "at", "value", "top", "first", "last"]]
        h = load("prints", np.uint64)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.cumsum([0, *(len(x) // 4 for x in pdf["at"])])
        at, part = load("at", np.uint32), pdf["part"].iloc[0]
        rows = [(p, part, at[a:b][again[a:b]].tobytes(), b"", 0, 0, 0) for p, a, b in zip(pdf["page"].tolist(), edge[:-1].tolist(), edge[1:].tolist())]
        # The first and the last suffix of the range may equal one in the range beside it.
        page = np.repeat(pdf["page"].to_numpy(), np.diff(edge))
        for i, first in ((order[0], 1), (order[-1], 0)) if len(order) else ():
            rows.append((page[i], part, at[i : i + 1].tobytes(), h[i : i + 1].tobytes(), 0, first, 1 - first))
        return pd.DataFrame(rows, columns=["page", "part", "at", "value", "top", "first", "last"])

    return run


# ------------------------------------------------------------------ all levels


def _splitters(sample: np.ndarray, ranges: int) -> np.ndarray:
    """Rows of a sorted sample that part it evenly."""
    if ranges <= 1 or not len(sample):
        return sample[:0]
    return sample[np.unique((np.arange(1, ranges) * len(sample)) // ranges)]


def repeated_positions(pages: DataFrame, total: int, length: int, scratch: Scratch, range_suffixes: int = RANGE_SUFFIXES) -> DataFrame:
    """(page, at binary of uint32): positions of pages (page, text, sizes) at which a string of `length` bytes starts that also
    starts elsewhere in the pages. total: their bytes."""
    keys, kind = "page long, part long", width(total)
    text = pages.select("page", F.col("text").alias("data"), "sizes")
    strings: dict[int, DataFrame] = {0: text, 1: text}
    counts = pages.select("sizes").mapInArrow(_asked(length), "n array<long>").agg(*(F.sum(F.col("n")[i]).alias(str(i)) for i in range(LEVELS))).first()
    size, step = total * 2 / 3, max(1, range_suffixes // SAMPLES)
    for level in range(1, LEVELS):
        size *= 2 / 3
        ranges = max(1, math.ceil(size / range_suffixes))
        low = _low(level, kind)
        kinds = scratch.save(strings[level].mapInArrow(_distinct(level, length, kind), "page long, hi binary, lo binary, which binary, sizes binary"), f"kinds-{level}", "snappy", wide=True)
        picked = []
        if ranges > 1:
            picked = kinds.select("hi", "lo").mapInArrow(_sample_triples(low, step), "hi long, lo long").collect()
        hi, lo = (np.array([x[c] for x in picked], np.int64).view(np.uint64) for c in ("hi", "lo"))
        order = np.lexsort((lo, hi))
        order = _splitters(order, ranges)
        sent = kinds.select("page", "hi", "lo").mapInArrow(_send_triples(low, hi[order], lo[order]), f"{keys}, hi binary, lo binary")
        named = scratch.save(sent.groupBy("part").applyInPandas(_name(low), f"{keys}, value binary, top long"), f"named-{level}", "snappy", wide=True)
        scratch.reclaim()
        strings[level + 1] = scratch.save(_renamed(named, kinds, kind), f"string-{level + 1}", "snappy", wide=True)
        scratch.drop(f"kinds-{level}")
        scratch.drop(f"named-{level}")
        scratch.reclaim()
    top = LEVELS - 1
    joined = strings[top].join(strings[LEVELS].select("page", F.col("data").alias("ranks")), "page").select("page", "data", "ranks", "sizes")
    joined = scratch.save(joined, f"joined-{top}", "snappy", wide=True)
    for level in range(top, -1, -1):
        ranges = max(1, math.ceil((counts[level] or 0) / range_suffixes))
        found = []
        if ranges > 1:
            found = [(x["rank"], x["s"], x["next"]) for x in joined.mapInArrow(_sample_ranks(level, length, kind, max(1, step // 3)), "rank long, s long, next long").collect()]
        sample = np.array(sorted(found), np.int64).reshape(-1, 3).view(np.uint64)
        cut = _splitters(sample, ranges)
        count = WAVES.get(level, 1)
        waves = []
        for w in range(count):
            wave = range((len(cut) + 1) * w // count, (len(cut) + 1) * (w + 1) // count)
            sent = joined.mapInArrow(_send_suffixes(level, cut, wave, length, kind), f"{keys}, at binary, s0 binary, s1 binary, r1 binary, r2 binary, own binary, prints binary")
            waves.append(scratch.save(sent.groupBy("part").applyInPandas(_merge(level, kind), f"{keys}, at binary, value binary, top long, first int, last int"), f"merged-{level}-{w}", "snappy", wide=True))
            scratch.reclaim()
        out = waves[0]
        for w in waves[1:]:
            out = out.union(w)
        scratch.drop(f"joined-{level}", f"string-{level + 1}")
        if level:
            joined = scratch.save(_ranks(out, strings[level - 1], kind), f"joined-{level - 1}", "snappy", wide=True)
            scratch.drop(*(f"merged-{level}-{w}" for w in range(count)))
            scratch.reclaim()
    # Two rows for each range: few enough for one ordered window.
    edges = out.filter("first = 1 or last = 1").select("page", "at", "value", "part", "first", "last")
    order = Window.orderBy("part", "last")
    edges = edges.withColumn("before", F.lag("value").over(order)).withColumn("after", F.lead("value").over(order)).filter("(first = 1 and value = before) or (last = 1 and value = after)")
    return out.filter("first = 0 and last = 0").select("page", "at").union(edges.select("page", "at"))


def _spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of each chunk of a page, as spans of window starts."""
    own = pdf[pdf["text"].notna()].iloc[0]
    sizes = np.frombuffer(own["sizes"], np.int64)
    names = [own["prints"][i : i + 20] for i in range(0, len(own["prints"]), 20)]
    base = np.array([int.from_bytes(x[16:], "big") for x in names], np.int64)
    found = pdf[pdf["at"].notna()]["at"]
    at = np.unique(np.frombuffer(b"".join(found), np.uint32).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    chunk = np.searchsorted(edge, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (chunk[1:] != chunk[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1
    c = chunk[first]
    return pd.DataFrame({"print": [names[x][:16] for x in c], "s": at[first] - edge[c] + base[c], "e": at[last] - edge[c] + base[c] + 1})


def _sorted_spans(texts: DataFrame, total: int, length: int, scratch: Scratch) -> DataFrame:
    """(print, s, e): window starts of chunks that the order of all suffixes shows to repeat."""
    spark = texts.sparkSession
    count = max(1, math.ceil(total / PAGE_BYTES))
    # Texts that share a part lie side by side, so a page has few distinct triples; a part in very many texts fills many pages.
    dealt = texts.repartitionByRange(count, "low", "print").sortWithinPartitions("low", "print").select("print", "body")
    pages = dealt.mapInArrow(_pages, "page long, text binary, prints binary, sizes binary")
    pages = scratch.save(pages, "pages", wide=True)
    scratch.reclaim()
    with _one_row_batches(spark):
        again = repeated_positions(pages, total, length, scratch)
    none = F.lit(None).cast("binary")
    # Of a page's text only that it is there is asked.
    own = pages.select("page", F.lit(b"x").alias("text"), "prints", "sizes", none.alias("at")).union(again.select("page", none, none, none, "at"))
    return scratch.save(own.groupBy("page").applyInPandas(_spans, "print binary, s long, e long"), "unique-spans")


def repeated_spans(docs: DataFrame, key: list[str], text: str, length: int, gram: int, scratch: Scratch) -> DataFrame:
    """(key, spans array<struct<s,e>>) in bytes, one row a key with a repeated string; spans may overlap. key: two columns."""
    spark = docs.sparkSession
    base = docs.select(*(F.col(a).alias(b) for a, b in zip(key, KEY)), F.col(text).alias("t")).filter("t is not null")
    seen = scratch.save(base.mapInArrow(_anchors(length, gram), "k long, k2 long, code long, seed long"), "seen", "snappy")
    live = seen.groupBy("seed").agg(F.count("*").alias("c")).filter("c > 1").select("seed")
    # Of repeated rows (equal keys have equal texts) each is kept: their chunks are as many occurrences.
    # A table, so that what was dealt by seeds is gone before texts are dealt by keys.
    lists = scratch.save(seen.join(live.hint("shuffle_hash"), "seed", "left_semi").groupBy(*KEY).agg(F.collect_set("code").alias("l")), "lists")
    scratch.drop("seen")
    scratch.reclaim()
    chunks = base.join(lists, KEY).mapInArrow(_chunks(length), "k long, k2 long, at long, n long, print binary, body binary")
    chunks = scratch.save(chunks, "chunks")
    scratch.drop("lists")
    scratch.reclaim()
    kinds = scratch.save(chunks.groupBy("print").agg(F.first("body").alias("body"), F.first("n").alias("n"), (F.count("*") > 1).alias("many")).withColumn("pid", F.xxhash64("print")), "kinds")
    places = scratch.save(chunks.select(*KEY, "at", "print"), "places")
    scratch.drop("chunks")
    scratch.reclaim()
    # Outside its chunk's copies a window repeats only where what its part has in common occurs again among the unlike
    # chunks; where all of these have copies, their windows are known to repeat.
    parts = scratch.save(kinds.select("pid", "body", "many").mapInArrow(_parts(length, gram), "pid long, many boolean, off int, size int, key long"), "parts", "snappy")
    shared = parts.groupBy("key").agg(F.count("*").alias("c"), F.min("many").alias("known")).filter("c > 1 and not known").select("key")
    wanted = parts.join(shared.hint("shuffle_hash"), "key", "left_semi").groupBy("pid").agg(F.collect_list(F.struct("off", "size")).alias("parts"), F.min("key").alias("low"))
    texts = scratch.save(kinds.select("pid", "print", "body").join(wanted, "pid").select("print", "body", "parts", "low").mapInArrow(_runs(length), "print binary, body binary, low long"), "texts")
    total = texts.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    weighed = kinds.filter("many").select("print", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    spans = weighed.limit(0)
    if total:
        spans = _sorted_spans(texts, total, length, scratch)
    some = weighed.union(spans).groupBy("print").agg(F.collect_list(F.struct("s", "e")).alias("l"))
    at = places.join(some, "print").select(*KEY, F.explode(F.transform("l", lambda x: F.struct((F.col("at") + x["s"]).alias("s"), (F.col("at") + x["e"] - 1 + length).alias("e")))).alias("x"))
    # Repeated rows share a key and bring the same spans, each of which is kept once: in a task first, then for the key.
    out = scratch.save(at.groupBy(*KEY).agg(F.collect_set("x").alias("spans")), "spans")
    scratch.drop("kinds", "places", "parts", "texts", "pages", "unique-spans", *(f"merged-0-{w}" for w in range(WAVES.get(0, 1))))
    scratch.reclaim()
    return out.withColumnsRenamed(dict(zip(KEY, key)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with `lean` (binary: the UTF-8 bytes that no repeated string covers), `n_bytes`, `n_removed` and `spans` (removed runs).

    length is at most 243, what five levels of names cover. Null and empty texts have 0 bytes. Strings are judged on the input:
    repeated rows take each other's bytes away. Columns of these four names in docs are replaced.
    """
    if length > 3**LEVELS or gram >= length:
        raise ValueError("length is at most 243 and gram is below it")
    scratch = Scratch(docs.sparkSession, "suffix")
    tune(docs.sparkSession)
    docs = docs.drop("lean", "n_bytes", "n_removed", "spans")
    own, key = keyed(docs, id_col, text_col)
    spans = repeated_spans(own, key, text_col, length, gram, scratch)
    joined = own.join(spans, key, "left").drop(*key)
    names = docs.columns
    at = names.index(text_col)

    def strip(batches):
        pair = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for batch in batches:
            texts, found = batch.column(at).cast(pa.binary()).fill_null(b""), batch.column(len(names))
            # Only rows with spans are taken apart.
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            lean, runs = [], [[]] * batch.num_rows
            for i in np.nonzero(hit)[0].tolist():
                raw = texts[i].as_py()
                s, e = span_arrays(found, i)
                s, e = s[e > s].tolist(), e[e > s].tolist()
                lean.append(b"".join(raw[a:b] for a, b in zip([0, *e], [*s, len(raw)])))
                runs[i] = [{"s": x, "e": y} for x, y in zip(s, e)]
            left = pc.replace_with_mask(texts, pa.array(hit), pa.array(lean, pa.binary()))
            size, rest = (pc.binary_length(x).cast(pa.int64()) for x in (texts, left))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], left, size, pc.subtract(size, rest), pa.array(runs, pair)], [*names, "lean", "n_bytes", "n_removed", "spans"])

    schema = T.StructType(list(docs.schema)).add("lean", "binary").add("n_bytes", "long").add("n_removed", "long").add("spans", T.ArrayType(T.StructType().add("s", "long").add("e", "long")))
    return joined.mapInArrow(strip, schema)


def digest(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("lean", 256).alias("kept_sha256"))
