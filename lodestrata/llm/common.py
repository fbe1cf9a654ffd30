"""Shared parts: hashing of words and bytes in NumPy, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Scratch  # noqa: F401

#: Bytes of text that a task turns into NumPy arrays at a time (a longer document is one piece by itself).
CHUNK_BYTES = 1 << 20


def tune(spark: SparkSession) -> None:
    """Arrow batches that stay small when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: Names of the two longs of a row's key.
KEY = ["k", "k2"]


def row_keys(*cols: str) -> list[Column]:
    """Two longs per row (128 bits): rows that agree in id and text are the same to every operator here, also where ids repeat
    or are null. A null is hashed as one, so it is unlike any value and a row of nulls in other places."""
    parts = [x for c in cols for x in (F.isnull(c), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def keyed(df: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """df with a row's key in two columns, and their names, which df does not have."""
    names = []
    for value, stem in zip(row_keys(*cols), ("row_key", "row_key_too")):
        names.append(free_name(df, stem))
        df = df.withColumn(names[-1], value)
    return df, names


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


# ---------------------------------------------------------------- hashing in NumPy

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Roller:
    """Polynomial hashes modulo 2**64 of any range of a sequence of 64-bit symbols, from prefix sums."""

    _pow = np.ones(1, np.uint64)
    _neg = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(Roller._pow) < n + 1:
            size = max(n + 1, 1 << 16)
            a = np.full(size, _MULT, np.uint64)
            b = np.full(size, _INV, np.uint64)
            a[0] = b[0] = 1
            Roller._pow, Roller._neg = np.multiply.accumulate(a), np.multiply.accumulate(b)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * Roller._pow[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Roller._neg[start] + (end - start).astype(np.uint64))

    def windows(self, width: int, spread: bool = True) -> np.ndarray:
        """Hashes of all windows of this width, by start; without spread only the high bits are any good."""
        n = len(self.sums) - 1 - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = (self.sums[width:] - self.sums[:n]) * Roller._neg[:n]
        return mix(out) if spread else out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of this width, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = width - have
    if rest:
        x = np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]
    return x


def pieces(column, limit: int = CHUNK_BYTES):
    """(first row, last row, bytes of their texts one after another, offsets) of an Arrow string or binary column, whole texts, null as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null(pa.scalar(b"", pa.large_binary()).cast(column.type))
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and the first word of each text (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.nonzero(start)[0], np.nonzero(end)[0] + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    values, out, i = _byte_values(fold), np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # a part of a very long text at a time
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * CHUNK_BYTES, "right")))
        base = starts[i]
        out[i:j] = Roller(values[data[base : ends[j - 1]]]).ranges(starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, as disjoint maximal spans in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.nonzero(new)[0]
    return start[first], reach[np.append(first[1:], len(start)) - 1]


# ---------------------------------------------------------------- graphs


def components(scratch: Scratch, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, root) for each node in an edge, root the smallest node reached.

    Labels take the smallest label among neighbours and then the label of their label (pointer jumping), so the rounds grow
    with the logarithm of a chain's length. Each round is a table in the shared folder; nothing but a flag comes to the driver.
    """
    pairs = edges.filter("a <> b")
    both = scratch.save(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{tag}-0")
    k = 0
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hop = labels.select(F.col("node").alias("h"), F.col("root").alias("far"))
        step = low.join(hop, low.root == hop.h, "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        after = scratch.save(step, f"{tag}-{k + 1}")
        done = after.filter("root <> old").limit(1).count() == 0
        scratch.drop(f"{tag}-{k}")
        k += 1
        labels = after.select("node", "root")
        if done:
            scratch.drop(f"{tag}-edges")
            return labels
