"""Best-fit packing under conflicts: documents fill sequences of a fixed length, and a bin takes no two documents of one source
and no two of one duplicate cluster.

Documents are dealt at random into shards of about `shard_rows`, whatever their source, and each shard is packed by itself,
longest first. Bins are ordered by residual. Each bin carries its sources and clusters as bitmaps over the shard's numbers;
bins of equal residual and equal source bitmap stand together. The successor search takes the smallest residual that is large
enough and at which some bin lacks the source, and goes on to the next until a bin also lacks the cluster. Bit sets over
residuals say at which residuals every bin holds a source, so a source that most bins hold costs no scan over them.
"""

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tune

CAPACITY = 2048
SHARD_ROWS = 20_000


class Bins:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.sources: list[int] = []  # bitmaps
        self.clusters: list[int] = []
        self.at: dict[int, dict[int, dict[int, None]]] = {}  # residual -> source bitmap -> bins, oldest first
        self.held: dict[int, dict[int, int]] = {}  # residual -> source -> bins that hold it
        self.total: dict[int, int] = {}
        self.some = 0  # bit r: some bin has residual r
        self.full: dict[int, int] = {}  # source -> bit r: every bin of residual r holds it

    @staticmethod
    def _bits(mask: int):
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    def _mark(self, r: int, mask: int) -> None:
        total, held = self.total.get(r, 0), self.held.get(r, {})
        for s in self._bits(mask):
            if total and held.get(s, 0) == total:
                self.full[s] = self.full.get(s, 0) | (1 << r)
            elif s in self.full:
                self.full[s] &= ~(1 << r)

    def _put(self, b: int) -> None:
        r, mask = self.residual[b], self.sources[b]
        groups = self.at.setdefault(r, {})
        other = next(iter(groups), 0)  # a source that all held before is in any bitmap there
        groups.setdefault(mask, {})[b] = None
        self.total[r] = self.total.get(r, 0) + 1
        held = self.held.setdefault(r, {})
        for s in self._bits(mask):
            held[s] = held.get(s, 0) + 1
        self.some |= 1 << r
        self._mark(r, mask | other)

    def _take(self, b: int) -> None:
        r, mask = self.residual[b], self.sources[b]
        groups = self.at[r]
        del groups[mask][b]
        if not groups[mask]:
            del groups[mask]
        self.total[r] -= 1
        held = self.held[r]
        for s in self._bits(mask):
            held[s] -= 1
        if not groups:
            self.some &= ~(1 << r)
        self._mark(r, mask | next(iter(groups), 0))

    def place(self, size: int, source: int, cluster: int) -> int:
        """The tightest compatible bin (the oldest among equal residuals of one kind), or a new one."""
        bit, twin = 1 << source, 1 << cluster
        able = (self.some & ~self.full.get(source, 0)) >> size
        r = size - 1
        while able:
            step = (able & -able).bit_length()
            r += step
            able >>= step
            for mask, group in self.at[r].items():
                if mask & bit:
                    continue
                for b in group:
                    if not self.clusters[b] & twin:
                        self._take(b)
                        self.residual[b] = r - size
                        self.sources[b] |= bit
                        self.clusters[b] |= twin
                        self._put(b)
                        return b
        b = len(self.residual)
        self.residual.append(self.capacity - size)
        self.sources.append(bit)
        self.clusters.append(twin)
        self._put(b)
        return b


def pack_items(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each (size, source number, cluster number), taken in this order."""
    bins = Bins(capacity)
    return [bins.place(*x) for x in items]


def _lengths(text_at: int):
    def run(batches):
        for batch in batches:
            n = [len(x.encode().split()) + 1 if x is not None else 1 for x in batch.column(text_at).to_pylist()]
            rest = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())], ["id", "source", "cluster", "n_tokens"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of a document: id, `piece`, `first_token`, `n_tokens`, source, `cluster`, `bin_id`, `bin_offset`.

    A document's length is its words and one end token, so a null or empty text has length 1. One longer than `capacity` is
    cut into full pieces, each alone in its bin, and a last piece that is packed. cluster_col names a column of equal values
    for documents that must not share a bin; without it, texts equal but for case are a cluster. Null sources are one
    source; null clusters and null texts conflict with nothing but themselves as documents. Ties in length go by id as text,
    then by place. Repeated rows are documents of one cluster. Every row of docs is in the result.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "packing")
    cluster = F.col(cluster_col) if cluster_col else F.lower(F.col(text_col))
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster"), F.col(text_col).alias("t"))
    sized = scratch.save(slim.mapInArrow(_lengths(3), "id string, source string, cluster long, n_tokens long"), "sized")
    shards = max(1, -(-sized.count() // shard_rows))
    dealt = sized.withColumn("place", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("id", "place"), F.lit(shards)))
    dealt = dealt.withColumn("cluster", F.coalesce("cluster", F.xxhash64(F.lit("alone"), "place")))

    def best_fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        source = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        number = pd.factorize(pdf["cluster"])[0]
        rows, items = [], []
        for i, n in enumerate(pdf["n_tokens"].tolist()):
            first = 0
            for piece in range(-(-n // capacity)):
                size = min(capacity, n - first)
                rows.append((i, piece, first, size))
                first += size
        id_rank = pdf["id"].rank(method="dense", na_option="top").astype(int).tolist()
        place = pdf["place"].tolist()
        rows.sort(key=lambda x: (-x[3], id_rank[x[0]], place[x[0]], x[1]))
        items = [(size, int(source[i]), int(number[i])) for i, _, _, size in rows]
        bins = pack_items(items, capacity)
        used: dict[int, int] = {}
        offsets = []
        for b, (_, _, _, size) in zip(bins, rows):
            offsets.append(used.get(b, 0))
            used[b] = offsets[-1] + size
        out = pdf.loc[[x[0] for x in rows], ["id", "source", "cluster"]].reset_index(drop=True)
        out["piece"], out["first_token"], out["n_tokens"] = ([x[j] for x in rows] for j in (1, 2, 3))
        out["bin_id"] = [(int(key[0]) << 32) + b for b in bins]
        out["bin_offset"] = offsets
        return out[["id", "piece", "first_token", "n_tokens", "source", "cluster", "bin_id", "bin_offset"]]

    packed = dealt.groupBy("shard").applyInPandas(best_fit, "id string, piece long, first_token long, n_tokens long, source string, cluster long, bin_id long, bin_offset long")
    return packed.select(F.col("id").cast(kind).alias(id_col), *packed.columns[1:])


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text", "source"))
