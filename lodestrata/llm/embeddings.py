"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of a label with cosine >= t differ by a squared distance of at most 2 - 2t. A fixed rotation spreads it, and the
coordinates are split into blocks; by the pigeonhole principle a linked pair has some block in which it keeps within the
block's proportional share of that budget. Each block is range-joined: vectors are sorted into slabs of the block's first
coordinate, as wide as the block's radius, so a pair within the radius lies in one slab or in two that touch. A pair is
taken up in the first block that admits it and is verified there in double precision on the vectors as given.

Slabs are cut into tiles of bounded size and compared tile by tile, so no slab, label or vector is too hot for a task. Equal
vectors are one class with a count. Comparisons give sums of links and the edges of a spanning forest of each tile pair.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Scratch, components, free_name, keyed, tune

THRESHOLD = 0.93
BLOCKS = 4
TILE = 4096
_SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A fixed orthonormal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def bounds(dims: int, blocks: int) -> list[tuple[int, int]]:
    blocks = min(blocks, dims)
    edge = [dims * i // blocks for i in range(blocks + 1)]
    return list(zip(edge[:-1], edge[1:]))


def budgets(dims: int, blocks: int, threshold: float) -> list[float]:
    """Squared distance that a block may take, in proportion to its dimensions."""
    return [(2 - 2 * threshold) * (b - a) / dims + _SLACK for a, b in bounds(dims, blocks)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _slabs(blocks: int, threshold: float):
    def run(batches):
        for batch in batches:
            names = {n: i for i, n in enumerate(batch.schema.names)}
            dims = batch.column(names["dims"]).to_numpy()
            nodes, labels = batch.column(names["node"]), batch.column(names["label"])
            counts, flat = batch.column(names["n"]), batch.column(names["x"])
            for d in np.unique(dims):
                rows = pa.array(np.nonzero(dims == d)[0])
                x = np.frombuffer(b"".join(flat.take(rows).to_pylist()), np.float64).reshape(-1, int(d))
                turned = _unit(x) @ rotation(int(d))
                for b, ((lo, _), budget) in enumerate(zip(bounds(int(d), blocks), budgets(int(d), blocks, threshold))):
                    slab = np.floor(turned[:, lo] / np.sqrt(budget)).astype(np.int64)
                    n = len(x)
                    yield pa.RecordBatch.from_arrays([nodes.take(rows), labels.take(rows), pa.array(np.full(n, d, np.int32)), counts.take(rows), pa.array(np.full(n, b, np.int32)), pa.array(slab), flat.take(rows)], ["node", "label", "dims", "n", "block", "slab", "x"])

    return run


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _compare(blocks: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dims, block, same = int(pdf["dims"].iloc[0]), int(pdf["block"].iloc[0]), bool(pdf["same"].iloc[0])
        x = np.frombuffer(b"".join(pdf["x"]), np.float64).reshape(-1, dims)
        node, n = pdf["node"].to_numpy(), pdf["n"].to_numpy()
        unit = _unit(x)
        turned = unit @ rotation(dims)
        cuts, limit = bounds(dims, blocks), budgets(dims, blocks, threshold)
        lo, hi = cuts[block]
        side = pdf["side"].to_numpy()
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0] if not same else np.nonzero(side == 0)[0]
        part = turned[:, lo:hi]
        norm = (part * part).sum(axis=1)
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        for a in range(0, len(left), 256):
            mine = left[a : a + 256]
            near = norm[mine][:, None] + norm[right][None, :] - 2 * part[mine] @ part[right].T <= limit[block] + 1e-9
            i, j = np.nonzero(near)
            i, j = mine[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 15):
                p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                gap = (turned[p] - turned[q]) ** 2
                first = np.full(len(p), -1)
                for b in range(len(cuts) - 1, -1, -1):
                    first[gap[:, cuts[b][0] : cuts[b][1]].sum(axis=1) <= limit[b]] = b
                ok = (first == block) & ((unit[p] * unit[q]).sum(axis=1) >= threshold)
                p, q = p[ok], q[ok]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                for u, v in zip(p.tolist(), q.tolist()):
                    u, v = _find(parent, u), _find(parent, v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
        hit = np.nonzero(links)[0]
        root = np.array([_find(parent, int(u)) for u in hit], np.int64)
        return pd.DataFrame({"node": node[hit], "links": links[hit], "root": node[root]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """vectors with `n_links`, `component_id` and `kept`; columns of these names in vectors are replaced.

    Vectors link if their labels are equal and not null, their dimensions are equal and their cosine in double precision is at
    least threshold. One that is null, empty, zero or has a null or non-finite component links with nothing, so its
    component_id is its own id. Repeated rows are vectors of their own, each linked with the others. Null ids take part; a
    component without an id has a null component_id and its rows are kept.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "embeddings")
    vectors = vectors.drop("n_links", "component_id", "kept")
    value = F.col(vector_col).cast("array<double>")
    big = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    usable = F.col(label_col).isNotNull() & value.isNotNull() & F.forall(value, lambda v: v.isNotNull() & ~big(v)) & F.exists(value, lambda v: v != 0)
    kinds = F.col(label_col).cast("string")
    # Equal vectors of a label are a class with a key of 128 bits, summed in each task before they meet; a class has a number of its own.
    tagged = vectors.withColumn(keep := free_name(vectors, "usable"), F.coalesce(usable, F.lit(False))).withColumn(name := free_name(vectors, "label_text"), kinds).withColumn(cast := free_name(vectors, "as_doubles"), value)
    tagged, key = keyed(tagged, name, cast)
    pack = tagged.filter(keep).select(*(F.col(a).alias(b) for a, b in zip(key, KEY)), F.col(name).alias("label"), F.col(cast).alias("v"), F.col(id_col).alias("id"))
    classes = pack.groupBy(*KEY, "label", "v").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    classes = classes.mapInArrow(_to_bytes, f"k long, k2 long, label string, dims int, n long, low {dict(vectors.dtypes)[id_col]}, x binary")
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    slabs = scratch.save(classes.select("node", "label", "dims", "n", "x").mapInArrow(_slabs(blocks, threshold), "node long, label string, dims int, n long, block int, slab long, x binary"), "slabs")
    keys = ["label", "dims", "block", "slab"]
    tiles = scratch.save(slabs.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "tiles")
    beside = lambda step, name: tiles.select("label", "dims", "block", (F.col("slab") + step).alias("slab"), F.col("tiles").alias(name))
    # A slab meets itself and the next one; a tile of it meets each tile there once.
    placed = slabs.join(tiles, keys).join(beside(-1, "next"), keys, "left").join(beside(1, "last"), keys, "left")
    placed = placed.withColumn("i", F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int"))
    own = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("k"))
    within = own.select("node", "n", "x", *keys, F.least("i", "k").alias("a"), F.greatest("i", "k").alias("b"), (F.col("i") == F.col("k")).alias("same"), F.when(F.col("i") <= F.col("k"), 0).otherwise(1).alias("side"))
    ahead = placed.filter("next is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("next") - 1)).alias("k")).select("node", "n", "x", *keys, F.col("i").alias("a"), (-1 - F.col("k")).alias("b"), F.lit(False).alias("same"), F.lit(0).alias("side"))
    behind = placed.filter("last is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("k")).select("node", "n", "x", "label", "dims", "block", (F.col("slab") - 1).alias("slab"), F.col("k").alias("a"), (-1 - F.col("i")).alias("b"), F.lit(False).alias("same"), F.lit(1).alias("side"))
    found = within.union(ahead).union(behind).groupBy(*keys, "a", "b").applyInPandas(_compare(blocks, threshold), "node long, links long, root long")
    found = scratch.save(found, "found")
    scratch.drop("slabs", "tiles")
    roots = components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = classes.select(*KEY, "node", "n", "low").join(sums, "node", "left").join(roots, "node", "left").select(*KEY, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root"), "low")
    least = labels.groupBy("root").agg(F.min("low").alias("component"))
    result = labels.join(least, "root").select(*KEY, "links", "component")
    out = tagged.join(result, [tagged[keep], *(tagged[a] == result[b] for a, b in zip(key, KEY))], "left")
    component = F.when(~tagged[keep], vectors[id_col]).otherwise(F.col("component"))
    return out.select(*(vectors[c] for c in vectors.columns), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(vectors[id_col] == component, component.isNull()).alias("kept"))


def _to_bytes(batches):
    for batch in batches:
        names = {n: i for i, n in enumerate(batch.schema.names)}
        v = batch.column(names["v"])
        data = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        edge = v.offsets.to_numpy() - v.offsets[0].as_py()
        x = [data[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(names[k]) for k in KEY), batch.column(names["label"]), pa.array(np.diff(edge).astype(np.int32)), batch.column(names["n"]), batch.column(names["low"]), pa.array(x, pa.binary())], [*KEY, "label", "dims", "n", "low", "x"])


def digest(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


#: For digest(): all pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
JOIN (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x) USING (vec_id)
"""
