"""MinHash near-dedup with sequential Bayesian verification.

1. every text becomes its set of word shingles; texts with equal sets are one class and are compared once;
2. a class has `bands * rows` MinHash values; classes that agree in a band of `rows` values share a bucket;
3. pairs from buckets are verified in turn: signatures are compared batch by batch, and after each batch a pair is dropped
   when the posterior probability (uniform prior) that its similarity reaches the threshold is below `miss`; survivors are
   confirmed on the full sets;
4. confirmed links make components.

A bucket gives a star, not all its pairs: its members are first compared with one pivot, dealt with a salt so that those of a
hot pivot are compared in many tasks. Most buckets are one component then. In the others every pair of members of different
components is still compared, so that no link between components is lost: the members outside the largest component meet it
and each other in blocks, inside tasks, each pair in the first band it shares, and only the links found come out.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Roller, Scratch, components, keyed, mix, pieces, row_keys, signed, tune, word_bounds, word_hashes

BANDS, ROWS = 32, 5
MISS = 1e-6
BATCH = 32
#: Members of a bucket in one task of the second round, twice.
BLOCK = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words has none."""
    s, e, first = word_bounds(data, offsets)
    roll = Roller(word_hashes(data, s, e, True))
    grams = roll.windows(words)
    n = np.diff(first)
    short = np.nonzero((n > 0) & (n < words))[0]
    whole = roll.ranges(first[short], first[short + 1])
    out = [np.unique(grams[a : b - words + 1]) if b - a >= words else grams[:0] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    for i, h in zip(short.tolist(), whole):
        out[i] = np.array([h], np.uint64)
    return out


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(977).integers(1, 2**63, count, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _sign(words: int, count: int):
    def run(batches):
        factors = _multipliers(count)
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(3)):
                sets = shingle_sets(data, offsets, words)
                n = np.array([len(x) for x in sets])
                sig = np.zeros((len(sets), count), np.uint16)
                full = np.nonzero(n)[0]
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for j, f in enumerate(factors):
                        # Mixed, as the least of many numbers is small. Two unlike values agree once in 65,536 times, which never prunes a pair.
                        sig[full, j] = mix(np.minimum.reduceat(flat * f, at)) >> np.uint64(48)
                prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(3)), pa.array(n.astype(np.int64)), pa.array(prints, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", *KEY, "n", "print", "sig"])

    return run


def _bands(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.uint64)
            keys = batch.column(0).to_numpy()
            for j in range(bands):
                h = np.full(len(sig), j + 1, np.uint64)
                for c in range(j * rows, (j + 1) * rows):
                    h = mix(h * np.uint64(0x100000001B3) + sig[:, c])
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.full(len(h), j, np.int32)), pa.array(keys)], ["bucket", "band", "k"])

    return run


def least_matches(count: int, threshold: float, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(compared, least matches to go on): with m of n equal, similarity is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m)."""
    out = []
    for n in range(batch, count + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _against_pivot(judge):
    """Streams rows (g, salt, role, id, payload) in order: each pivot row is followed by the rows to compare with it."""

    def run(batches):
        group, pivot = None, None
        for batch in batches:
            g, salt, role, ids, load = (batch.column(i) for i in range(5))
            ga, sa, ra, ia = (x.to_numpy() for x in (g, salt, role, ids))
            left, right = [], []
            for i in range(batch.num_rows):
                if ra[i] == 0:
                    group, pivot = (ga[i], sa[i]), judge(load[i].as_py(), None)
                elif group == (ga[i], sa[i]) and judge(load[i].as_py(), pivot):
                    left.append(ga[i])
                    right.append(ia[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["p", "k"])

    return run


def _star(pairs: DataFrame, loads: DataFrame, judge) -> DataFrame:
    """The pairs (p, k) that judge(load of k, judge(load of p, None)) accepts; loads: (id, load)."""
    salts = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.select(F.col("p").alias("g"), F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("k").alias("id"))
    heads = dealt.select("g", "salt").distinct().select("g", "salt", F.lit(0).alias("role"), F.col("g").alias("id"))
    rows = dealt.union(heads).join(loads.hint("merge"), "id").select("g", "salt", "role", "id", "load")
    return rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "role", "id").mapInArrow(_against_pivot(judge), "p long, k long")


def _by_signature(count: int, threshold: float, miss: float):
    steps = least_matches(count, threshold, miss)

    def judge(load, pivot):
        sig = np.frombuffer(load, np.uint16)
        if pivot is None:
            return sig
        same, last = 0, 0
        for n, least in steps:
            same += int(np.count_nonzero(sig[last:n] == pivot[last:n]))
            if same < least:
                return False
            last = n
        return True

    return judge


def _by_sets(words: int, percent: int):
    def judge(load, pivot):
        data = np.frombuffer(load.encode(), np.uint8)
        own = shingle_sets(data, np.array([0, len(data)]), words)[0]
        if pivot is None:
            return own
        both = len(np.intersect1d(own, pivot, assume_unique=True))
        return 100 * both >= percent * (len(own) + len(pivot) - both)

    return judge


def _close(pdf: pd.DataFrame, bands: int, threshold: float, miss: float):
    """(i, others) of rows of two blocks of a bucket: members of other components that the signatures leave as candidates."""
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), -1)
    steps = least_matches(sig.shape[1], threshold, miss)
    side, roots = pdf["side"].to_numpy(), pdf["root"].to_numpy()
    band = int(pdf["band"].iloc[0])
    alone = bool(pdf["b"].iloc[0] == -1 - pdf["a"].iloc[0])
    left = np.nonzero(side == 0)[0]
    right = left if alone else np.nonzero(side == 1)[0]
    for i in left.tolist():
        other = right[right > i] if alone else right
        other = other[roots[other] != roots[i]]
        if not len(other):
            continue
        same = sig[other] == sig[i]
        # A pair that shares several bands is taken up in the first.
        ok = same.reshape(len(other), bands, -1).all(axis=2).argmax(axis=1) == band
        last, matches = 0, np.zeros(len(other), np.int64)
        for n, least in steps:
            matches += same[:, last:n].sum(axis=1)
            ok &= matches >= least
            last = n
        if ok.any():
            yield i, other[ok]


def _candidates(bands: int, threshold: float, miss: float):
    """The members of two blocks that have a candidate there, by signatures alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(pdf), bool)
        for i, other in _close(pdf, bands, threshold, miss):
            hit[i] = True
            hit[other] = True
        return pdf.loc[hit, ["bucket", "band", "k", "root", "a", "b", "side"]]

    return run


def _blocks(words: int, percent: int, bands: int, miss: float):
    """Links between components among the members of two blocks of a bucket, without those that follow from others found here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        roots, texts, keys = pdf["root"].to_numpy(), pdf["load"].tolist(), pdf["k"].to_numpy()
        parent = {r: r for r in roots.tolist()}

        def find(r):
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        sets: dict[int, np.ndarray] = {}

        def of(i):
            if i not in sets:
                data = np.frombuffer(texts[i].encode(), np.uint8)
                sets[i] = shingle_sets(data, np.array([0, len(data)]), words)[0]
            return sets[i]

        out = []
        for i, other in _close(pdf, bands, percent / 100, miss):
            for j in other.tolist():
                a, b = find(roots[i]), find(roots[j])
                if a == b:
                    continue
                x, y = of(i), of(j)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    parent[a] = b
                    out.append((keys[i], keys[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """docs with `n_shingles`, `component_id` (smallest id reachable) and `kept` (id = component_id); such columns of docs are replaced.

    A null or empty text and one without words has no shingles and links with nothing. Ties: equal texts are one component.
    Repeated rows carry the same result each. Rows with a null id take part; a component without any id has a null
    component_id and its rows are kept. A very long text is one set: its words are hashed a part at a time, and it is one cell.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "minhash")
    count = bands * rows
    docs = docs.drop("n_shingles", "component_id", "kept")
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), *(x.alias(n) for x, n in zip(row_keys(id_col, text_col), KEY)), F.col(text_col).alias("t"))
    signed_docs = scratch.save(base.mapInArrow(_sign(words, count), f"id {kind}, k long, k2 long, n long, print binary, sig binary"), "signed")
    # A class is known by the key of one of its rows, and in the graph by a number of its own (k from here on).
    classes = signed_docs.filter("n > 0").groupBy("print").agg(F.min(F.struct(*KEY)).alias("row"), F.min("id").alias("low"))
    classes = scratch.save(classes.select("print", "row.*", "low", F.monotonically_increasing_id().alias("node")), "classes")
    heads = classes.select(*KEY, F.col("node").alias("id"))
    sigs = signed_docs.select(*KEY, "sig").join(heads, KEY).dropDuplicates(KEY).select(F.col("id").alias("k"), "sig")
    sigs = scratch.save(sigs, "sigs")
    marks = scratch.save(signed_docs.drop("sig"), "marks")
    scratch.drop("signed")
    loads = sigs.select(F.col("k").alias("id"), F.col("sig").alias("load"))
    texts = base.select(*KEY, F.col("t").alias("load"))

    bucketed = scratch.save(sigs.mapInArrow(_bands(bands, rows), "bucket long, band int, k long"), "bands")
    crowded = scratch.save(bucketed.groupBy("bucket").agg(F.count("*").alias("c"), F.min("k").alias("p")).filter("c > 1"), "crowded")
    members = scratch.save(bucketed.join(crowded.hint("merge"), "bucket").select("bucket", "band", "k", "p"), "members")
    pairs = scratch.save(members.filter("k <> p").select("p", "k").distinct(), "pairs")
    scratch.drop("bands", "crowded")

    # The texts of all that share a bucket are taken out once. How many grows with the input, so they are never broadcast.
    wanted = pairs.select(F.col("p").alias("id")).union(pairs.select(F.col("k").alias("id"))).distinct()
    wanted = heads.join(wanted, "id")
    own = scratch.save(texts.join(wanted.hint("merge"), KEY).dropDuplicates(KEY).select("id", "load"), "texts")
    scratch.reclaim()
    likely = scratch.save(_star(pairs, loads, _by_signature(count, percent / 100, miss)), "likely")
    scratch.reclaim()
    stars = scratch.save(_star(likely, own, _by_sets(words, percent)).select(F.col("p").alias("a"), F.col("k").alias("b")), "stars")
    scratch.drop("pairs", "likely")
    scratch.reclaim()

    first = scratch.save(components(scratch, stars, "cc-stars"), "star-roots")
    placed = members.join(first, members.k == first.node, "left").select("bucket", "band", "k", F.coalesce("root", "k").alias("root"))
    split = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1 and n > 2")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rest = placed.join(split, "bucket").select("bucket", "band", "k", "root", (F.col("root") == F.col("main")).alias("main"), blocks(F.col("n_main")).alias("mains"), blocks(F.col("n") - F.col("n_main")).alias("sides"))
    rest = rest.withColumn("i", F.pmod(F.xxhash64("k", F.lit(7)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("sides"))).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("j")
    row = ["bucket", "band", "k", "root"]
    # Members outside a bucket's largest component meet it and each other, a block of each at a time.
    dealt = rest.filter("main").select(*row, "i", every("sides")).select(*row, F.col("j").alias("a"), F.col("i").alias("b"), F.lit(1).alias("side"))
    dealt = dealt.union(rest.filter("not main").select(*row, "i", every("mains")).select(*row, F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).alias("side")))
    own_side = rest.filter("not main").select(*row, "i", every("sides")).select(*row, F.least("i", "j").alias("a"), (-1 - F.greatest("i", "j")).alias("b"), F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"))
    dealt = scratch.save(dealt.union(own_side), "dealt")
    # Signatures alone say which members may link; texts are brought to those.
    signs = sigs.join(dealt.select("k").distinct().hint("merge"), "k")
    # Pairs of blocks are few bytes and much work: a given number of partitions keeps them from being put together.
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    close = dealt.join(signs.hint("merge"), "k").repartition(spread, "bucket", "a", "b").groupBy("bucket", "a", "b").applyInPandas(_candidates(bands, percent / 100, miss), "bucket long, band int, k long, root long, a long, b long, side int")
    close = scratch.save(close, "close")
    scratch.reclaim()
    rows = close.join(sigs.hint("merge"), "k").join(own.withColumnRenamed("id", "k").hint("merge"), "k")
    found = rows.repartition(spread, "bucket", "a", "b").groupBy("bucket", "a", "b").applyInPandas(_blocks(words, percent, bands, miss), "a long, b long")
    more = scratch.save(found, "more")
    scratch.drop("members", "dealt", "close", "texts", "star-roots")
    roots = scratch.save(components(scratch, stars.union(more)), "roots")

    low = classes.join(roots, classes.node == roots.node, "left").select("print", "low", F.coalesce(roots.root, classes.node).alias("root"))
    least = low.groupBy("root").agg(F.min("low").alias("component"))
    by_print = low.join(least, "root").select("print", "component")
    found = marks.select(*KEY, "n", "print").dropDuplicates(KEY).join(by_print, "print", "left").select(*KEY, "n", "component")
    out, names = keyed(docs, id_col, text_col)
    out = out.join(found, [out[a] == found[b] for a, b in zip(names, KEY)])
    component = F.when(F.col("n") == 0, F.col(id_col)).otherwise(F.col("component"))
    return out.select(*(docs[c] for c in docs.columns), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(docs[id_col] == component, component.isNull()).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


#: For digest(): all pairs that share a shingle, and components over the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s FROM w),
sh AS (SELECT doc_id, unnest(s) AS t FROM sets),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM both_ JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""
