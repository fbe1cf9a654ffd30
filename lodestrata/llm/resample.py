"""Target-distribution importance resampling over hashed word n-grams.

A text is scanned once. A ring keeps the running CRC-32 of the runs that began at the last n - 1 words; each word extends every
one of them by a space and its bytes and begins a run of its own, so all runs of 1 to n words that end there come out as hash
buckets and no run is ever put together. Only a row's counts by bucket go on: at most as many as there are buckets, however
long the text is. Corpus and target counts by bucket give each bucket a gain, a row's weight is the sum of its gains, and
Gumbel noise from a hash of its id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, tune

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of a text whose words are there at a time.
SLICE = 1 << 20

# Letters A-Z in lower case, digits, a-z and all beyond ASCII as they are; every other byte parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(raw: bytes, size: int = 0):
    """The words of a text, a list for each slice of it."""
    size, at = size or SLICE, 0
    while at < len(raw):
        part = raw[at : at + size].translate(_WORDS)
        if at + size < len(raw):
            end = part.rfind(b" ") + 1
            if not end:  # a word longer than a slice
                size *= 2
                continue
            part = part[:end]
        yield part.split()
        at += len(part)


class Ring:
    """CRC states of the runs that began at the last words, over the slices of one text."""

    def __init__(self, longest: int):
        self.open: list[int] = []
        self.most = longest - 1

    def feed(self, words: list[bytes]) -> list[int]:
        if not self.most:
            return list(map(crc32, words))
        out, states, most = [], self.open, self.most
        for word in words:
            tail = b" " + word
            states = [crc32(tail, s) for s in states]
            states.append(crc32(word))
            out += states
            if len(states) > most:
                del states[0]
        self.open = states
        return out


def _scan(at: int, names: list[str], longest: int, buckets: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            words, keys, counts = np.zeros(batch.num_rows, np.int64), [], []
            held: list[int] = []
            owner: list[int] = []

            def put():
                if held:
                    key, n = np.unique(np.repeat(np.array(owner[::2], np.int64), owner[1::2]) * buckets + np.array(held, np.int64) % buckets, return_counts=True)
                    keys.append(key)
                    counts.append(n)
                    held.clear()
                    owner.clear()

            for i in range(batch.num_rows):
                ring = Ring(longest)
                for part in words_of(texts[i].as_py() or b""):
                    words[i] += len(part)
                    found = ring.feed(part)
                    held += found
                    owner += (i, len(found))
                    if len(held) > SLICE // 4:
                        put()
            put()
            key, place = np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([*counts, np.empty(0)]), minlength=len(key)).astype(np.int64)
            edge = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * buckets).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in ((key % buckets).astype(np.int32), n)]
            yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(batch.columns) if j != at), pa.array(words), *lists], names)

    return run


def features(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, names: tuple[str, str, str] = ("n_words", "buckets", "counts")) -> DataFrame:
    """docs without the text, with the number of its words, its distinct buckets in order and how often each occurs.

    Words are runs of letters (A-Z in lower case), digits and all characters beyond ASCII; a null or empty text has none.
    Buckets are the unsigned CRC-32 of one to `longest` words joined by a space, modulo `buckets`."""
    tune(docs.sparkSession)
    kept = [f for f in docs.schema if f.name != text_col]
    schema = T.StructType(kept).add(names[0], "long").add(names[1], T.ArrayType(T.IntegerType())).add(names[2], T.ArrayType(T.LongType()))
    return docs.mapInArrow(_scan(docs.columns.index(text_col), schema.names, longest, buckets), schema)


def totals(rows: DataFrame, buckets: str = "buckets", counts: str = "counts") -> DataFrame:
    """(bucket, n) over all rows; each task sums its own rows first, to a row a bucket."""
    return rows.select(F.explode(F.arrays_zip(F.col(buckets).alias("b"), F.col(counts).alias("n"))).alias("x")).groupBy(F.col("x.b").alias("bucket")).agg(F.sum("x.n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def _weigh(at: tuple[int, int], names: list[str], gain: np.ndarray):
    def run(batches):
        for batch in batches:
            buckets, counts = (batch.column(i) for i in at)
            edge = buckets.offsets.to_numpy() - buckets.offsets[0].as_py()
            n = counts.flatten().to_numpy()
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])
            both = [pa.array(sums(x).astype(np.int64)) for x in (n, gain[buckets.flatten().to_numpy()] * n)]
            yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(batch.columns) if j not in at), *both], names)

    return run


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, keep_text: bool = True
) -> DataFrame:
    """docs with `n_features`, `weight`, `score` and `rank` (1 for the highest score; null for a row that is not drawn).

    Of the rows with at least `least_words` words, percent of a hundred (rounded down) are drawn; the others are weighed too. A
    null or empty text has no words: weight 0, never drawn. An empty target weighs every bucket by its rarity alone. Ties in
    score go to the smaller id, null ids first (their noise is that of an empty id), and among equal ids to any row, each with
    a rank of its own. Repeated rows count in the corpus and are drawn each for itself. Columns of these four names in docs
    are replaced; without keep_text the text is left out of the result, and out of every shuffle.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    docs = docs.drop("n_features", "weight", "score", "rank")
    text = free_name(docs, "scanned")
    own = tuple(free_name(docs, x) for x in ("n_words", "buckets", "counts"))
    rows = docs.withColumn(text, F.col(text_col)) if keep_text else docs.withColumnRenamed(text_col, text)
    rows = scratch.save(features(rows, text, longest, buckets, own), "features")
    aim = features(target.select(F.col(target_col).alias("text")), longest=longest, buckets=buckets)
    # A number for each bucket, so their bound is a parameter and not the input.
    corpus, goal = ({r["bucket"]: r["n"] for r in x.collect()} for x in (totals(rows, *own[1:]), totals(aim)))
    kept = [f for f in rows.schema if f.name not in own[1:]]
    schema = T.StructType(kept).add("n_features", "long").add("weight", "long")
    weighed = rows.mapInArrow(_weigh((rows.columns.index(own[1]), rows.columns.index(own[2])), schema.names, gains(corpus, goal, buckets)), schema)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0)))))

    # One sort by ranges; a row's place is that in its range and the rows of the ranges before. Rows equal in score and id
    # are spread by their place of origin.
    able, place = free_name(scored, "able"), free_name(scored, "place")
    order = [F.desc(able), F.desc("score"), F.asc_nulls_first(id_col)]
    scored = scored.withColumn(able, F.col(own[0]) >= least_words).withColumn(place, F.monotonically_increasing_id())
    dealt = scored.repartitionByRange(*order, F.asc(place)).sortWithinPartitions(*order, F.asc(place))
    dealt = scratch.save(dealt.withColumn(place, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(place), 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(able).alias("able"))
    before, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A row for each range.
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first__"), F.floor(F.sum("able").over(every) * percent / 100).alias("drawn__"))
    rank = F.col("first__") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = dealt.join(F.broadcast(sizes), part == F.col("part"))
    return out.select(*(dealt[c] for c in docs.columns if c in dealt.columns), "n_features", "weight", "score", F.when(F.col(able) & (rank <= F.col("drawn__")), rank).alias("rank"))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    out = resample(docs.select("doc_id", "text"), target, keep_text=False)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: For digest(): CRC-32 by bytes of every distinct word, over a table made by its rule.
ORACLE = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) AS t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS s FROM bits WHERE k = 8),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
vocab AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM e)),
crc AS (
  SELECT w, (xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT), lambda a, x: xor(a >> 8, s[(xor(a & 255, x) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000)::BIGINT AS b
  FROM vocab, steps),
own AS (SELECT b, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY b),
goal AS (SELECT b, count(*) AS t FROM e JOIN crc USING (w) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM own)::DOUBLE + 10000) / ((s::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM goal)::DOUBLE + 10000))))::BIGINT AS g
  FROM own LEFT JOIN goal USING (b)),
weighed AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= floor(10 * n / 100) THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
