"""Language-model scoring with a weighted backoff automaton.

States are the word sequences of up to order - 1 words that occur in training. From a state h a word w seen after it has an arc
of weight log10((c(h,w) + m * P(w|h')) / (c(h) + m)), where h' is h without its first word; for any other word a failure arc of
weight log10(m / (c(h) + m)) leads to h', down to the root, whose arcs are the smoothed word probabilities. The arcs of a state
and its failure arc add up to one (a Dirichlet prior of strength m). A text is one traversal from the state of its start to
its end token; every token takes the arc of the longest state that has it, after the failure arcs above.

The automaton of a large corpus fits no machine. Documents are dealt into blocks of bounded size and kept as word numbers; a
block sends the hashes and counts of its distinct n-grams, sorted, to ranges of the hash space, a range sums them over all
blocks and sends each block the corpus counts of just its n-grams, and each block builds the part of the automaton that its
documents can reach and traverses it. A gram in all documents comes to its range once per block. N-grams are told apart by 63
bits of hash.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, tune, word_bounds, word_hashes

ORDER = 3
#: Strength of the prior.
PRIOR = 20.0
ADD = 0.1
BLOCK_BYTES = 4 << 20
#: Parts in which the ranges are summed one after another, so that the grams on their way take a part of the disk.
WAVES = 8
#: Tokens that are traversed from one start: runs of a block go on side by side.
RUN = 256
#: Ranges of the hash space, and keys of a range that are summed at a time.
RANGES = 1024
SUMMED = 1 << 22

_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x369DEA0F31A53F85)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, an end token after each, and the place of each text's first token."""
    words, ends, first = [], [], 0
    i = 0
    while i < len(texts):
        raw, size = [], 0
        while i < len(texts) and (not raw or size < 1 << 20):  # bytes take several times their size as numbers
            raw.append(texts[i].encode() if isinstance(texts[i], str) else b"")
            size += len(raw[-1])
            i += 1
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        s, e, at = word_bounds(data, offsets)
        own = word_hashes(data, s, e, True) if len(s) else np.empty(0, np.uint64)
        words.append(np.insert(own, at[1:], _END))
        ends.append(first + at[1:] + np.arange(1, len(raw) + 1))
        first += len(words[-1])
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(words), np.concatenate([[0], *ends])[:-1]


def grams(words: np.ndarray, first: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length k: keys of the k-grams that end at each token, and of the states before them (empty for k = 1).
    Keys of single words are odd, all others even; the state before a text's first word stands for its start."""
    odd = np.uint64(1)
    keys, states = [words | odd], [np.empty(0, np.uint64)]
    for k in range(2, order + 1):
        before = np.empty_like(words)
        before[1:] = keys[-1][:-1]
        before[first] = _START & ~odd
        states.append(before)
        keys.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(k)) & ~odd)
    return keys, states


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's documents as numbers of its own words."""
    words, first = tokens(pdf["t"].tolist())
    vocab, index = np.unique(words, return_inverse=True)
    index = index.astype(np.uint16 if len(vocab) < 1 << 16 else np.uint32)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["id"].tolist()], "train": [pdf["train"].to_numpy(bool).tobytes()], "first": [first.astype(np.int64).tobytes()], "vocab": [vocab.tobytes()], "index": [index.tobytes()]})


def _unpack(train: bytes, first: bytes, vocab: bytes, index: bytes):
    vocab = np.frombuffer(vocab, np.uint64)
    index = np.frombuffer(index, np.uint16 if len(vocab) < 1 << 16 else np.uint32)
    return vocab[index], np.frombuffer(first, np.int64), np.frombuffer(train, bool)


def _small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, and those of 255 or more once again in full: most are small."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.uint64).tobytes()


def _counts(low: list[bytes], high: list[bytes]) -> np.ndarray:
    out = np.frombuffer(b"".join(low), np.uint8).astype(np.uint64)
    out[out == 255] = np.frombuffer(b"".join(high), np.uint64)
    return out


def _send(order: int, bits: int, wave: int):
    """A block's distinct n-grams in the ranges of this wave, with their counts in its training documents."""

    def run(batches):
        for batch in batches:
            for block, *blobs in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in range(1, 5))):
                words, first, train = _unpack(*blobs)
                weight = np.repeat(train, np.diff(np.append(first, len(words))))
                keys = np.concatenate([*grams(words, first, order)[0], [_START & ~np.uint64(1)]])
                part = lambda x: x >> np.uint64(64 - bits) if bits else x & np.uint64(0)
                mine = np.nonzero(part(keys) % np.uint64(WAVES) == wave)[0]
                if not len(mine):
                    continue
                weight = np.concatenate([*[weight] * order, [int(train.sum())]])
                own, place = np.unique(keys[mine], return_inverse=True)
                counts = np.bincount(place, weights=weight[mine], minlength=len(own)).astype(np.uint64)
                ranges, at = np.unique(part(own), return_index=True)
                cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(own)]))
                blobs = [[own[x:y].tobytes() for x, y in cuts], *zip(*(_small(counts[x:y]) for x, y in cuts))]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cuts), pa.int64()), pa.array(ranges.astype(np.int64)), *(pa.array(b, pa.binary()) for b in blobs)], ["block", "part", "keys", "low", "high"])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of each block's keys; block -1 has the tokens and the distinct tokens of training. A range is summed
    SUMMED keys at a time, by even cuts of the hashes in it."""
    keys = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
    own = [_counts([low], [high]) for low, high in zip(pdf["low"], pdf["high"])]
    least, most = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
    steps = max(1, -(-sum(map(len, keys)) // SUMMED))
    cuts = np.array([least + (most - least) * i // steps for i in range(1, steps)], np.uint64)
    edges = [[0, *np.searchsorted(k, cuts).tolist(), len(k)] for k in keys]
    words = kinds = 0
    for i in range(steps):
        parts = [slice(e[i], e[i + 1]) for e in edges]
        some, place = np.unique(np.concatenate([k[p] for k, p in zip(keys, parts)]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([n[p] for n, p in zip(own, parts)]), minlength=len(some)).astype(np.uint64)
        found, at = counts[place], 0
        for n, p in zip(own, parts):
            n[p] = found[at : at + p.stop - p.start]
            at += p.stop - p.start
        single = counts[(some & np.uint64(1)) == 1]
        words, kinds = words + int(single.sum()), kinds + int((single > 0).sum())
    part = pdf["part"].iloc[0]
    rows = [(b, part, *_small(n), 0, 0) for b, n in zip(pdf["block"], own)]
    rows.append((-1, part, b"", b"", words, kinds))
    return pd.DataFrame(rows, columns=["block", "part", "low", "high", "all_tokens", "kinds"])


def walk(words: np.ndarray, first: np.ndarray, keys: np.ndarray, counts: np.ndarray, order: int, all_tokens: int, kinds: int, prior: float):
    """Per text: tokens, known tokens, base score and automaton score. keys: sorted, with their corpus counts."""
    own, place = _places(words, first, order)
    return _walk(first, place, counts[np.searchsorted(keys, own)], order, all_tokens, kinds, prior)


def _places(words: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts and the start, and for each length and token its n-gram among them (the start last)."""
    return np.unique(np.concatenate([*grams(words, first, order)[0], [_START & ~np.uint64(1)]]), return_inverse=True)


def _walk(first: np.ndarray, place: np.ndarray, counts: np.ndarray, order: int, all_tokens: int, kinds: int, prior: float):
    start, at = place[-1], place[:-1].reshape(order, -1)
    size = at.shape[1]
    n = counts[at].astype(np.float64)
    root = (n[0] + ADD) / (all_tokens + ADD * (kinds + 1))
    # arc[k]: probability of the arc that reads the token from the state of the k words before it; leave[k]: weight of that
    # state's failure arc. A state is there if its words were seen, an arc if its words were seen with the token after them.
    arc, leave = [root], [None]
    for k in range(1, order):
        seen = np.empty(size)
        seen[1:] = n[k - 1][:-1]
        seen[first] = float(counts[start])
        arc.append((n[k] + prior * arc[-1]) / (seen + prior))
        leave.append(np.log10(prior / (seen + prior)))
    score = _traverse(first, [n[k] > 0 for k in range(order)], [np.log10(x) for x in arc], leave)
    sums = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has a token, its end
    return np.diff(np.append(first, size)), sums((n[0] > 0).astype(np.int64)), sums(np.log10(root)), sums(score)


def _traverse(first: np.ndarray, has: list[np.ndarray], arc: list[np.ndarray], leave: list[np.ndarray]) -> np.ndarray:
    """Log-probability of each token, from left to right with the state carried over.

    The state before a token is that of the longest seen sequence of up to order - 1 words that ends there, told by its length.
    From it failure arcs are taken down to a state with an arc for the token, or to the root; the arc leads to the state of its
    words and the token, without the first if these are too many. Texts are cut into runs that go on side by side; a run that
    begins inside a text reads the words before it from the root, which lead to the same state."""
    order, size = len(has), len(has[0])
    out = np.zeros(size)
    length = np.diff(np.append(first, size))
    runs = -(-length // RUN)
    text = np.repeat(np.arange(len(first)), runs)
    lo = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
    hi = np.minimum(lo + RUN, first[text] + length[text])
    inside = lo > first[text]
    at = np.where(inside, np.maximum(lo - (order - 1), first[text]), lo)
    # A text starts in the state of its start, the longest there is; so do the words read before a run near a text's start.
    state = np.where(at == first[text], order - 1, 0)
    by_length = np.argsort(at - hi)
    at, lo, hi, state = at[by_length], lo[by_length], hi[by_length], state[by_length]
    while len(at):
        total = np.zeros(len(at))
        k = state
        for j in range(order - 1, 0, -1):
            fails = np.nonzero((k == j) & ~has[j][at])[0]
            total[fails] += leave[j][at[fails]]
            k = np.where((k == j) & ~has[j][at], j - 1, k)
        for j in range(order):
            here = np.nonzero(k == j)[0]
            total[here] += arc[j][at[here]]
        out[at] = np.where(at >= lo, total, out[at])
        state = np.where((k == 0) & ~has[0][at], 0, np.minimum(k + 1, order - 1))
        at = at + 1
        left = int(np.searchsorted(at - hi, 0))  # longer runs come first
        at, lo, hi, state = at[:left], lo[:left], hi[:left], state[:left]
    return out


def _score(order: int, all_tokens: int, kinds: int, prior: float):
    def run(key: tuple, blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({"id": [], "train": [], "n_tokens": [], "n_known": [], "base": [], "score": []})
        words, first, train = _unpack(*(blocks[c].iloc[0] for c in ("train", "first", "vocab", "index")))
        _, place = _places(words, first, order)
        found = found.sort_values("part")
        n, known, base, score = _walk(first, place, _counts(found["low"], found["high"]), order, all_tokens, kinds, prior)
        return pd.DataFrame({"id": list(blocks["ids"].iloc[0]), "train": train, "n_tokens": n, "n_known": known, "base": base, "score": score})

    return run


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; train: a condition on rows of docs.

    Null and empty texts are one end token. Repeated rows are scored, and counted in training, each. Null ids take part. If no
    row is for training, every token has the same probability under base and model. An empty table gives no row. A text
    longer than a block is a block by itself, read by one task.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "lm")
    kind = dict(docs.dtypes)[id_col]
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("s"), F.count("*").alias("n")).first()
    blocks = max(1, -(-((size["s"] or 0) + 16 * size["n"]) // block_bytes))
    # The number of ranges stays the same from 2,048 blocks on, until a range would hold what sixteen blocks send: so what is
    # sent for a block is a fixed number of rows over that stretch.
    bits = (min(max(1, blocks // 2), max(RANGES, blocks // 16)) - 1).bit_length()
    # By place as well, so that repeated rows, and those of one partition, are dealt to all blocks.
    block = F.pmod(F.xxhash64(id_col, F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("t"), block.alias("block"))
    packed = scratch.save(rows.groupBy("block").applyInPandas(_pack, "block long, ids array<string>, train binary, first binary, vocab binary, index binary"), "blocks")
    scratch.reclaim()
    found = None
    for wave in range(WAVES):
        sent = packed.select("block", "train", "first", "vocab", "index").mapInArrow(_send(order, bits, wave), "block long, part long, keys binary, low binary, high binary")
        part = scratch.save(sent.groupBy("part").applyInPandas(_sum, "block long, part long, low binary, high binary, all_tokens long, kinds long"), f"counts-{wave}")
        found = part if found is None else found.union(part)
        scratch.reclaim()
    total = found.filter("block = -1").agg(F.sum("all_tokens").alias("n"), F.sum("kinds").alias("v")).first()
    all_tokens, kinds = total["n"] or 0, total["v"] or 0
    scored = packed.groupBy("block").cogroup(found.filter("block >= 0").select("block", "part", "low", "high").groupBy("block")).applyInPandas(_score(order, all_tokens, kinds, prior), "id string, train boolean, n_tokens long, n_known long, base double, score double")
    return scored.select(F.col("id").cast(kind).alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def digest(docs: DataFrame) -> DataFrame:
    from .langid import held_out

    return score(docs.select("doc_id", "text"), ~held_out(folds=10))
