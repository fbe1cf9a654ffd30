"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts learnt from a bounded sample of labelled documents and then frozen.
A byte after a context costs -log2 of n(c,x)/(n(c)+t(c)) where t counts the distinct bytes seen there (method C); a byte not
seen there costs the escape t(c)/(n(c)+t(c)), divided by what the shorter context leaves once the bytes seen in the longer one
are excluded, and is coded in the shorter context; below order 0 all bytes are equal. Because the statistics are frozen, an
escape is a constant of its context, so a text's exact code length is a sum of table entries, looked up for whole batches.

ASCII letters and the two-byte Latin-1 capitals are folded to lower case. The context before a text is line feeds.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, pieces, tune

ORDER = 4
#: Bounds of the training sample, for each language.
TRAIN_DOCS, TRAIN_BYTES = 600, 400_000

#: Bytes that are turned into numbers at a time.
SLICE = 1 << 19

_LETTER = re.compile(r"[^\W\d_]")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fold(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 32
    return out


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """codes[d]: the d bytes before a position and the byte there, as one number."""
    code = data.astype(np.uint64)
    out = [code]
    size = np.diff(offsets)
    for j in range(1, order + 1):
        before = np.full(len(data), 10, np.uint64)
        before[j:] = data[:-j] if j <= len(data) else before[j:]
        for i in range(j):  # the first j bytes of a text look past its start
            before[offsets[:-1][size > i] + i] = 10
        code = code + (before << np.uint64(8 * j))
        out.append(code)
    return out


class Model:
    """Frozen trees of all languages: for each order a hash table of grams to code lengths and one of contexts to escapes."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        trees = [self._counts(samples[x], order) for x in self.languages]
        count = len(self.languages)
        base = np.log2(256.0)
        self.grams, self.escapes = [], []
        for d in range(order + 1):
            keys = np.unique(np.concatenate([t[d][0] for t in trees]))
            shorter = np.full((len(keys), count), base) if d == 0 else self._find(d - 1, keys & np.uint64((1 << (8 * d)) - 1))
            contexts = np.unique(keys >> np.uint64(8))
            cost, escape = shorter.copy(), np.zeros((len(contexts), count))
            for i, t in enumerate(trees):
                own, n = t[d]
                at = np.searchsorted(keys, own)
                where = np.searchsorted(contexts, own >> np.uint64(8))
                total, kinds, left = (np.zeros(len(contexts)) for _ in range(3))
                np.add.at(total, where, n)
                np.add.at(kinds, where, 1)
                np.add.at(left, where, 2.0 ** -shorter[at, i])
                seen = total > 0
                e = np.zeros(len(contexts))
                # Where a context has had all that the shorter one can give, the escape stays a tiny probability.
                e[seen] = -np.log2(kinds[seen] / (total[seen] + kinds[seen])) + np.log2(np.maximum(1 - left[seen], 1e-6))
                escape[:, i] = e
                cost[:, i] = shorter[:, i] + e[np.searchsorted(contexts, keys >> np.uint64(8))]
                cost[at, i] = -np.log2(n / (total + kinds)[where])
            self.grams.append(_Table(keys, cost))
            self.escapes.append(_Table(contexts, escape))

    @staticmethod
    def _counts(texts: list[bytes], order: int):
        data = fold(np.frombuffer(b"".join(texts), np.uint8))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        return [tuple(np.unique(c, return_counts=True)) for c in _codes(data, offsets, order)]

    def _find(self, d: int, codes: np.ndarray) -> np.ndarray:
        """Code lengths under order d at most, by language."""
        rows, hit = self.grams[d].rows(codes)
        out = self.grams[d].values[rows]
        miss = np.nonzero(~hit)[0]
        if len(miss):
            less = self._find(d - 1, codes[miss] & np.uint64((1 << (8 * d)) - 1)) if d else np.full((len(miss), len(self.languages)), np.log2(256.0))
            at, known = self.escapes[d].rows(codes[miss] >> np.uint64(8))
            out[miss] = less + np.where(known[:, None], self.escapes[d].values[at], 0)
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        data = fold(data)
        # A slice of bytes at a time, with the context before it: numbers take many times the size of a very long text.
        for a in range(0, len(data), SLICE):
            b, lo = min(a + SLICE, len(data)), max(a - self.order, 0)
            # A text that began before the slice gets the mark of a start within the context only.
            own = np.clip(offsets, lo, b)
            cost = self._find(self.order, _codes(data[lo:b], own - lo, self.order)[-1][a - lo :])
            edge = np.clip(offsets, a, b) - a
            full = np.nonzero(np.diff(edge))[0]
            out[full] += np.add.reduceat(cost, edge[full], axis=0, dtype=np.float64)
        return out


class _Table:
    """Open addressing with linear steps, looked up for arrays of keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY)
        self.at = np.zeros(1 << bits, np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == _EMPTY
            place = todo[free]
            self.keys[slots[place]] = keys[place]
            self.at[slots[place]] = place
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask
        self.values = values.astype(np.float32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key in values (0 where there is none), and whether there is one."""
        slot = self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        todo = np.nonzero(~hit & (found != _EMPTY))[0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            same = found == keys[todo]
            hit[todo[same]] = True
            todo = todo[~same & (found != _EMPTY)]
        row = self.at[slot]
        row[~hit] = 0
        return row, hit


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS, size: int = TRAIN_BYTES) -> Model:
    """Learns from at most `docs` distinct texts and `size` bytes of each language (a documented bound, however large the input):
    those with the smallest hashes, in their order, whole texts only; one that does not fit what is left of the bytes is passed
    over. A language without a text that fits is learnt from its shortest. Rows without a language or a text are not used."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).filter("l is not null and t is not null and t <> ''").withColumn("h", F.xxhash64("t"))
    # Copies count once: hashes are made distinct before anything is counted or ranked.
    scratch = Scratch(labelled.sparkSession, "langid")
    texts = scratch.save(rows.groupBy("l", "h").agg(F.min(F.octet_length("t")).alias("size")), "texts")
    found = texts.groupBy("l").agg(F.count_if(F.col("size") <= size).alias("n"), F.min(F.struct("size", "h"))["h"].alias("shortest")).collect()
    if not found:
        scratch.drop("texts")
        return Model({"und": [b" "]}, 0)
    wanted = {(r["l"], r["shortest"]): 0 for r in found if not r["n"]}
    fits = [r for r in found if r["n"]]
    if fits:
        # A cut on the hash leaves over three times the wanted texts of each language to rank, at any size of the input.
        cut = F.create_map(*(F.lit(x) for r in fits for x in (r["l"], min(1.0, (3.0 * docs + 100) / r["n"]))))
        ranked = texts.filter(F.col("size") <= size).withColumn("u", F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))).filter(F.col("u") <= cut[F.col("l")])
        order = Window.partitionBy("l").orderBy("u", "h")
        used: dict[str, int] = {}
        for r in sorted(ranked.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= docs).collect(), key=lambda r: r["i"]):
            if used.get(r["l"], 0) + r["size"] <= size:
                used[r["l"]] = used.get(r["l"], 0) + r["size"]
                wanted[(r["l"], r["h"])] = r["i"]
    scratch.drop("texts")
    # A few hundred keys for each language, so the texts are taken out where they lie.
    keys = labelled.sparkSession.createDataFrame([(*k, i) for k, i in wanted.items()], "l string, h long, i int")
    samples: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows.join(F.broadcast(keys), ["l", "h"]).groupBy("l", "i").agg(F.min("t").alias("t")).collect():
        samples.setdefault(r["l"], []).append((r["i"], r["t"].encode()))
    return Model({k: [x for _, x in sorted(v)] for k, v in samples.items()})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with `lang_pred`, `score` and `bits_per_byte`; such columns of docs are replaced.

    lang_pred is the language of the shortest code (the first in alphabetical order if equal) and `score` its posterior
    probability under equal priors; a text that is null, empty or without a letter is `und` with score 0 and no bits_per_byte.
    Repeated rows and null ids are rows like others; a very long text is read by slices, with the bytes before each.
    """
    tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    at = docs.columns.index(text_col)
    # By value, so that executors need no copy of this package; at most a few MB for each language, by the bound on its sample.
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    names = docs.columns

    def run(batches):
        model = pickle.loads(shared.value)
        tags = np.array(model.languages, dtype=object)
        for batch in batches:
            best, score, rate = [], [], []
            for a, b, data, offsets in pieces(batch.column(at), 1 << 19):
                bits = model.code_lengths(data, offsets)
                pick = bits.argmin(axis=1)
                low = bits[np.arange(len(bits)), pick]
                p = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                raw = data.tobytes()
                letter = np.array([bool(_LETTER.search(raw[x:y].decode())) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], bool)
                best += np.where(letter, tags[pick], "und").tolist()
                score += np.where(letter, p, 0.0).tolist()
                rate += [x / n if ok else None for x, n, ok in zip(low.tolist(), np.diff(offsets).tolist(), letter.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*names, "lang_pred", "score", "bits_per_byte"])

    schema = T.StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether a document is kept from training: crc32 of its id as text, modulo folds, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def digest(docs: DataFrame) -> DataFrame:
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
