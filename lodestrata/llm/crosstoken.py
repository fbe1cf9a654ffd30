"""Alignment of the tokens of two tokenizers, and corpus counts of the token pairs that overlap.

The tokens of both over one text are the two sides of a graph; two are linked where their byte ranges overlap. Its connected
components, found by union-find, are exactly the smallest groups of tokens that both tokenizers end together.

A space between two other characters is an end of tokens for both: the byte-level pattern never reads white space after
anything else within one piece, and no entry of the other vocabulary has a space after another character (checked as it is
loaded). So a text is a row of units, each a word with its marks, and every distinct unit of a block of texts is encoded,
linked and grouped once. A block sends its distinct pairs, with the documents that hold them, to be summed over the corpus;
the sums come back to the block, never to a document, and its documents are added up over their units.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, tune

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text in a block; a longer text is a block by itself.
BLOCK_CHARS = 4 << 20
#: Characters of a text that are cut into units at a time.
PART_CHARS = 1 << 20
#: Units encoded as one row, and rows encoded at a time.
ROW_UNITS, BATCH_ROWS = 1000, 16

_CUT = re.compile(r"(?<=\S) (?=\S)")


def units(text: str, size: int = 0):
    """The units of a text, a list for each part of it; joined by one space they are the text."""
    size, at = size or PART_CHARS, 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield _CUT.split(text[at : cut.start()])
        at = cut.end()
    yield _CUT.split(text[at:])


class Vocabulary:
    """An encoder and the bytes of its tokens."""

    def __init__(self, encode, entries: list[bytes], row: int = 1):
        self.encode, self.row = encode, row
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def tokens(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and how many each has; raw: the bytes they are to spell.

        Units without white space at an end may be encoded in rows joined by spaces, for each of their ends is an end of
        tokens there too; where it isn't, as in a row with a character that is not spelt, they are encoded one by one."""
        bare = np.fromiter((self.row > 1 and t == t.strip() for t in texts), bool, len(texts))
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        at, single = np.nonzero(bare)[0], np.nonzero(~bare)[0].tolist()
        ids, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        rows = np.split(at, np.arange(self.row, len(at), self.row))
        for lo in range(0, len(rows), BATCH_ROWS):
            batch = [r for r in rows[lo : lo + BATCH_ROWS] if len(r)]
            for row, found in zip(batch, self.encode([" ".join([texts[i] for i in r.tolist()]) for r in batch])):
                found = np.array(found, np.int64)
                end, want = np.cumsum(self.size[found]), np.cumsum(length[row])
                last = np.searchsorted(end, want)
                if last[-1] != len(end) - 1 or not np.array_equal(end[last], want):
                    single += row.tolist()
                    continue
                ids.append(found)
                owner.append(np.repeat(row, np.diff(last, prepend=-1)))
        for lo in range(0, len(single), ROW_UNITS * BATCH_ROWS):
            some = single[lo : lo + ROW_UNITS * BATCH_ROWS]
            found = self.encode([texts[i] for i in some])
            ids.append(np.fromiter(chain.from_iterable(found), np.int64))
            owner.append(np.repeat(np.array(some, np.int64), [len(x) for x in found]))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        if single and len(at):
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids, np.bincount(owner, minlength=len(texts))

    def spells(self, ids: np.ndarray, n: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each text are its bytes."""
        owner, size = np.repeat(np.arange(len(n)), n), self.size[ids]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        ok = np.bincount(owner, weights=size, minlength=len(n)).astype(np.int64) == length
        ids, size = ids[ok[owner]], size[ok[owner]]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        want = np.frombuffer(b"".join(x for x, y in zip(raw, ok.tolist()) if y), np.uint8)
        wrong = np.repeat(np.nonzero(ok)[0], length[ok])[self.flat[at] != want]
        ok[wrong] = False
        return ok


def byte_level(spec: str) -> Vocabulary:
    """A byte-level byte-pair vocabulary; texts get a space before them, and names of special tokens are plain text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one of many on its machine
    coder = Tokenizer.from_str(spec)
    coder.encode_special_tokens = True
    # Bytes that print stand for themselves in entries, the others for the characters from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = json.loads(spec)["model"]["vocab"]
    entries = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        entries[i] = bytes(byte.get(c, 0) for c in word)
    return Vocabulary(lambda texts: [x.ids for x in coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], entries, ROW_UNITS)


def pieces(model: bytes) -> Vocabulary:
    """A vocabulary of pieces with bytes to fall back to, which adds the space itself."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_proto=model)
    entries = []
    for i in range(coder.get_piece_size()):
        piece = coder.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError("an entry goes on after a space, so texts can't be taken in units")
        silent = coder.is_control(i) or coder.is_unknown(i)
        entries.append(b"" if silent else bytes([int(piece[3:5], 16)]) if coder.is_byte(i) else piece.replace("▁", " ").encode())
    return Vocabulary(lambda texts: coder.encode(texts, num_threads=1), entries)


def union_find(nodes: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component under the links x[i] - y[i].

    All links are taken at a time: the larger root of each goes under the smaller, then every path is halved until nodes point
    at roots. A root that stays has no smaller neighbour, so at least half of a component's roots go in each round."""
    parent = np.arange(nodes)
    while len(x):
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        parent[np.maximum(x, y)] = np.minimum(x, y)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


class Links:
    """Tokens, links and groups of distinct units; a unit that either vocabulary does not spell has none."""

    def __init__(self, a: Vocabulary, b: Vocabulary, texts: list[str]):
        raw = [b" " + t.encode() for t in texts]
        (a_ids, a_n), (b_ids, b_n) = a.tokens(texts, raw), b.tokens(texts, raw)
        self.spelt = a.spells(a_ids, a_n, raw) & b.spells(b_ids, b_n, raw)
        count, kinds = len(texts), len(b.size)
        a_unit, b_unit = np.repeat(np.arange(count), a_n), np.repeat(np.arange(count), b_n)
        a_ids, b_ids, a_unit, b_unit = a_ids[self.spelt[a_unit]], b_ids[self.spelt[b_unit]], a_unit[self.spelt[a_unit]], b_unit[self.spelt[b_unit]]
        # Units that are spelt have as many bytes on both sides, so places count through all of them.
        a_end, b_end = np.cumsum(a.size[a_ids]), np.cumsum(b.size[b_ids])
        low = np.searchsorted(b_end, a_end - a.size[a_ids], "right")
        n = np.searchsorted(b_end - b.size[b_ids], a_end, "left") - low
        left = np.repeat(np.arange(len(a_ids)), n)
        right = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(left))
        root = union_find(len(a_ids) + len(b_ids), left, right + len(a_ids))
        heads = root[: len(a_ids)] == np.arange(len(a_ids))  # a component's first token of A comes before all its others
        group = np.cumsum(heads) - 1
        a_group, b_group = group[root[: len(a_ids)]], group[root[len(a_ids) :]]
        self.sizes = np.stack([np.bincount(u, minlength=count) for u in (a_unit, b_unit, a_unit[heads], a_unit[left])], axis=1)
        self.pairs, self.place = np.unique(a_ids[left] * kinds + b_ids[right], return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(self.sizes[:, 3])])
        groups = int(heads.sum())
        self.a_ids, self.b_ids = a_ids, b_ids
        self.a_in, self.b_in = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)

    @staticmethod
    def marks(a_ids: np.ndarray, b_ids: np.ndarray, a_in: np.ndarray, b_in: np.ndarray, unit: np.ndarray, count: int) -> list[str]:
        """The groups of each of count units as text, `a1,a2|b1;` for each; a group has a_in and b_in tokens and is in a unit."""
        a_group, b_group = np.repeat(np.arange(len(a_in)), a_in), np.repeat(np.arange(len(b_in)), b_in)
        a_unit, b_unit = unit[a_group], unit[b_group]
        a_at = np.arange(len(a_ids)) + (np.cumsum(b_in) - b_in)[a_group]
        b_at = np.arange(len(b_ids)) + np.cumsum(a_in)[b_group]
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        ids, ends, owner = (np.empty(len(a_ids) + len(b_ids), np.int64) for _ in range(3))
        ids[a_at], ids[b_at], owner[a_at], owner[b_at] = a_ids, b_ids, a_unit, b_unit
        ends[a_at], ends[b_at] = np.where(last(a_group), ord("|"), ord(",")), np.where(last(b_group), ord(";"), ord(","))
        width = len(str(int(ids.max()))) if len(ids) else 1
        text = np.zeros((len(ids), width + 1), np.uint8)
        for i in range(width):
            text[:, width - 1 - i] = np.where((ids >= 10**i) | (i == 0), ids // 10**i % 10 + ord("0"), 0)
        text[:, width] = ends
        edge = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=(text > 0).sum(axis=1), minlength=count).astype(np.int64))]).tolist()
        flat = text[text > 0].tobytes().decode()
        return [flat[x:y] for x, y in zip(edge[:-1], edge[1:])]


def _narrow(x: np.ndarray) -> pa.Array:
    """Numbers from 0 in as few bytes each as their largest takes, which the first byte tells, their count, and all first bytes,
    then all second ones and so on, compressed."""
    size = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)
    return pa.array([bytes([size]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)], pa.binary())


def _wide(blob: bytes) -> np.ndarray:
    size, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(pa.decompress(blob[9:], size * n, "zstd"), np.uint8).reshape(size, n)
    out = np.zeros(n, np.int64)
    for i, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * i)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


#: What a block keeps: words of each document, their units, groups and links of each unit, the pair of each link, tokens, and
#: the tokens of each group.
NUMBERS = ["words", "seq", "groups", "links", "place", "a_ids", "b_ids", "a_in", "b_in"]


class _Numbers(dict):
    """A number for each key, in the order they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _held(seq: np.ndarray, first: np.ndarray, links: Links) -> np.ndarray:
    """How many documents have each pair of the block; seq: units of the documents one after another."""
    own = _distinct(np.repeat(np.arange(len(first) - 1), np.diff(first)) * len(links.spelt) + seq)
    n = links.sizes[own % len(links.spelt), 3]
    held, upto, lo = np.zeros(len(links.pairs), np.int64), np.cumsum(n), 0
    while lo < len(own):  # about a million links at a time, cut between documents
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20), "right"))
        hi = int(np.searchsorted(own, (own[min(hi, len(own) - 1)] // len(links.spelt) + 1) * len(links.spelt)))
        unit, doc, size = own[lo:hi] % len(links.spelt), own[lo:hi] // len(links.spelt), n[lo:hi]
        at = np.repeat(links.first[unit] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        each = _distinct(np.repeat(doc, size) * len(links.pairs) + links.place[at])
        held += np.bincount(each % max(len(links.pairs), 1), minlength=len(links.pairs))
        lo = hi
    return held


def _blocks(shared: tuple, limit: int):
    """Blocks of documents as numbers of their distinct units, with these units' links and groups."""

    def block(number: int, ids: list, rows: list, index: dict, a: Vocabulary, b: Vocabulary):
        links = Links(a, b, list(index))
        # A document with a unit that is not spelt has no tokens at all.
        rows = [x if links.spelt[x].all() else x[:0] for x in rows]
        first = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        seq = np.concatenate(rows)
        held = _held(seq, first, links)
        together = pa.concat_arrays(ids)
        values = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(together)], pa.int32()), together)]
        values += [_narrow(x) for x in (np.diff(first), seq, *links.sizes.T[2:], links.place, links.a_ids, links.b_ids, links.a_in, links.b_in)]
        values += [*(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (links.pairs, held))]
        return pa.RecordBatch.from_arrays(values, ["block", "ids", *NUMBERS, "pairs", "held"])

    def run(batches):
        a, b = byte_level(shared[0].value), pieces(shared[1].value)
        number = TaskContext.get().partitionId() << 32
        ids, rows, index, size = [], [], _Numbers(), 0
        for batch in batches:
            texts = batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                if ids and size + len(text) > limit:
                    yield block(number, ids, rows, index, a, b)
                    number, ids, rows, index, size = number + 1, [], [], _Numbers(), 0
                size += len(text) + 64
                ids.append(batch.column(0).slice(i, 1))
                seq = [np.array([*map(index.__getitem__, part)], np.uint32) for part in units(text)] if text else []
                rows.append(np.concatenate([*seq, np.empty(0, np.uint32)]))
        if ids:
            yield block(number, ids, rows, index, a, b)

    return run


def _documents(names: list[str]):
    """The documents of each block, from its units and what the corpus says of its pairs."""

    def run(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                words, seq, groups, links, place, a_ids, b_ids, a_in, b_in = (_wide(col[name][i].as_py()) for name in NUMBERS)
                first, edge = np.concatenate([[0], np.cumsum(words)]), np.concatenate([[0], np.cumsum(links)])
                sums = np.zeros((2, int(place.max()) + 1 if len(place) else 1), np.int64)
                if col["found"][i].is_valid:
                    found = col["found"][i].values
                    at = found.field("at").to_numpy()
                    sums[0, at] = found.field("best").to_numpy(zero_copy_only=False)
                    sums[1, at] = found.field("n").to_numpy()
                unit = np.repeat(np.arange(len(groups)), groups)
                of_unit = [np.bincount(unit, weights=x, minlength=len(groups)).astype(np.int64) for x in (a_in, b_in)]
                of_unit += [groups, links, *(np.diff(np.concatenate([[0], np.cumsum(x[place])])[edge]) for x in sums)]
                totals = [np.diff(np.concatenate([[0], np.cumsum(x[seq])])[first]) for x in of_unit]
                marks = Links.marks(a_ids, b_ids, a_in, b_in, unit, len(groups))
                ids = col["ids"][i].values
                at = 0
                while at < len(ids):  # some MB of groups at a time
                    to = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 17), "right")) - 1)
                    text = ["".join([marks[u] for u in seq[x:y].tolist()])[:-1] for x, y in zip(first[at:to].tolist(), first[at + 1 : to + 1].tolist())]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), *(pa.array(x[at:to]) for x in totals), pa.array(text, pa.string())], names)
                    at = to

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level_path: str = BYTE_LEVEL, pieces_path: str = PIECES, block_chars: int = 0) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    Tokens A are of a space and the text by the byte-level vocabulary, tokens B of the text by the pieces, which add the
    space. `groups` is their alignment, ids in order: `a1,a2|b1;a3|b2,b3`. A link is a pair of an A and a B token whose bytes
    overlap; a pair of ids counts as many documents as hold it linked, a link is best if its pair counts as much as any pair
    of its A id (ties too), and count_sum adds the counts of all links. A null or empty text, and one that either vocabulary
    does not spell byte for byte, has no tokens: zeros and an empty `groups`. Repeated rows, and rows with a null id, are
    documents of their own. Other columns of docs are not read. The vocabularies' paths are ones of the driver.

    A text is cut where one space lies between other characters; one very long run without such a place is encoded whole.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "crosstoken")
    kind = docs.schema[id_col].dataType
    with open(byte_level_path, encoding="utf-8") as f, open(pieces_path, "rb") as g:  # of fixed size
        spec, model = f.read(), g.read()
    shared = spark.sparkContext.broadcast(spec), spark.sparkContext.broadcast(model)
    kinds = len(pieces(model).size)
    schema = T.StructType().add("block", "long").add("ids", T.ArrayType(kind))
    for name in NUMBERS:
        schema.add(name, "binary")
    schema.add("pairs", T.ArrayType(T.LongType())).add("held", T.ArrayType(T.LongType()))
    blocks = scratch.save(docs.select(id_col, text_col).mapInArrow(_blocks(shared, block_chars or BLOCK_CHARS), schema), "blocks")
    links = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = scratch.save(links.groupBy("pair").agg(F.sum("held").alias("n")), "counts")
    a_id = F.floor(F.col("pair") / kinds)
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    known = counts.withColumn("a", a_id).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # As many rows for a block as it has distinct pairs.
    found = links.select("block", "at", "pair").join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    out = T.StructType().add(id_col, kind)
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        out.add(name, "long")
    return blocks.drop("pairs", "held").join(found, "block", "left").mapInArrow(_documents([*out.names, "groups"]), out.add("groups", "string"))


def digest(docs: DataFrame) -> DataFrame:
    out = align(docs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
