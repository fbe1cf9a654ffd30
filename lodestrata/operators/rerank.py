"""Training of the reranker: data-parallel gradients over blocks of examples, summed by Spark, steps on the driver.

The network's few hundred numbers go to the tasks and their gradient comes back; examples never leave the executors. Each epoch
is one job over blocks of rows, bounded in size: one side of a group each, or rows that are in no pair. The loss over pairs takes
every positive of a group with every negative, but not one pair after another: softplus and sigmoid are so smooth that over a unit
of logits a polynomial through NODES points gives them to the last digits of a double. So a side is summed onto the nodes of the
units it lies in, sums of blocks are added up by group, and each row meets the nodes of the other side. An epoch's work grows
with the rows (times the units that a group's logits span), not with their pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch
from .evals import blend_grid, pairwise_accuracy
from .score import gelu, gelu_slope, seeded_network, split_groups

LAYERS = ("w1", "b1", "w2", "b2", "w3", "b3")
#: Share of the loss over pairs, patience of the early stop, least gain that counts. Fixed values.
PAIRS, PATIENCE, GAIN = 0.25, 12, 1e-5
#: Positives and negatives of a block, about.
TILE = (4096, 4096)
#: Points of a unit of logits. The poles nearest to it lie pi away, so an error falls by 12.6 with each: 16 leave 1e-17.
NODES = 16
_ROOTS = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_BASIS = chebvander(_ROOTS, NODES - 1).T * np.where(np.arange(NODES) > 0, 2, 1)[:, None] / NODES


@dataclass
class Trained:
    """Network of the best epoch, with the losses of every epoch (train, held out; the latter null without held-out rows)."""

    net: dict[str, np.ndarray]
    best_epoch: int
    train_loss: float
    eval_loss: float | None
    history: list[tuple[float, float | None]] = field(default_factory=list)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


class Pass:
    """One pass of standardised examples through the network, kept for its gradient."""

    def __init__(self, x: np.ndarray, net: dict[str, np.ndarray], mask: np.ndarray | None = None):
        self.x, self.net, self.mask = x, net, mask
        self.z1 = x @ net["w1"] + net["b1"]
        self.h1 = gelu(self.z1) if mask is None else gelu(self.z1) * mask
        self.z2 = self.h1 @ net["w2"] + net["b2"]
        self.h2 = gelu(self.z2)
        self.logit = (self.h2 @ net["w3"] + net["b3"])[:, 0]

    def gradient(self, pull: np.ndarray) -> np.ndarray:
        """Of sum(pull * logit) by all weights, one after another."""
        pull = pull[:, None]
        d2 = pull @ self.net["w3"].T * gelu_slope(self.z2)
        d1 = d2 @ self.net["w2"].T * gelu_slope(self.z1) * (1 if self.mask is None else self.mask)
        parts = (self.x.T @ d1, d1.sum(axis=0), self.h1.T @ d2, d2.sum(axis=0), self.h2.T @ pull, pull.sum(axis=0))
        return np.concatenate([p.ravel() for p in parts])


def _standard(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    return (x - net["mean"]) / net["std"]


def _entropy(z: np.ndarray, y: np.ndarray, positive_weight: float) -> tuple[float, np.ndarray]:
    """Sum of the weighted cross-entropy over logits, and its slope at each."""
    loss = np.where(y > 0, positive_weight * softplus(-z), softplus(z)).sum()
    return float(loss), np.where(y > 0, -positive_weight * sigmoid(-z), sigmoid(z))


def row_loss(x: np.ndarray, y: np.ndarray, net: dict, positive_weight: float, mask=None) -> tuple[float, np.ndarray]:
    """Sum of the weighted cross-entropy over rows, and its gradient."""
    step = Pass(_standard(x, net), net, mask)
    loss, pull = _entropy(step.logit, y, positive_weight)
    return loss, step.gradient(pull)


def _shares(part: np.ndarray) -> np.ndarray:
    """Weights of the nodes for each place in a unit (0 to 1): what a smooth function has there is the weighted sum over nodes."""
    return chebvander(2 * part - 1, NODES - 1) @ _BASIS


def points(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights over which softplus and sigmoid have the same sums as over z: the nodes of the units that z lies in, or z
    itself where that is less."""
    units, at = np.unique(np.floor(z), return_inverse=True)
    if len(z) <= NODES * len(units):
        return z, np.ones(len(z))
    order = np.argsort(at, kind="stable")
    sums = np.add.reduceat(_shares(z - units[at])[order], np.searchsorted(at[order], np.arange(len(units))))
    return (units[:, None] + (_ROOTS + 1) / 2).ravel(), sums.ravel()


def felt(own: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Two rows: for each of own, the weighted sums over the places of softplus(place - own) and of sigmoid(place - own)."""
    units, at = np.unique(np.floor(own), return_inverse=True)
    many = len(own) > NODES * len(units)
    where = (units[:, None] + (_ROOTS + 1) / 2).ravel() if many else own
    sums, step = np.empty((2, len(where))), max(1, (1 << 18) // max(1, len(place)))
    for i in range(0, len(where), step):
        gap = place - where[i : i + step, None]
        sums[0, i : i + step], sums[1, i : i + step] = softplus(gap) @ weight, sigmoid(gap) @ weight
    if not many:
        return sums
    return np.einsum("snk,nk->sn", sums.reshape(2, -1, NODES)[:, at], _shares(own - units[at]))


def pair_loss(positive: np.ndarray, negative: np.ndarray, net: dict, masks=(None, None)) -> tuple[float, np.ndarray]:
    """Sum over pairs of how far the positive is from being above the negative, and its gradient."""
    a, b = Pass(_standard(positive, net), net, masks[0]), Pass(_standard(negative, net), net, masks[1])
    loss, down = felt(a.logit, *points(b.logit))
    return float(loss.sum()), b.gradient(felt(-b.logit, *points(-a.logit))[1]) - a.gradient(down)


def _packed(batches):
    """Lists of numbers (label, x) as their bytes, which pass to tasks as they are."""
    for batch in batches:
        for c in ("label", "x"):
            lists = batch.column(c)
            batch = batch.set_column(batch.schema.get_field_index(c), c, pa.array([np.asarray(v.values, float).tobytes() for v in lists], pa.binary()))
        yield batch


def _passes(batch: pa.RecordBatch, net: dict, dropout: float, seed: tuple):
    """Each block of a batch as (columns, its row, its pass). What is dropped depends on block and epoch alone, and is the same for
    all losses of an epoch; rows kept out lose nothing."""
    inputs, hidden = net["w1"].shape
    col = dict(zip(batch.schema.names, batch.columns))
    for i in range(batch.num_rows):
        x = np.frombuffer(col["x"][i].as_buffer()).reshape(-1, inputs)
        mask = None
        if dropout and col["kind"][i].as_py() == "train":
            mask = (np.random.default_rng((*seed, col["block"][i].as_py() % (1 << 62))).random((len(x), hidden)) >= dropout) / (1 - dropout)
        yield col, i, Pass(_standard(x, net), net, mask)


def _met(net: dict, dropout: float, seed: tuple):
    """What rows of the other side meet of each block: (group, positive, slices of the other side, place, weight)."""

    def run(batches):
        for batch in batches:
            for col, i, step in _passes(batch, net, dropout, seed):
                positive = col["positive"][i].as_py()
                place, weight = points(-step.logit if positive else step.logit)
                same = lambda c, kind: pa.array([c] * len(place), kind)
                yield pa.RecordBatch.from_arrays([same(col["group"][i].as_py(), col["group"].type), same(not positive, pa.bool_()), same(col["others"][i].as_py(), pa.int32()), pa.array(place), pa.array(weight)], ["group", "positive", "others", "place", "weight"])

    return run


def _epoch(net: dict, counts: dict, positive_weight: float, dropout: float, seed: tuple):
    """Loss of rows, of pairs and of held-out rows and the gradient, as one row for each task."""

    def run(batches):
        sums, total = np.zeros(3), np.zeros(sum(net[k].size for k in LAYERS))
        for batch in batches:
            for col, i, step in _passes(batch, net, dropout, seed):
                kind, met = col["kind"][i].as_py(), col["met"][i]
                loss, pull = _entropy(step.logit, np.frombuffer(col["label"][i].as_buffer()), positive_weight)
                sums[0 if kind == "train" else 2] += loss / counts[kind]
                if kind != "train":
                    continue
                pull = pull / counts[kind]
                if met.is_valid:
                    place, weight = (np.asarray(met.values.field(n), float) for n in ("place", "weight"))
                    positive, scale = col["positive"][i].as_py(), col["scale"][i].as_py()
                    loss, slope = felt(step.logit if positive else -step.logit, place, weight)
                    # The loss of a pair is counted with its positive.
                    sums[1] += scale * loss.sum() if positive else 0.0
                    pull = pull + PAIRS * scale * (-slope if positive else slope)
                total += step.gradient(pull)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sums, total]).tolist()], pa.list_(pa.float64()))], ["parts"])

    return run


def blocks(rows: DataFrame, scratch: Scratch, tile: tuple[int, int] = TILE, block_rows: int = 4096) -> tuple[DataFrame, dict, np.ndarray, np.ndarray]:
    """The examples (group, positive, fold, x) as blocks in a shared table, counts by fold, and mean and deviation of x in training."""
    rows = scratch.save(rows.withColumn("place", F.monotonically_increasing_id()), "examples")
    inputs = F.posexplode("x").alias("i", "v")
    moments = rows.filter("fold = 'train'").select(inputs).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).orderBy("i").collect()  # a row for each feature
    mean, std = np.array([r["mean"] for r in moments], float), np.array([r["std"] for r in moments], float)
    counts = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    counts["positive"] = rows.filter("fold = 'train' and positive").count()
    sizes = rows.filter("fold = 'train'").groupBy("group").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")).filter("p > 0 and n > 0")
    sizes = scratch.save(sizes.withColumn("fold", F.lit("train")), "sizes")
    counts["groups"] = sizes.count()
    paired, slices = F.col("p").isNotNull(), lambda c, most: F.ceil(F.col(c) / most).cast("int")
    sides = [slices("p", tile[0]), slices("n", tile[1])]
    mine, others = (F.when(paired, F.when(F.col("positive"), a).otherwise(b)) for a, b in (sides, sides[::-1]))
    rest = max(1, -(-sum(counts.get(f, 0) for f in ("train", "eval")) // block_rows))
    dealt = rows.join(sizes, ["group", "fold"], "left").select(
        F.col("fold").alias("kind"), F.when(paired, F.col("group")).alias("group"), F.when(paired, F.col("positive")).alias("side"), F.pmod(F.xxhash64("place"), F.coalesce(mine, F.lit(rest))).cast("int").alias("slice"), others.alias("others"),
        (1.0 / (F.col("p") * F.col("n") * F.lit(max(1, counts["groups"])))).alias("scale"), F.struct("place", F.col("positive").cast("double").alias("y"), "x").alias("r"),
    )
    key = ["kind", "group", "side", "slice"]
    found = dealt.groupBy(*key).agg(F.first("others").alias("others"), F.first("scale").alias("scale"), F.array_sort(F.collect_list("r")).alias("l"))
    found = found.select("kind", "group", F.col("side").alias("positive"), "slice", "others", "scale", F.abs(F.xxhash64(*key)).alias("block"), F.transform("l", lambda r: r["y"]).alias("label"), F.flatten(F.transform("l", lambda r: r["x"])).alias("x"))
    kinds = ", ".join(f"{f.name} {'binary' if f.name in ('label', 'x') else f.dataType.simpleString()}" for f in found.schema.fields)
    return scratch.save(found.mapInArrow(_packed, kinds), "blocks"), counts, mean, np.where(std <= 1e-6, 1.0, std)


def train(
    rows: DataFrame, features: list[str], group: str = "group_id", label: str = "label", split: str | None = None, epochs: int = 80, hidden: int = 32, rate: float = 2e-3, decay: float = 1e-4, share: float = 0.2, dropout: float = 0.1, seed: int = 42, allow_test: bool = False
) -> Trained:
    """Trains on rows (group, label, features): positives have a label over 0.5.

    Whole groups are kept out for the early stop (see split_groups); if the others then lack a label, all rows train and the
    loss of training decides. `split` names a column whose rows `test` are refused unless allow_test. A null feature is 0, rows
    without a label are not used, repeated rows count each. Without both labels there is nothing to learn: a ValueError.
    """
    if split and not allow_test and rows.filter(F.lower(F.col(split).cast("string")) == "test").limit(1).count():
        raise ValueError("rows of the split test must not train")
    scratch = Scratch(rows.sparkSession, "rerank")
    x = F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features))
    slim = scratch.save(rows.filter(F.col(label).isNotNull()).select(F.col(group).cast("string").alias("group"), (F.col(label) > 0.5).alias("positive"), x.alias("x")), "rows")
    kinds = {r["positive"]: r["count"] for r in slim.groupBy("positive").count().collect()}
    if len(kinds) < 2:
        raise ValueError("training takes rows of both labels")
    folds = split_groups(slim.withColumn("group", F.coalesce("group", F.lit(""))).withColumn("y", F.col("positive").cast("int")), "group", "y", share, seed).drop("y")
    folds = scratch.save(folds, "folds")
    if folds.filter("fold = 'train'").select("positive").distinct().count() < 2:
        folds = folds.withColumn("fold", F.lit("train"))
    found, counts, mean, std = blocks(folds, scratch)
    return fit(found, counts, seeded_network(len(features), hidden, seed) | {"mean": mean, "std": std}, epochs, rate, decay, dropout, seed)


def fit(found: DataFrame, counts: dict, net: dict[str, np.ndarray], epochs: int, rate: float, decay: float, dropout: float, seed: int) -> Trained:
    """Full-batch steps with decoupled weight decay until the loss of held-out rows stays for PATIENCE epochs. The weights of an
    epoch are judged in the job that takes the next gradient, so an epoch is one job."""
    weight = max(1, counts["train"] - counts["positive"]) / max(1, counts["positive"])
    shapes = [net[k].shape for k in LAYERS]
    flat = np.concatenate([net[k].ravel() for k in LAYERS])
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    named = lambda v: net | {k: p.reshape(s) for k, s, p in zip(LAYERS, shapes, np.split(v, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]))}
    best, best_loss, at, history, stale, before = flat, float("inf"), 0, [], 0, None
    on = ["group", "positive", "slice"]
    # Dealt once: only what sides meet moves in an epoch.
    held_blocks = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on).persist()
    sent = f"group {found.schema['group'].dataType.simpleString()}, positive boolean, others int, place double, weight double"
    for epoch in range(1, max(1, epochs) + 2):
        now = (named(flat), dropout, (seed, epoch))
        met = held_blocks.filter("positive is not null").select("kind", "group", "positive", "others", "block", "x").mapInArrow(_met(*now), sent)
        met = met.groupBy("group", "positive", "others", "place").agg(F.sum("weight").alias("weight"))
        met = met.groupBy("group", "positive", "others").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("met"))
        met = met.select("group", "positive", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("slice"), "met")
        own = held_blocks.join(met, on, "left").mapInArrow(_epoch(now[0], counts, weight, *now[1:]), "parts array<double>")
        # Tasks' rows are summed before they meet, number by number.
        sums = own.select(F.posexplode("parts").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        parts = np.zeros(len(flat) + 3)
        parts[[r["i"] for r in sums]] = [r["v"] for r in sums]
        loss, held = parts[0] + PAIRS * parts[1], parts[2] if counts.get("eval") else None
        if before is not None:  # the weights at hand are those that the step before made
            history.append((before, None if held is None else float(held)))
            current = before if held is None else held
            if current < best_loss - GAIN:
                best, best_loss, stale, at = flat.copy(), current, 0, epoch - 1
            else:
                stale += 1
            if stale >= PATIENCE or epoch > epochs:
                break
        before = float(loss)
        first, second = 0.9 * first + 0.1 * parts[3:], 0.999 * second + 0.001 * parts[3:] ** 2
        step = first / (1 - 0.9**epoch) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        flat = flat * (1 - rate * decay) - rate * step
    held_blocks.unpersist()
    at, best = (at, best) if at else (len(history), flat)  # losses that are no numbers
    return Trained(named(best), at, *history[at - 1], history)


def accuracies(rows: DataFrame, group: str, base: str, neural: str, label: str = "label") -> DataFrame:
    """One row: pairs, share of positive-negative pairs of a group in order by base and by neural, the best weight of a blend and
    its share."""
    shared = rows.select(F.col(group).alias("group"), F.col(label).alias("label"), F.col(base).alias("base"), F.col(neural).alias("neural"))
    total = lambda c, n: pairwise_accuracy(shared, ["group"], c).agg(F.sum("pairs").alias(f"{n}_pairs"), F.sum("correct").alias(n))
    best = blend_grid(shared, ["group"], "base", "neural").limit(1)
    # Three single rows.
    joined = total("base", "b").join(F.broadcast(total("neural", "m"))).join(F.broadcast(best))
    return joined.select(F.col("b_pairs").alias("pairs"), F.try_divide("b", "b_pairs").alias("base_accuracy"), F.try_divide("m", "b_pairs").alias("neural_accuracy"), "weight", F.col("accuracy").alias("blend_accuracy"))

