"""Scores of candidates: rules, normalisation, fusion, reranking, calibrated and learnt models."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import running

#: Named weights of retrieval, scorer and visual signals.
FUSIONS = {"default": (0.45, 0.35, 0.20), "visual": (0.42, 0.18, 0.40), "text": (0.68, 0.32, 0.0), "visual_first": (0.35, 0.15, 0.50)}


def rule(hits: Column) -> Column:
    """Informative terms of the question in the text (`hits` of retrieve.candidates), and small parts for motion, light and an
    early start."""
    return hits + 0.01 * F.col("motion") + 0.001 * F.col("brightness") + 0.001 * F.col("contrast") + 1 / (1 + F.col("start_sec"))


def min_max(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Each column scaled within its group: 1 for a single row, 0 if all are equal. Extremes are aggregates joined back."""
    aggs = [f(c).alias(f"{tag}_{c}_") for c in columns for f, tag in ((F.min, "lo"), (F.max, "hi"))]
    bounds = df.groupBy(*keys).agg(F.count("*").alias("n_"), *aggs)
    out = df.join(bounds, keys)
    for c, name in columns.items():
        lo, hi = F.col(f"lo_{c}_"), F.col(f"hi_{c}_")
        out = out.withColumn(name, F.when(F.col("n_") == 1, 1.0).when(hi - lo <= 1e-12, 0.0).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.drop("n_", *(f"{t}_{c}_" for c in columns for t in ("lo", "hi")))


def fuse(retrieval: Column, scorer: Column, visual: Column, weights: tuple[float, float, float] = FUSIONS["default"]) -> Column:
    a, b, c = weights
    return a * retrieval + b * scorer + c * visual


def blend(base: Column, neural: Column, weight: float, recommended: float = 0.0) -> Column:
    """Base and reranked score; a negative weight stands for the recommended one."""
    w = recommended if weight < 0 else weight
    return (1 - w) * base + w * neural


RERANK_FEATURES = ["coverage", "retrieval", "scorer", "visual", "retrieval_rank", "scorer_rank", "visual_rank", "base", "confidence", "position", "share", "log_length"]


def rerank_features(duration: Column) -> list[Column]:
    length = F.col("end_sec") - F.col("start_sec")
    d = F.greatest(duration, F.lit(1.0))
    return [
        F.col("lexical").alias("coverage"), F.col("retrieval_score").alias("retrieval"), F.col("scorer_score").alias("scorer"), F.col("vlm_score").alias("visual"),
        F.col("retrieval_rank_score").alias("retrieval_rank"), F.col("scorer_rank_score").alias("scorer_rank"), F.col("vlm_rank_score").alias("visual_rank"),
        F.col("score").alias("base"), F.col("confidence"), ((F.col("start_sec") + F.col("end_sec")) / 2 / d).alias("position"), (length / d).alias("share"), (F.log1p("text_len") / 8).alias("log_length"),
    ]


def seeded_network(inputs: int = 12, hidden: int = 32, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights before training: even in one over the root of a layer's inputs, fixed by the seed."""
    rng = np.random.default_rng(seed)
    second = max(8, hidden // 2)
    even = lambda n, *shape: rng.uniform(-1, 1, shape) / np.sqrt(n)
    return {"mean": np.zeros(inputs), "std": np.ones(inputs), "w1": even(inputs, inputs, hidden), "b1": even(inputs, hidden), "w2": even(hidden, hidden, second), "b2": even(hidden, second), "w3": even(second, second, 1), "b3": even(second, 1)}


def gelu(z: np.ndarray) -> np.ndarray:
    return 0.5 * z * (1 + np.tanh(0.7978845608028654 * (z + 0.044715 * z * z * z)))


def gelu_slope(z: np.ndarray) -> np.ndarray:
    t = np.tanh(0.7978845608028654 * (z + 0.044715 * z * z * z))
    return 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * 0.7978845608028654 * (1 + 3 * 0.044715 * z * z)


def forward(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    h = (x - net["mean"]) / np.where(net["std"] == 0, 1, net["std"])
    h = gelu(gelu(h @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]) @ net["w3"] + net["b3"]
    return 1 / (1 + np.exp(-np.clip(h[:, 0], -700, 700)))


def neural_score(features: list[Column], net: dict[str, np.ndarray]) -> Column:
    """Network score of a row's features, for whole Arrow batches."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(forward(np.column_stack([c.to_numpy(float) for c in columns]), net))

    return run(*features)


def logistic(features: list[Column], mean: list[float], scale: list[float], coef: list[float], intercept: float) -> Column:
    """Probability of standardised features, by the branch of the logistic function that cannot overflow."""
    if not len(features) == len(mean) == len(scale) == len(coef):
        raise ValueError("features and parameters differ in number")
    z = F.lit(float(intercept))
    for f, m, s, c in zip(features, mean, scale, coef):
        z = z + (f.cast("double") - m) / (s if s else 1.0) * c
    return tx.let(z, lambda v: F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v))))


def score_examples(ranked: DataFrame, positives: int = 1) -> DataFrame:
    """Training rows of a scorer: the first of a question are positive, the others negative. ranked has `rank`, and `text_len` or
    the text."""
    size = F.col("text_len") if "text_len" in ranked.columns else F.length(F.coalesce("text", F.lit(""))).alias("text_len")
    return ranked.select("query_id", "segment_id", F.when(F.col("rank") <= positives, 1.0).otherwise(0.0).alias("label"), "start_sec", "end_sec", "brightness", "contrast", "motion", size)


def boosted_scorer(examples: DataFrame, features: list[str], rounds: int = 20, seed: int = 42):
    """Gradient-boosted trees over the examples; use .transform for probabilities."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=3, seed=seed)]).fit(examples)


def logistic_scorer(examples: DataFrame, features: list[str], l2: float = 0.01):
    """Standardised logistic regression with classes of equal weight."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = examples.groupBy("label").agg(F.count("*").alias("n_"))
    total = examples.count()
    weighed = examples.join(F.broadcast(counts), "label").withColumn("weight_", F.lit(float(total)) / (2.0 * F.col("n_")))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(labelCol="label", weightCol="weight_", regParam=l2, standardization=True)]).fit(weighed)


def stratified_split(rows: DataFrame, key: str, label: str = "label", share: float = 0.3, seed: int = 42) -> DataFrame:
    """rows with `fold` train or eval: of each label exactly its share (rounded half up) goes to eval, in the order of a hash of the
    key; ties in the hash go by key. Rows without a label have no fold.

    With fewer than eight rows, one label, or a label that occurs once there is nothing to split: `both`."""
    hashed = rows.withColumn("hash_", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")))
    # 4,096 ranges of the hash, so that a label in any number of rows is many tasks.
    placed = running(hashed.filter(F.col(label).isNotNull()), [label], F.substring("hash_", 1, 3), ["hash_", key], {"place_": F.lit(1)})
    sizes = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_"))
    able = sizes.agg(((F.sum("n_") >= 8) & (F.count("*") >= 2) & (F.min("n_") >= 2)).alias("able_"))
    out = placed.join(sizes, label).join(F.broadcast(able))  # one row
    fold = F.when(~F.coalesce("able_", F.lit(False)), "both").when(F.col("place_") <= F.floor(F.col("n_") * share + 0.5), "eval").otherwise("train")
    split = out.withColumn("fold", fold).drop("hash_", "place_", "n_", "able_")
    return split.unionByName(rows.filter(F.col(label).isNull()).withColumn("fold", F.lit(None).cast("string")))


@dataclass
class Logistic:
    """A fitted model: coefficients of standardised features; probability() is its score of a row."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    coef: list[float]
    intercept: float
    steps: int

    def probability(self) -> Column:
        return logistic([F.col(f) for f in self.features], self.mean, self.scale, self.coef, self.intercept)


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label", penalty: float = 1.0, balanced: bool = True, steps: int = 50, close: float = 1e-10) -> Logistic:
    """Standardised logistic regression with both labels weighing alike, by Newton steps on exact moments.

    The loss is the weighted sum of log losses plus half of penalty times the squared coefficients (not the intercept). A step
    is one aggregate of the gradient and of the (n + 1) x (n + 1) second moments, summed in each task first. Rows with a null
    label or feature are not used; without both labels a ValueError."""
    x = [F.col(f).cast("double") for f in features]
    clean = rows.filter(F.col(label).isNotNull()).select((F.col(label) > 0).cast("double").alias("y"), *(c.alias(f"x{i}") for i, c in enumerate(x))).dropna()
    n = len(features)
    aggs = [F.count("*").alias("n"), F.sum("y").alias("p"), *(f(f"x{i}").alias(f"{t}{i}") for i in range(n) for f, t in ((F.avg, "m"), (F.stddev_pop, "s")))]
    first = clean.agg(*aggs).first()
    if not first["n"] or first["p"] in (0, first["n"]):
        raise ValueError("fitting takes rows of both labels")
    mean = [first[f"m{i}"] for i in range(n)]
    scale = [first[f"s{i}"] or 1.0 for i in range(n)]
    own = (first["n"] / (2 * first["p"]), first["n"] / (2 * (first["n"] - first["p"]))) if balanced else (1.0, 1.0)
    z = clean.select("y", F.when(F.col("y") > 0, own[0]).otherwise(own[1]).alias("w"), F.lit(1.0).alias("z0"), *(((F.col(f"x{i}") - mean[i]) / scale[i]).alias(f"z{i + 1}") for i in range(n)))
    beta, done = np.zeros(n + 1), 0
    keep = np.diag([0.0] + [penalty] * n)
    for done in range(1, steps + 1):
        margin = sum((F.col(f"z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        p = z.withColumn("m", margin).withColumn("p", F.when(F.col("m") >= 0, 1 / (1 + F.exp(-F.col("m")))).otherwise(F.exp("m") / (1 + F.exp("m"))))
        p = p.withColumn("g", F.col("w") * (F.col("p") - F.col("y"))).withColumn("h", F.col("w") * F.col("p") * (1 - F.col("p")))
        sums = p.agg(*(F.sum(F.col("g") * F.col(f"z{i}")).alias(f"g{i}") for i in range(n + 1)), *(F.sum(F.col("h") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(n + 1) for j in range(i, n + 1))).first()
        slope = np.array([sums[f"g{i}"] for i in range(n + 1)]) + keep @ beta
        curve = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(n + 1)] for i in range(n + 1)]) + keep
        step = np.linalg.solve(curve + 1e-12 * np.eye(n + 1), slope)
        beta = beta - step
        if np.abs(step).max() < close:
            break
    return Logistic(features, mean, scale, beta[1:].tolist(), float(beta[0]), done)


def split_groups(rows: DataFrame, group: str = "group_id", label: str = "label", share: float = 0.4, seed: int = 42) -> DataFrame:
    """rows with `fold` train or eval: groups of both labels go to eval first, in hashed order (over ranges of hashes), and one of them stays in train."""
    groups = rows.groupBy(group).agg((F.min(label) != F.max(label)).alias("mixed"))
    total = groups.agg(F.count("*").alias("all_"), F.sum(F.col("mixed").cast("int")).alias("mixed_"))
    ordered = groups.withColumn("hash_", F.xxhash64(F.lit(seed), group)).withColumn("later_", F.when(F.col("mixed"), 0).otherwise(1))
    ranges = F.struct("later_", F.shiftright("hash_", 52))
    placed = running(ordered, [], ranges, ["later_", "hash_", group], {"place_": F.lit(1)}).join(F.broadcast(total))
    wanted = F.greatest(F.lit(1), F.round(F.col("all_") * share)).cast("int")
    keep = F.when(F.col("mixed_") > 1, F.least(wanted, F.col("mixed_") - 1)).otherwise(F.least(wanted, F.col("all_") - 1))
    return rows.join(placed.select(group, F.when(F.col("place_") <= keep, "eval").otherwise("train").alias("fold")), group)
