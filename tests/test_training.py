import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import rerank, score

FEATURES = ["a", "b", "c"]


def examples(groups=12, per=9, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        shift = rng.normal()
        for i in range(per + g % 3):
            x = rng.normal(size=3)
            rows.append((f"g{g}", 1.0 if x[0] - 0.7 * x[1] * x[1] + 0.3 * rng.normal() > 0 else 0.0, float(x[0] + 0.1 * shift), float(x[1]), 5.0, float(rng.random())))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(examples(), "group_id string, label double, a double, b double, c double, base double").repartition(3)


def plain_training(x, y, g, held, net, epochs, rate, decay, patience=12):
    """The loss written out: weighted cross-entropy of rows, a quarter of the mean over groups of the mean over pairs; slopes by
    backpropagation, steps as of Adam with decay on the weights themselves."""
    keys = ["w1", "b1", "w2", "b2", "w3", "b3"]
    p = {k: net[k].copy() for k in keys}
    m, v = ({k: np.zeros_like(p[k]) for k in keys} for _ in range(2))
    t = ~held
    mean, std = x[t].mean(axis=0), x[t].std(axis=0)
    x = (x - mean) / np.where(std <= 1e-6, 1, std)
    weight = (y[t] == 0).sum() / (y[t] == 1).sum()
    sig = lambda z: 1 / (1 + np.exp(-z))

    def forward(q):
        z1 = x @ q["w1"] + q["b1"]
        z2 = score.gelu(z1) @ q["w2"] + q["b2"]
        return z1, z2, (score.gelu(z2) @ q["w3"] + q["b3"])[:, 0]

    def losses(z):
        bce = np.where(y == 1, -weight * np.log(sig(z)), -np.log(1 - sig(z)))
        pairs = []
        for k in sorted(set(g[t])):
            pos, neg = np.nonzero(t & (g == k) & (y == 1))[0], np.nonzero(t & (g == k) & (y == 0))[0]
            if len(pos) and len(neg):
                pairs.append((pos, neg))
        pl = np.mean([np.mean([math.log1p(math.exp(-(z[i] - z[j]))) for i in a for j in b]) for a, b in pairs])
        dz = np.where(t, np.where(y == 1, -weight * (1 - sig(z)), sig(z)) / t.sum(), 0.0)
        for a, b in pairs:
            for i in a:
                for j in b:
                    pull = 0.25 * sig(z[j] - z[i]) / (len(a) * len(b) * len(pairs))
                    dz[i] -= pull
                    dz[j] += pull
        return bce[t].mean() + 0.25 * pl, (bce[held].mean() if held.any() else None), dz

    history, best, stale = [], (float("inf"), None, 0), 0
    for epoch in range(1, epochs + 1):
        z1, z2, z = forward(p)
        loss, _, dz = losses(z)
        d3 = dz[:, None]
        d2 = d3 @ p["w3"].T * score.gelu_slope(z2)
        d1 = d2 @ p["w2"].T * score.gelu_slope(z1)
        grad = {"w1": x.T @ d1, "b1": d1.sum(0), "w2": score.gelu(z1).T @ d2, "b2": d2.sum(0), "w3": score.gelu(z2).T @ d3, "b3": d3.sum(0)}
        for k in keys:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] * (1 - rate * decay) - rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
        held_loss = losses(forward(p)[2])[1]
        history.append((loss, held_loss))
        if held_loss < best[0] - 1e-5:
            best, stale = (held_loss, {k: p[k].copy() for k in keys}, epoch), 0
        else:
            stale += 1
            if stale >= patience:
                break
    return history, best


@pytest.mark.parametrize("tile", [(64, 1024), (2, 3)])
def test_training_equals_plain_numpy(spark, rows, tile, monkeypatch):
    """Also with groups cut into many tiles and rows into many blocks."""
    folds = score.split_groups(rows.withColumnRenamed("group_id", "group"), "group", share=0.3)
    local = folds.toPandas()
    slim = folds.select("group", (F.col("label") > 0.5).alias("positive"), F.array(*FEATURES).alias("x"), "fold")
    found, counts, mean, std = rerank.blocks(slim, rerank.Scratch(spark, "t"), tile, 10)
    net = score.seeded_network(3, 6, 1) | {"mean": mean, "std": std}
    got = rerank.fit(found, counts, net, 25, 0.05, 0.01, 0.0, 1)
    history, (loss, best, epoch) = plain_training(local[FEATURES].to_numpy(float), local["label"].to_numpy(), local["group"].to_numpy(), (local["fold"] == "eval").to_numpy(), net, 25, 0.05, 0.01)
    assert got.best_epoch == epoch and got.eval_loss == pytest.approx(loss, rel=1e-9)
    assert np.allclose(np.array(got.history, float), np.array(history, float), rtol=1e-9)
    assert all(np.allclose(got.net[k], best[k], rtol=1e-8, atol=1e-11) for k in best)


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(0)
    net = score.seeded_network(4, 5, 2) | {"mean": rng.normal(size=4), "std": rng.random(4) + 0.5}
    x, y, other = rng.normal(size=(7, 4)), np.array([1, 0, 1, 0, 0, 1, 0.0]), rng.normal(size=(3, 4))
    mask = (rng.random((7, 5)) > 0.3) / 0.7
    flat = np.concatenate([net[k].ravel() for k in rerank.LAYERS])

    def at(v):
        out, i = dict(net), 0
        for k in rerank.LAYERS:
            out[k] = v[i : i + net[k].size].reshape(net[k].shape)
            i += net[k].size
        return out

    for loss in (lambda n: rerank.row_loss(x, y, n, 2.5), lambda n: rerank.row_loss(x, y, n, 2.5, mask), lambda n: rerank.pair_loss(x, other, n), lambda n: rerank.pair_loss(x, other, n, (mask, None))):
        slope = loss(net)[1]
        for i in range(len(flat)):
            step = np.zeros_like(flat)
            step[i] = 1e-5
            assert slope[i] == pytest.approx((loss(at(flat + step))[0] - loss(at(flat - step))[0]) / 2e-5, rel=1e-5, abs=1e-7)


def test_training_learns_and_keeps_its_rules(spark, rows):
    trained = rerank.train(rows, FEATURES, epochs=60, hidden=8, rate=0.03, share=0.3)
    assert trained.eval_loss < trained.history[0][1] and len(trained.history) <= 60
    scored = rows.withColumn("neural", score.neural_score([F.col(c) for c in FEATURES], trained.net))
    held = score.split_groups(rows.withColumnRenamed("group_id", "group"), "group", share=0.3).filter("fold = 'eval'").select("group").distinct()
    r = rerank.accuracies(scored.join(held, F.col("group_id") == F.col("group")).drop("group"), "group_id", "base", "neural").first()
    assert r["neural_accuracy"] > 0.75 > r["base_accuracy"] and r["blend_accuracy"] >= max(r["neural_accuracy"], r["base_accuracy"])
    with pytest.raises(ValueError):
        rerank.train(rows.filter("label = 1"), FEATURES)
    with pytest.raises(ValueError):
        rerank.train(rows.limit(0), FEATURES)
    tested = rows.withColumn("split", F.lit("TEST"))
    with pytest.raises(ValueError):
        rerank.train(tested, FEATURES, split="split")
    assert rerank.train(tested, FEATURES, split="split", allow_test=True, epochs=1).best_epoch == 1


def test_training_on_one_group_nulls_and_repeated_rows(spark):
    one = spark.createDataFrame([("g", 1.0, 1.0), ("g", 0.0, None), ("g", 0.0, float("nan")), ("g", None, 3.0), (None, 1.0, 2.0)] + [("g", 0.0, -1.0)] * 3, "group_id string, label double, a double")
    got = rerank.train(one, ["a"], epochs=3, hidden=4)
    assert all(math.isfinite(loss) for loss, _ in got.history)


def labelled(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, 1]
    y = (x[:, 0] + 0.05 * (x[:, 1] - 5) + rng.normal(size=n) > 0.8).astype(int)
    rows = [(int(i), int(a), *map(float, b), 7.0) for i, (a, b) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "doc_id long, label int, a double, b double, c double, flat double").repartition(3), x, y


def test_split_has_the_exact_share_of_each_label(spark):
    rows, _, y = labelled(spark)
    with_null = rows.union(rows.limit(3).withColumn("label", F.lit(None).cast("int")))
    got = {(r["label"], r["fold"]): r["n"] for r in score.stratified_split(with_null, "doc_id").groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    ones, zeros = int(y.sum()), int((1 - y).sum())
    assert got == {(1, "eval"): math.floor(ones * 0.3 + 0.5), (1, "train"): ones - math.floor(ones * 0.3 + 0.5), (0, "eval"): math.floor(zeros * 0.3 + 0.5), (0, "train"): zeros - math.floor(zeros * 0.3 + 0.5), (None, None): 3}
    again = rows.repartition(7)
    assert sorted(map(tuple, score.stratified_split(again, "doc_id").select("doc_id", "fold").collect())) == sorted(map(tuple, score.stratified_split(rows, "doc_id").select("doc_id", "fold").collect()))
    few = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, label int")
    one = spark.createDataFrame([(i, int(i == 0)) for i in range(20)], "doc_id long, label int")
    for rest in (few, one, one.filter("label = 0")):
        assert {r["fold"] for r in score.stratified_split(rest, "doc_id").collect()} == {"both"}
    assert score.stratified_split(few.limit(0), "doc_id").count() == 0


def test_newton_fit_equals_numpy(spark):
    rows, x, y = labelled(spark)
    dirty = rows.union(spark.createDataFrame([(1000, None, 1.0, 1.0, 1.0, 7.0), (1001, 1, None, 1.0, 1.0, 7.0)], rows.schema))
    got = score.fit_logistic(dirty, ["a", "b", "c", "flat"], penalty=0.7)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0), np.zeros(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(5)
    for _ in range(20_000):  # plain descent on the same loss
        beta -= 0.002 * (z.T @ (w * (1 / (1 + np.exp(-z @ beta)) - y)) + 0.7 * np.array([0, 1, 1, 1, 1]) * beta)
    assert np.allclose([got.intercept, *got.coef], beta, atol=1e-6) and got.steps < 15
    p = {r["doc_id"]: r["p"] for r in rows.select("doc_id", got.probability().alias("p")).collect()}
    assert np.allclose([p[i] for i in range(len(y))], 1 / (1 + np.exp(-z @ beta)), atol=1e-6)
    with pytest.raises(ValueError):
        score.fit_logistic(rows.filter("label = 1"), ["a"])
    with pytest.raises(ValueError):
        score.fit_logistic(rows.limit(0), ["a"])


def test_ranges_of_a_heavy_tail_hold_as_many_rows(spark):
    from lodestrata.operators.ordered import scaled

    rows = [(float(i), 1) for i in range(3000)] + [(1e9, 1), (1e300, 1), (float("inf"), 1), (float("-inf"), 1), (float("nan"), 1), (None, 1)] + [(-5.0, 1)] * 400
    got = scaled(spark.createDataFrame(rows, "x double, one int"), "x").collect()
    by = {}
    for r in got:
        by.setdefault(r["place_"], []).append(r["x"])
    assert by.pop(None) == [None] and len(by) > 300 and max(len(set(v)) for v in by.values()) < 40
    inside = sorted((p, x) for p, v in by.items() for x in v if x == x)
    assert [x for _, x in inside] == sorted(x for _, x in inside)  # places never fall along the order
    assert scaled(spark.createDataFrame([], "x double"), "x").count() == 0
    assert [r["place_"] for r in scaled(spark.createDataFrame([(None,)], "x double"), "x").collect()] == [None]
