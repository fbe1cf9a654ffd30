"""The reranker's loss over pairs: all of them, in work that grows with the rows."""

import numpy as np
import pytest

from lodestrata.operators import rerank, score


@pytest.mark.parametrize("spread", [0.01, 1.0, 8.0, 60.0])
def test_sums_over_nodes_equal_sums_over_pairs(spread):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=900) * spread + spread / 3, rng.normal(size=1300) * spread
    gap = b[None, :] - a[:, None]
    loss, down = rerank.felt(a, *rerank.points(b))
    up = rerank.felt(-b, *rerank.points(-a))[1]
    assert np.allclose(loss, rerank.softplus(gap).sum(axis=1), rtol=1e-12, atol=0)
    assert np.allclose(down, rerank.sigmoid(gap).sum(axis=1), rtol=1e-12, atol=0)
    assert np.allclose(up, rerank.sigmoid(gap).sum(axis=0), rtol=1e-12, atol=0)
    assert np.isnan(rerank.felt(a, *rerank.points(np.append(b, np.nan)))).all()  # as a pair with it has no loss


def test_work_grows_with_rows_and_not_with_pairs(monkeypatch):
    rng, met, plain = np.random.default_rng(6), [], rerank.softplus
    net = score.seeded_network(3, 8, 1)
    monkeypatch.setattr(rerank, "softplus", lambda z: met.append(z.size) or plain(z))
    done = []
    for n in (1000, 4000):
        met.clear()
        rerank.pair_loss(rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), net)
        done.append(sum(met))
    assert done[1] < 6 * done[0] and done[1] < 4000 * 4000 / 100  # before: 16 times as many, each pair once


def test_a_hot_group_in_many_blocks_has_the_loss_of_all_its_pairs(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(2600, 3)), rng.random(2600) < 0.7
    group = np.where(np.arange(2600) < 2500, "hot", "small")
    rows = spark.createDataFrame([(str(g), bool(p), v.tolist(), "train") for g, p, v in zip(group, y, x)], "group string, positive boolean, x array<double>, fold string").repartition(3)
    found, counts, mean, std = rerank.blocks(rows, rerank.Scratch(spark, "t"), (300, 200), 100)
    sizes = [len(r["label"]) // 8 for r in found.select("label").collect()]
    assert sum(sizes) == 2600 and max(sizes) < 450  # a row is in one block
    net = score.seeded_network(3, 6, 1) | {"mean": mean, "std": std}
    got = rerank.fit(found, counts, net, 1, 0.01, 0.0, 0.0, 1)
    z = rerank.Pass((x - mean) / std, net).logit
    pairs = np.mean([rerank.softplus(z[(group == g) & ~y][None, :] - z[(group == g) & y][:, None]).mean() for g in ("hot", "small")])
    weight = (~y).sum() / y.sum()
    assert got.history[0][0] == pytest.approx(np.where(y, weight * rerank.softplus(-z), rerank.softplus(z)).mean() + 0.25 * pairs, rel=1e-11)
