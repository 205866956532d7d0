"""Weights of a lasso against the conditions that its minimum alone meets, and against rows."""

import numpy as np
import pytest

from ferrule.operators import correlation


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.5, 50.0])
def test_no_weight_can_improve(seed, alpha):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (200, 6)) @ rng.normal(0, 1, (6, 6)) * rng.uniform(0.2, 4, 6)
    x[:, 5] = 3.0
    weights = correlation.lasso_weights(np.cov(x, rowvar=False, bias=True), alpha)
    for t in range(6):
        rest = x[:, t] - x[:, t].mean() - (x - x.mean(0)) @ weights[t]
        slope = (x - x.mean(0)).T @ rest / len(x)
        assert weights[t, t] == 0 and weights[t, 5] == 0
        for j in set(range(5)) - {t}:
            if weights[t, j]:
                assert abs(slope[j] - alpha * np.sign(weights[t, j])) < 1e-5
            else:
                assert abs(slope[j]) <= alpha + 1e-5


def test_sets_of_rows(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.normal(0, 1, (3, 300))
    rows = [*zip(a.tolist(), b.tolist(), c.tolist(), (2 * a - b).tolist(), [1.0] * 300, strict=True), (None, 1.0, 1.0, 500.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    names = list("abcde")
    found = correlation.lasso_sets(df, names, 0.1)
    assert found[3] == ["a", "b", "d"] and found[2] == ["c"] and found[4] == ["e"]
    assert correlation.lasso_sets(df, names, 0.1, 2)[3] == ["a", "d"]
    kernel = np.exp(-0.15 * (2 - 2 * np.corrcoef([a, b, c, 2 * a - b])))
    weights = correlation.lasso_weights(np.cov(kernel, rowvar=False, bias=True), 1e-4)
    want = [[names[j] for j in sorted(np.flatnonzero(row), key=lambda j: -abs(row[j]))] + [names[t]] for t, row in enumerate(weights)]
    assert correlation.kernel_lasso_sets(df, names[:4], 1e-4) == want and any(len(s) > 1 for s in want)
    assert correlation.lasso_sets(df.limit(0), names) == [[n] for n in names]


def test_forests_of_cells(spark, monkeypatch):
    """Forests are fitted to cells of bins, not to rows, and find what forests of the rows find."""
    rng = np.random.default_rng(5)
    n = 3000
    a, b, c = rng.integers(0, 6, n), rng.normal(0, 1, n), rng.integers(0, 40, n)
    x = np.stack([a, b, c, 3.0 * a + b + 0.1 * rng.normal(0, 1, n)], 1).round(3)
    names = list("abcd")
    df = spark.createDataFrame([*map(tuple, x.tolist()), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double").repartition(3)
    rows = correlation._whole_rows(df, names)
    edges = correlation._edges(rows, names)
    assert edges[0].tolist() == [0, 1, 2, 3, 4] and [len(e) for e in edges[1:]] == [31, 31, 31]
    for r in correlation._cells(rows, names, edges, 0).where("target = 3").selectExpr("sum(w0) w", "sum(s0) s", "sum(w1) v", "count(*) n").collect():
        assert abs(r.w - n) < 5 * n**0.5 and abs(r.v - n) < 5 * n**0.5 and r.w != r.v and r.n <= 6 * 32 * 32
        assert abs(r.s / r.w - x[:, 3].mean()) < 0.5
    found = correlation._importances(rows, names, edges, 0)
    assembled, others = correlation._assembled(df, names, "d")
    want = correlation.RandomForestRegressor(labelCol="d", seed=0).fit(assembled).featureImportances.toArray()
    assert np.abs(found[3][:3] / correlation.TREES - want).max() < 0.1 and found[3][3] == 0
    most = correlation.CELLS
    monkeypatch.setattr(correlation, "CELLS", 0)
    slow = correlation.forest_sets(df, ["a", "b", "d"], 2)
    monkeypatch.setattr(correlation, "CELLS", most)
    monkeypatch.setattr(correlation, "_assembled", None)
    assert correlation.forest_sets(df, ["a", "b", "d"], 2)[2] == slow[2] == ["a", "d"]
