"""Fits and bootstraps against brute force."""

import numpy as np
import pytest

from tessera import registry
from tessera.operators import inference as I

SF = "/root/testdata/sf0.001"


def newton(x, y, l2):
    m, s = x.mean(0), x.std(0)
    s = np.where(s == 0, 1, s)
    z, w = np.column_stack([np.ones(len(x)), (x - m) / s]), np.zeros(x.shape[1] + 1)
    pen = np.diag([0.0] + [l2] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (p - y) + pen @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w, 1 / (1 + np.exp(-z @ w))


def test_fit_and_scores(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=200), rng.normal(3, 2, 200), np.ones(200)])
    y = (rng.random(200) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))] + [(999, None, 1.0, 1.0, 1)], "id long, a double, b double, c double, y int")
    want, p = newton(x, y, 1.0)
    models = I.fit_logreg(df, ("a", "b", "c"), "y")
    np.testing.assert_allclose(models[0].weights, want, atol=1e-7)
    got = {r.id: r.p for r in df.select("id", I.predicted(models, ("a", "b", "c")).alias("p")).collect()}
    np.testing.assert_allclose([got[i] for i in range(200)], p, atol=1e-7)
    assert got[999] is None
    scores = I.oof_scores(df.where("id < 999"), ("a", "b"), "y", "id").toPandas().set_index("id").sort_index()
    assert sorted(scores.fold.unique()) == [0, 1, 2, 3, 4]
    keep = scores.fold.to_numpy() != 2
    w, _ = newton(x[keep, :2], y[keep], 1.0)
    m, s = x[keep, :2].mean(0), x[keep, :2].std(0)
    expected = 1 / (1 + np.exp(-(w[0] + ((x[~keep, :2] - m) / s) @ w[1:])))
    np.testing.assert_allclose(scores.score[~keep], expected, atol=1e-7)


def test_bootstrap_equals_drawing_rows(spark):
    counts = spark.createDataFrame([("a", 30, 20, 40, 10), ("none", 0, 0, 0, 0)], "g string, w long, x long, y long, z long")
    got = {r.g: r for r in I.bootstrap_cells(counts, "g", ("w", "x", "y", "z"), I.gain, 20_000).collect()}
    rows = np.repeat([0, -1, 1, 0], [30, 20, 40, 10])
    drawn = np.sort(np.random.default_rng(5).choice(rows, (20_000, 100)).mean(axis=1))
    assert got["a"].value == pytest.approx(0.2)
    assert got["a"].lo == pytest.approx(drawn[500], abs=0.011) and got["a"].hi == pytest.approx(drawn[19_500], abs=0.011)
    assert (got["none"].lo, got["none"].hi) == (0.0, 0.0)


@pytest.mark.parametrize("name", ["bootstrap_mean", "bootstrap_metric", "bootstrap_paired", "bootstrap_did"])
def test_bootstrap_queries(spark, name):
    first, again = (registry.queries()[name](spark, SF).toPandas() for _ in range(2))
    assert len(first) and (first.lo <= first.value + 1e-12).all() and (first.value <= first.hi + 1e-12).all()
    assert first.sort_values(first.columns[0]).reset_index(drop=True).equals(again.sort_values(again.columns[0]).reset_index(drop=True))


def test_fit_query(spark):
    assert registry.queries()["fit_logreg"](spark, SF).count() == 4
    assert registry.queries()["oof_scores"](spark, SF).where("score IS NULL").count() == 0
