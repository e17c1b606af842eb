"""Paired bootstraps against draws of rows."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import replicates as R


def auroc(y, s):
    pos, neg = s[y], s[~y]
    return (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2 if len(pos) and len(neg) else 0.5


def aurc(ok, conf, ids):
    order = np.lexsort((ids, -conf))
    return (1 - np.cumsum(ok[order]) / np.arange(1, len(ok) + 1)).mean()


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.4
    a = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 1)  # many ties
    b = np.clip(0.4 * y + rng.random(n) * 0.6, 0, 1)
    return y, a, b


def frame(spark, y, a, b, parts=7):
    rows = [(i, "one", bool(y[i]), float(a[i]), float(b[i])) for i in range(len(y))]
    rows += [(5000 + i, "two", True, 0.5, 0.5) for i in range(5)] + [(6000, None, True, 0.1, 0.1), (6001, "one", None, 0.1, 0.1), (6002, "one", True, None, 0.1)]
    return spark.createDataFrame(rows, "id long, g string, y boolean, a double, b double").repartition(parts)


def interval(draws):
    return np.percentile(draws, [2.5, 97.5])


def test_weights_are_poisson_and_depend_on_the_id_alone():
    w = R.weights(np.arange(3000), 200, 42).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01
    assert (R.weights(np.arange(100, 200), 200, 42) == w[100:200]).all() and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


def test_paired_auroc(spark, monkeypatch):
    y, a, b = data()
    got = {r.g: r for r in R.paired_auroc(frame(spark, y, a, b), "g", F.col("a"), F.col("b"), F.col("y"), "id", 800).collect()}
    r = got["one"]
    assert abs(r.first - auroc(y, a)) < 1e-12 and abs(r.second - auroc(y, b)) < 1e-12 and abs(r.difference - (r.second - r.first)) < 1e-12
    assert got["two"].first == 0.5 == got["two"].first_hi
    rng, draws = np.random.default_rng(0), []
    for _ in range(1500):
        i = rng.integers(0, len(y), len(y))
        draws.append((auroc(y[i], a[i]), auroc(y[i], b[i])))
    draws = np.array(draws)
    for lo, hi, d in ((r.first_lo, r.first_hi, draws[:, 0]), (r.second_lo, r.second_hi, draws[:, 1]), (r.difference_lo, r.difference_hi, draws[:, 1] - draws[:, 0])):
        assert np.allclose((lo, hi), interval(d), atol=0.012)
    # any partitioning, and any cut of rows into pieces, gives the same draws
    monkeypatch.setattr(R, "ROWS", 13)
    again = {r.g: r for r in R.paired_auroc(frame(spark, y, a, b, 2), "g", F.col("a"), F.col("b"), F.col("y"), "id", 800).collect()}["one"]
    assert np.allclose(tuple(r)[1:], tuple(again)[1:])


def test_replicates_equal_weighted_brute_force(spark):
    y, a, b = data(150, 3)
    df = frame(spark, y, a, b)
    ids = np.array([x.h for x in spark.range(150).select(F.xxhash64("id").alias("h")).collect()])
    w = R.weights(ids, 20, 42).astype(int)
    got = [r.draws for r in R.auroc_draws(df, "g", F.col("a"), F.col("y"), "id", 20).where("g = 'one'").collect()][0]
    assert np.allclose(got[1:], [auroc(np.repeat(y[:150], k), np.repeat(a[:150], k)) for k in w.T])
    got = [r.draws for r in R.aurc_draws(df, "g", F.col("a"), F.col("y"), "id", 20).where("g = 'one'").collect()][0]
    order = np.arange(150)
    whole = [aurc(np.repeat(y, k), np.repeat(a, k), np.repeat(order, k)) for k in w.T]
    kept = df.where("g = 'one' AND a IS NOT NULL AND y IS NOT NULL").count()
    assert kept == 150 and np.allclose(got[1:], whole) and abs(got[0] - aurc(y, a, order)) < 1e-12


def test_paired_aurc(spark):
    y, a, b = data(300, 2)
    ok_b = y | (np.arange(300) % 3 == 0)
    df = spark.createDataFrame([(i, "x", float(a[i]), bool(y[i]), float(b[i]), bool(ok_b[i])) for i in range(300)], "id long, g string, a double, ya boolean, b double, yb boolean").repartition(5)
    r = R.paired_aurc(df, "g", (F.col("a"), F.col("ya")), (F.col("b"), F.col("yb")), "id", 800).first()
    ids, rng, draws = np.arange(300), np.random.default_rng(0), []
    assert abs(r.difference - (aurc(ok_b, b, ids) - aurc(y, a, ids))) < 1e-12
    for _ in range(1500):
        i = rng.integers(0, 300, 300)
        draws.append(aurc(ok_b[i], b[i], ids[i]) - aurc(y[i], a[i], ids[i]))
    assert np.allclose((r.difference_lo, r.difference_hi), interval(draws), atol=0.02) and r.significant == (r.difference_hi < 0)
    same = R.paired_aurc(df, "g", (F.col("a"), F.col("ya")), (F.col("a"), F.col("ya")), "id", 100).first()
    assert same.difference == same.difference_hi == 0 and not same.significant


def test_pooled_did(spark):
    cells = {("m1", "in"): (30, 10, 25, 35), ("m1", "out"): (20, 15, 18, 47), ("m2", "in"): (50, 5, 30, 15), ("m2", "out"): (10, 20, 10, 60), ("m3", "in"): (1, 1, 1, 1)}
    df = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "model string, place string, both long, only_a long, only_b long, neither long")
    r = R.pooled_did(df, "model", "place", ("both", "only_a", "only_b", "neither"), "in", "out", 4000).first()
    rng, draws = np.random.default_rng(5), []
    rows = {k: np.repeat([0, -1, 1, 0], v) for k, v in cells.items()}
    for _ in range(4000):
        draws.append(np.mean([rng.choice(rows[m, "in"], len(rows[m, "in"])).mean() - rng.choice(rows[m, "out"], len(rows[m, "out"])).mean() for m in ("m1", "m2")]))
    assert abs(r.estimate - np.mean(draws)) < 0.005 and np.allclose((r.lo, r.hi), interval(draws), atol=0.012) and r.models == 2
