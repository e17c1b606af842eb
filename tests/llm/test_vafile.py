"""Hard negatives against a version that scores all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import entries, vafile

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """rows: (vec_id, embedding, label)."""
    kept = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, q in kept:
        if i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, o)), j, lab) for j, lab, o in kept if j != i]
        for s, p, _ in sorted((x for x in scored if x[2] == label), key=lambda x: (-x[0], x[1]))[:5]:
            fit = sorted((x for x in scored if x[2] != label and 80 * s <= 100 * x[0] <= 100 * s), key=lambda x: (-x[0], x[1]))[:5]
            out += [(i, p, r + 1, n, s, t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, df, path):
    df.write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in cols) for r in entries.op13_hard_negatives(spark, str(path)).collect())


def embeddings(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) / 4
    x[100:130] = x[200]  # copies: ties
    x[300:340] = x[400] + rng.normal(size=(40, dim)) / 100
    rows = [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, rng.integers(0, 10, n)))]
    rows += [(5000, None, 1), (5100, [1.0] * dim, None), (5200, [float("nan")] * dim, 1), (5300, [float("inf")] + [0.0] * (dim - 1), 2), (5400, [None] + [0.0] * (dim - 1), 3), (None, [1.0] * dim, 1)]
    rows += [rows[0], rows[7], rows[200]]
    return rows


@pytest.mark.parametrize("block", [4096, 60])
def test_negatives_equal_all_pairs(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vafile, "BLOCK", block)
    rows = embeddings()
    assert mined(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), tmp_path) == brute(rows)


def test_rounds_lengths_huge_values_and_clashing_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vafile, "ROUND_BYTES", 300)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(rng.choice([0, 1, 8, 8, 8, 12]))], rng.randrange(3)) for i in range(0, 1500, 5)]
    rows += [(9000, [0.0] + [3e6] * 7, 1), (9001, [0.0] + [2e6] * 7, 2), (9002, [0.0] + [4e6] * 7, 1), (9100, [1e13, 1.0], 1), (9101, [0.5, 1.0], 2)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", id long, q string, key int")
    assert mined(spark, df, tmp_path) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 1), (102, [1.0], 2)], [(0, [0.0], 1), (1, [0.0], 2), (2, [0.0], 3)], [(100, [-1.0], 1), (101, [1.0], 1), (102, [1.0], 2)]])
def test_few_rows(spark, tmp_path, rows):
    assert mined(spark, spark.createDataFrame(rows, SCHEMA), tmp_path) == brute(rows)


def test_bounds_hold_every_score_and_spare_most_rows():
    rng = np.random.default_rng(4)
    q = np.floor(256 * rng.normal(size=(3000, 64)) / 8).astype(np.int64)
    b = vafile._block(np.arange(3000), np.zeros(3000, np.int64), q)
    codes = np.frombuffer(b["codes"], np.uint8).reshape(64, 3000)
    low, high = (np.frombuffer(b[c], np.int64).reshape(64, -1) for c in ("low", "high"))
    least, most = vafile._bounds(codes, low, high, q[:4])
    exact = q @ q[:4].T
    assert (least <= exact).all() and (exact <= most).all()
    a = vafile.Anchor(0, 0, 0, [(vafile.LEAST, vafile.MOST)], [0], [[]])
    scored = vafile._search(a, q[0], np.arange(3000), q, least[:, 0], most[:, 0], 5)
    assert [i for _, i in a.best[0]] == sorted(range(1, 3000), key=lambda i: (-exact[i, 0], i))[:5] and scored < 300
