"""Fits and bootstraps that need no row on the driver: sums and counts are aggregated, and work goes on from these."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import views  # noqa: F401
from ..plans.core import Plan, collect
from .questions import _view

L2, ITERATIONS, REPLICATES, SEED = 1.0, 100, 1000, 42


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray  # the intercept comes first

    def scaled(self) -> np.ndarray:
        """Intercept and weights for features as they are."""
        w = self.weights[1:] / self.std
        return np.concatenate([[self.weights[0] - w @ self.mean], w])


def fit_logreg(df: DataFrame, features: Sequence[str], label: str, group: str | None = None, l2: float = L2, iterations: int = ITERATIONS) -> dict[object, Logistic]:
    """Ridge logistic regressions on standardised features by Newton's method, one for each value of group (few), all in
    the same passes. A pass sums gradients and Hessians as native aggregates; only these sums reach the driver. The
    intercept isn't penalised; rows with a null are left out; a constant feature keeps weight 0.
    """
    k = len(features)
    rows = df.select((F.col(group) if group else F.lit(0)).alias("_g"), F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)]).dropna()
    stats = rows.groupBy("_g").agg(*[f(f"_x{j}") for j in range(k) for f in (F.avg, F.stddev_pop)]).collect()
    means = {r[0]: np.array(r[1::2]) for r in stats}
    stds = {r[0]: np.where(np.array(r[2::2]) == 0, 1.0, np.array(r[2::2])) for r in stats}
    weights = {g: np.zeros(k + 1) for g in means}
    ridge = np.eye(k + 1) * l2
    ridge[0, 0] = 0.0
    active = set(weights)
    upper = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    for _ in range(iterations):
        if not active:
            break
        known = {g: np.concatenate([means[g], stds[g], weights[g]]) for g in active}
        value = F.create_map(*[x for g, v in known.items() for x in (F.lit(g), F.array(*map(F.lit, map(float, v))))])
        z = [F.lit(1.0)] + [(F.col(f"_x{j}") - F.col("_v")[j]) / F.col("_v")[k + j] for j in range(k)]
        at = rows.where(F.col("_g").isin(list(active))).withColumn("_v", value[F.col("_g")]).select("_g", "_y", "_v", *[c.alias(f"_z{j}") for j, c in enumerate(z)])
        margin = sum((F.col("_v")[2 * k + j] * F.col(f"_z{j}") for j in range(k + 1)), F.lit(0.0))
        at = at.withColumn("_p", 1 / (1 + F.exp(-margin)))
        slopes = [F.sum((F.col("_p") - F.col("_y")) * F.col(f"_z{j}")) for j in range(k + 1)]
        curves = [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in upper]
        for r in at.groupBy("_g").agg(*slopes, *curves).collect():
            w = weights[r[0]]
            hessian = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(upper, r[k + 2 :]):
                hessian[i, j] = hessian[j, i] = v
            step = np.linalg.solve(hessian + ridge, np.array(r[1 : k + 2]) + ridge @ w)
            weights[r[0]] = w - step
            if np.abs(step).max() < 1e-8:
                active.discard(r[0])
    return {g: Logistic(means[g], stds[g], w) for g, w in weights.items()}


def predicted(models: dict[object, Logistic], features: Sequence[str], group: Column | None = None) -> Column:
    """The probability that the model of a row's group gives."""
    table = F.create_map(*[x for g, m in models.items() for x in (F.lit(g), F.array(*map(F.lit, map(float, m.scaled()))))])
    w = table[group if group is not None else F.lit(0)]
    return 1 / (1 + F.exp(-sum((w[j + 1] * F.col(f).cast("double") for j, f in enumerate(features)), w[0])))


def oof_scores(df: DataFrame, features: Sequence[str], label: str, id_col: str, folds: int = 5, l2: float = L2) -> DataFrame:
    """(id_col, fold, score): each row scored by the model fitted on the other folds. Rows are dealt to folds by their id's
    hash within their class, so no row is ranked.
    """
    dealt = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED), F.col(label).cast("string"), F.col(id_col)), F.lit(folds)).cast("int"))
    others = F.filter(F.array(*map(F.lit, range(folds))), lambda f: f != F.col("fold"))
    models = fit_logreg(dealt.select(F.explode(others).alias("_fold"), label, *features), features, label, "_fold", l2)
    return dealt.select(id_col, "fold", predicted(models, features, F.col("fold")).alias("score"))


def interaction(cells: dict[tuple[int, int], tuple[int, int]]) -> dict[str, float | None]:
    """y ~ 1 + med + rag + med * rag from (successes, rows) by (med, rag): the interaction, its error, Wald's p, and the
    likelihood ratio against the model without it. All null with under ten rows or one outcome only.
    """
    x = np.array([[1.0, m, r, m * r] for m, r in cells])
    k, n = (np.array([c[i] for c in cells.values()], float) for i in (0, 1))
    if n.sum() < 10 or k.sum() in (0, n.sum()):
        return dict.fromkeys(("beta", "se", "wald_p", "lr", "lr_p"))

    def fitted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        beta, ridge = np.zeros(x.shape[1]), 1e-6 * np.eye(x.shape[1])  # the ridge keeps empty cells solvable
        chance = lambda: np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -20, 20))), 1e-7, 1 - 1e-7)
        for _ in range(50):
            p = chance()
            step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge, x.T @ (k - n * p))
            beta = beta + step
            if np.abs(step).max() < 1e-6:
                break
        p = chance()
        return beta, np.linalg.inv((x.T * (n * p * (1 - p))) @ x + ridge), float((k * np.log(p) + (n - k) * np.log(1 - p)).sum())

    beta, cov, full = fitted(x)
    se, lr = math.sqrt(max(0.0, cov[3, 3])), max(0.0, 2 * (full - fitted(x[:, :3])[2]))
    z = beta[3] / se if se else 0.0
    return {"beta": float(beta[3]), "se": se, "wald_p": math.erfc(abs(z) / math.sqrt(2)), "lr": lr, "lr_p": math.erfc(math.sqrt(lr / 2))}


def interaction_query(spark, sf):
    """Does the gain from retrieval differ between datasets? Rows are counted in eight cells; only these reach the driver."""
    p = _view(spark, sf, "pairs").where("NOT should_abstain")
    med = (F.col("dataset") == "medqa").cast("int").alias("med")
    rows = p.select(med, F.explode(F.array(F.struct(F.lit(0).alias("rag"), F.col("sa").alias("y")), F.struct(F.lit(1).alias("rag"), F.col("sb").alias("y")))).alias("r"))
    cells = {(r.med, r.rag): (r.k, r.n) for r in rows.groupBy("med", F.col("r.rag").alias("rag")).agg(F.count_if("r.y").alias("k"), F.count("*").alias("n")).collect()}
    got = interaction({(m, r): cells.get((m, r), (0, 0)) for m in (0, 1) for r in (0, 1)})
    digits = {"beta": 4, "se": 4, "wald_p": 6, "lr": 4, "lr_p": 6}
    return spark.createDataFrame([tuple(None if got[c] is None else round(got[c], d) for c, d in digits.items())], ", ".join(f"{c} double" for c in digits))


def _interval(draws: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    draws, b = np.sort(draws), len(draws)
    return float(draws[int(alpha / 2 * b)]), float(draws[min(int((1 - alpha / 2) * b), b - 1)])


def bootstrap_cells(counts: DataFrame, group: str, cells: Sequence[str], metric: Callable[[np.ndarray], np.ndarray], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(group, value, lo, hi): percentile bootstrap of a metric that depends on counts alone. To draw n rows with
    replacement is to draw their cells' counts from a multinomial distribution, so work doesn't grow with rows. metric
    takes counts as an array (replicates, cells). Each group has its own stream of random numbers, whatever else is there.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        n = np.array([int(row[c]) for c in cells])
        total = n.sum()
        if not total:
            return pd.DataFrame({group: [str(row[group])], "value": [0.0], "lo": [0.0], "hi": [0.0]})
        rng = np.random.default_rng([seed, zlib.crc32(str(row[group]).encode())])
        lo, hi = _interval(metric(rng.multinomial(total, n / total, replicates)))
        return pd.DataFrame({group: [str(row[group])], "value": [float(metric(n[None, :])[0])], "lo": [lo], "hi": [hi]})

    return counts.select(group, *cells).groupBy(group).applyInPandas(run, f"{group} string, value double, lo double, hi double")


def share(c: np.ndarray) -> np.ndarray:
    """Cells (hit, miss)."""
    return c[:, 0] / np.maximum(c.sum(axis=1), 1)


def gain(c: np.ndarray) -> np.ndarray:
    """Cells (both, first only, second only, neither): accuracy of the second less that of the first."""
    return (c[:, 2] - c[:, 1]) / np.maximum(c.sum(axis=1), 1)


def f1(c: np.ndarray) -> np.ndarray:
    """Cells (tp, fp, fn, tn)."""
    return 2 * c[:, 0] / np.maximum(2 * c[:, 0] + c[:, 1] + c[:, 2], 1)


def bootstrap_did(counts: DataFrame, group: str, strata: str, cells: Sequence[str], first: str, second: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(group, value, lo, hi): gain in stratum second less gain in stratum first; strata are drawn apart."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, zlib.crc32(str(pdf[group].iloc[0]).encode())])
        draws, value = np.zeros(replicates), 0.0
        for sign, name in ((-1, first), (1, second)):
            part = pdf.loc[pdf[strata] == name, list(cells)]
            n = part.iloc[0].to_numpy(np.int64) if len(part) else np.zeros(len(cells), np.int64)
            if n.sum():
                draws += sign * gain(rng.multinomial(n.sum(), n / n.sum(), replicates))
                value += sign * float(gain(n[None, :])[0])
        lo, hi = _interval(draws)
        return pd.DataFrame({group: [str(pdf[group].iloc[0])], "value": [value], "lo": [lo], "hi": [hi]})

    return counts.select(group, strata, *cells).groupBy(group).applyInPandas(run, f"{group} string, value double, lo double, hi double")


_FEATURES = ("confidence", "cut", "seconds")


def _scored(spark, sf) -> DataFrame:
    return _view(spark, sf, "answerable").select("id", "confidence", F.coalesce("truncated", F.lit(False)).cast("int").alias("cut"), F.least("seconds", F.lit(20.0)).alias("seconds"), F.col("strict").cast("int").alias("strict"))


def fit_query(spark, sf):
    w = fit_logreg(_scored(spark, sf), _FEATURES, "strict")[0].weights
    return spark.createDataFrame([(t, round(float(x), 6)) for t, x in zip(("intercept", *_FEATURES), w)], "term string, weight double")


def oof_query(spark, sf):
    return oof_scores(_scored(spark, sf), _FEATURES, "strict", "id").withColumn("score", F.round("score", 6))


def _paired(spark, sf, *by: str) -> DataFrame:
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return _view(spark, sf, "pairs").groupBy(*by).agg(n("sa AND sb", "both"), n("sa AND NOT sb", "only_a"), n("sb AND NOT sa", "only_b"), n("NOT sa AND NOT sb", "neither"))


_CELLS = ("both", "only_a", "only_b", "neither")


def bootstrap_mean(spark, sf):
    counts = _view(spark, sf, "answers").groupBy("model").agg(F.count_if("strict").alias("hit"), F.count_if(~F.col("strict")).alias("miss"))
    return bootstrap_cells(counts, "model", ("hit", "miss"), share)


def bootstrap_metric(spark, sf):
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    a = "confidence < 0.5e0"
    counts = _view(spark, sf, "answers").groupBy("model").agg(n(f"should_abstain AND {a}", "tp"), n(f"NOT should_abstain AND {a}", "fp"), n(f"should_abstain AND NOT {a}", "fn"), n(f"NOT should_abstain AND NOT {a}", "tn"))
    return bootstrap_cells(counts, "model", ("tp", "fp", "fn", "tn"), f1)


def bootstrap_paired(spark, sf):
    return bootstrap_cells(_paired(spark, sf, "dataset"), "dataset", _CELLS, gain, 10_000)


def bootstrap_did_query(spark, sf):
    return bootstrap_did(_paired(spark, sf, "split", "dataset"), "split", "dataset", _CELLS, "medqa", "pubmedqa")


QUERIES = collect(
    # a saturated model of four cells: its coefficients and their errors have closed forms; an empty cell gives null
    Plan(
        "logit_interaction",
        """
SELECT round(l00, 9) AS intercept, round(l10 - l00, 9) AS med, round(l01 - l00, 9) AS rag, round(l11 - l10 - l01 + l00, 9) AS interaction, round(sqrt(v), 9) AS se, round((l11 - l10 - l01 + l00) / sqrt(v), 9) AS z
FROM (SELECT max(CASE WHEN med = 0 AND rag = 0 THEN l END) AS l00, max(CASE WHEN med = 1 AND rag = 0 THEN l END) AS l10, max(CASE WHEN med = 0 AND rag = 1 THEN l END) AS l01, max(CASE WHEN med = 1 AND rag = 1 THEN l END) AS l11, sum(v) AS v
  FROM (SELECT med, rag, ln(k / nullif(n - k, 0)) AS l, 1 / nullif(k, 0) + 1 / nullif(n - k, 0) AS v FROM (
    SELECT CASE WHEN dataset = 'medqa' THEN 1 ELSE 0 END AS med, rag, 1e0 * count_if(CASE WHEN rag = 1 THEN sb ELSE sa END) AS k, 1e0 * count(*) AS n
    FROM {pairs} CROSS JOIN (VALUES (0), (1)) AS t(rag) WHERE NOT should_abstain GROUP BY CASE WHEN dataset = 'medqa' THEN 1 ELSE 0 END, rag) AS c) AS d) AS e""",
    ),
) | {k: (f, None) for k, f in {"interaction_test": interaction_query, "fit_logreg": fit_query, "oof_scores": oof_query, "bootstrap_mean": bootstrap_mean, "bootstrap_metric": bootstrap_metric, "bootstrap_paired": bootstrap_paired, "bootstrap_did": bootstrap_did_query}.items()}
