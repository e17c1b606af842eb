"""Tests, gates and sweeps against plain versions that don't share their SQL."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import gates, inference, selective


def run(name, spark, module=selective, **inputs):
    return module.QUERIES[name][0].run(spark, **{k: spark.createDataFrame(v) if isinstance(v, pd.DataFrame) else v for k, v in inputs.items()})


@pytest.mark.parametrize("n", [0, 5, 19, 320, 330, 350, 351, 619, 620, 650, 700])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    pieces = [words] if n <= 350 else [words[s : s + 350] for s in range(0, n, 300)]
    want = [" ".join(p) for j, p in enumerate(pieces) if j == 0 or len(p) >= 20]
    text = " ".join(words[:5]) + " \n" + " ".join(words[5:])
    assert spark.range(1).select(T.chunks(F.lit(text)).alias("c")).first().c == want


def test_erfc(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.5, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{selective.erfc('x')} AS e").collect()
    assert all(abs(r.e - math.erfc(r.x)) < 1.3e-7 * max(math.erfc(r.x), 1e-30) + 1e-30 for r in got)


def test_wilcoxon(spark):
    rng = np.random.default_rng(1)
    rows = [("big", float(d)) for d in np.round(rng.normal(0.05, 0.2, 60), 1)] + [("few", 0.1), ("few", 0.2), ("few", -0.3), ("few", 0.4)]
    pairs = pd.DataFrame([(g, 0.5, 0.5 + d) for g, d in rows], columns=["dataset", "ca", "cb"])
    got = {r.dataset: r for r in run("wilcoxon", spark, pairs=pairs).collect()}
    d = np.array([round(x, 9) for g, x in rows if g == "big" and x != 0])
    r = pd.Series(abs(d)).rank().to_numpy()
    n, w = len(d), r[d > 0].sum()
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert got["big"].n == n and got["big"].w == pytest.approx(w) and got["big"].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-6)
    assert got["few"].p == pytest.approx(2 * (1 + 4) / 16)


def test_cmh(spark):
    tables = [[(30, 10), (15, 25)], [(35, 15), (10, 20)]]
    rows = []
    for k, ((a, b), (c, d)) in enumerate(tables):
        n = a + b
        rows += [(f"d{k}", "x", i < a, i < c * 1, False) for i in range(n)]
    pairs = pd.DataFrame(rows, columns=["dataset", "category", "sb", "sa", "should_abstain"])
    got = run("cmh", spark, pairs=pairs).first()
    R = S = PR = PSQR = QS = E = V = A = 0.0
    for (a, b), (c, _) in tables:
        d = a + b - c
        n = 2 * (a + b)
        r, s, p, q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
        R, S, PR, PSQR, QS = R + r, S + s, PR + p * r, PSQR + p * s + q * r, QS + q * s
        A, E, V = A + a, E + (a + b) * (a + c) / n, V + (a + b) ** 2 * (a + c) * (b + d) / (n * n * (n - 1))
    se = math.sqrt(PR / (2 * R * R) + PSQR / (2 * R * S) + QS / (2 * S * S))
    assert got.odds == pytest.approx(R / S) and (got.lo, got.hi) == (pytest.approx(R / S * math.exp(-1.96 * se)), pytest.approx(R / S * math.exp(1.96 * se)))
    assert got.chi2_raw == pytest.approx((A - E) ** 2 / V) and got.chi2 == pytest.approx((abs(A - E) - 0.5) ** 2 / V) and got.p == pytest.approx(math.erfc(math.sqrt(got.chi2 / 2)), abs=2e-6)


def test_interaction():
    cells = {(0, 0): (40, 100), (0, 1): (55, 100), (1, 0): (30, 90), (1, 1): (70, 95)}
    got = inference.interaction(cells)
    odds = {c: math.log(k / (n - k)) for c, (k, n) in cells.items()}
    assert got["beta"] == pytest.approx(odds[1, 1] - odds[1, 0] - odds[0, 1] + odds[0, 0], abs=1e-4)
    assert got["se"] == pytest.approx(math.sqrt(sum(1 / k + 1 / (n - k) for k, n in cells.values())), abs=1e-4)
    best = lambda b: sum(k * math.log(p) + (n - k) * math.log(1 - p) for (m, r), (k, n) in cells.items() for p in [1 / (1 + math.exp(-(b[0] + b[1] * m + b[2] * r)))])
    b, step = [0.0] * 3, 0.5
    while step > 1e-7:  # a plain search for the greatest likelihood without the interaction
        tries = [[x + (s if i == j else 0) for j, x in enumerate(b)] for i in range(3) for s in (step, -step)]
        top = max(tries, key=best)
        b, step = (top, step) if best(top) > best(b) else (b, step / 2)
    full = sum(k * math.log(k / n) + (n - k) * math.log(1 - k / n) for k, n in cells.values())
    assert got["lr"] == pytest.approx(2 * (full - best(b)), abs=1e-3) and got["lr_p"] == pytest.approx(math.erfc(math.sqrt(got["lr"] / 2)))
    assert inference.interaction({c: (0, 3) for c in cells})["beta"] is None


def answers(n=400, seed=3):
    rng = np.random.default_rng(seed)
    conf = np.round(rng.random(n), 2)
    return pd.DataFrame({"model": "m", "split": "validation", "confidence": conf, "top_rerank_score": rng.random(n), "should_abstain": rng.random(n) < 0.4, "correct": rng.random(n) < conf, "strict": rng.random(n) < conf})


def test_safe_threshold_and_budgets(spark):
    for seed in (3, 4, 5):
        a = answers(seed=seed)
        s, sa, c = 1 - a.confidence.to_numpy(), a.should_abstain.to_numpy(), a.correct.to_numpy()
        cands = []
        for t in [*np.unique(s), np.inf]:
            kept = ~sa & (s < t)
            cov, acc = kept.sum() / (~sa).sum(), c[kept].mean() if kept.any() else 0.0
            if cov >= 0.5:
                cands.append((acc >= 0.3, cov, acc, float(t)))
        ok = [x for x in cands if x[0]]
        want = max(ok, key=lambda x: (x[1], x[2]))[3] if ok else max(cands, key=lambda x: (x[2], x[1]))[3]
        assert run("tune_tau_safe", spark, answers=a).first().tau == pytest.approx(want)
        got = {(r.which, r.budget): r.recall for r in run("far_budget_table", spark, answers=a).collect()}
        for which, score in (("confidence", s), ("rerank", 1 - a.top_rerank_score.to_numpy())):
            for budget in (0.01, 0.02, 0.05, 0.1, 0.15):
                ok = [(sa & (score >= t)).sum() / sa.sum() for t in np.unique(score) if (~sa & (score >= t)).sum() / (~sa).sum() <= budget]
                assert got.get((which, budget)) == (pytest.approx(max(ok)) if ok else None)


def test_bins_follow_the_number_of_levels(spark):
    a = answers().assign(id=range(400))
    a.loc[:199, "model"] = "m0"  # its confidences become quarters: five levels
    got = pd.DataFrame([r.asDict() for r in run("ece_bins", spark, answerable=a).collect()])
    for m, g in a.groupby("model"):
        conf = (g.confidence * 4).map(lambda x: math.floor(x + 0.5)) / 4 if m == "m0" else g.confidence
        bins = conf if conf.nunique() <= 5 else conf.map(lambda x: min(4, math.floor(x * 5)) / 5)
        want = {b: (len(x), conf[x.index].mean(), x.strict.mean()) for b, x in g.groupby(bins)}
        have = {r.bin: (r.n, r.conf, r.acc) for r in got[got.model == m].itertuples()}
        assert have.keys() == want.keys() and all(have[b] == pytest.approx(want[b]) for b in want)


def test_rules_of_samples(spark):
    rng = np.random.default_rng(7)
    rows = [(q, "test", bool(q % 3 == 0), rng.choice(["A", "B", "C", None], p=[0.5, 0.2, 0.1, 0.2]), bool(rng.random() < 0.3)) for q in range(80) for _ in range(5)]
    got = {(r.rule, round(r.tau, 1)): (r.tp, r.fp, r.fn, r.tn) for r in run("sc_rules_sweep", spark, runs=pd.DataFrame(rows, columns=["qid", "split", "should_abstain", "pred", "truncated"])).collect()}
    by = {}
    for q, _, sa, p, t in rows:
        by.setdefault((q, sa), []).append((p or "ABSTAIN", t))
    for tau in (0.2, 0.4, 0.6, 0.8, 1.0):
        for rule in ("current", "fraction", "agreement_only"):
            counts = Counter()
            for (_, sa), s in by.items():
                votes = Counter(p for p, _ in s)
                most = max(votes.values())
                low = most / 5 < tau
                cut, unsure = sum(t for _, t in s), votes["ABSTAIN"]
                majority = min((p for p, n in votes.items() if n == most), key=lambda p: (p == "ABSTAIN", p))
                hit = low or {"current": cut > 0 or unsure > 0, "fraction": cut >= 3 or unsure >= 3, "agreement_only": majority == "ABSTAIN"}[rule]
                counts[sa, hit] += 1
            assert got[rule, tau] == (counts[True, True], counts[False, True], counts[True, False], counts[False, False])


def test_gates_tell_faults(spark):
    parts = pd.DataFrame([("base_test", "a", "x"), ("base_test", "a", "y"), ("base_val", "b", "x"), ("extra_test", "c", "y"), ("extra_val", "b", "z")], columns=["part", "id", "question"])
    got = {r.check_name: r.faults for r in run("audit_overlap", spark, gates, audit_parts=parts).collect()}
    assert len(got) == 10 and {k for k, v in got.items() if v} == {"base_test ids differ", "base texts of test and val", "ids of base and extra", "test texts of base and extra"}
    log = pd.DataFrame([("tau", 1), ("tau", 2), ("late", 3), ("lost", 9)], columns=["parameter", "qid"])
    splits = pd.DataFrame([(1, "validation"), (2, "validation"), (3, "test")], columns=["qid", "split"])
    assert {r.parameter: (r.outside, r.ok) for r in run("audit_fit_split", spark, gates, fit_log=log, question_splits=splits).collect()} == {"tau": (0, True), "late": (1, False), "lost": (1, False)}
    want = pd.DataFrame([(q, "A") for q in range(10)], columns=["qid", "gold"])
    rows = [("ok", q, "A", "c") for q in range(10)] + [("less", q, "A", "c") for q in range(8)] + [("more", q, "A", "c") for q in [*range(10), 3, 77]] + [("wrong", q, "B" if q == 4 else "A", "c") for q in range(10)]
    out = pd.DataFrame(rows, columns=["model", "qid", "gold", "category"])
    got = {r.model: (r.duplicates, r.missing, r.unexpected, r.misaligned, r.ok) for r in run("audit_outputs", spark, gates, model_outputs=out, expected_answers=want).collect()}
    assert got == {"ok": (0, 0, 0, 0, True), "less": (0, 2, 0, 0, False), "more": (1, 0, 1, 0, False), "wrong": (0, 0, 0, 1, False)}
    runs = pd.DataFrame([(q, "c") for q in range(10)], columns=["qid", "category"])
    got = {r.model: (r.count_ok, r.ids_ok, r.rule_ok) for r in run("audit_sweeps", spark, gates, model_outputs=out, runs=runs).collect()}
    assert got == {"ok": (True, True, True), "less": (False, False, True), "more": (False, False, True), "wrong": (True, True, True)}
    answered = pd.DataFrame([("m", True), ("m", False), ("n", True)], columns=["model", "strict"])
    lines = pd.DataFrame([("| m | 2 | 1 |",), ("| n | 1 | 0 |",)], columns=["line"])
    assert {r.model: r.ok for r in run("cross_check", spark, gates, answers=answered, report_lines=lines).collect()} == {"m": True, "n": False}
    frozen = pd.DataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], columns=["name", "v"])
    now = pd.DataFrame([("a", "2"), ("a", "1"), ("b", "x")], columns=["name", "v"])
    assert {r.name: r.ok for r in run("audit_hashes", spark, gates, frozen_rows=frozen, current_rows=now).collect()} == {"a": True, "b": False, "c": False}
    ranked = pd.DataFrame([(1, i) for i in range(5)] + [(2, i) for i in (0, 1, 2, 3, 3)] + [(3, 1)], columns=["qid", "idx"])
    r = run("gate_retrieval", spark, gates, ranked=ranked).first()
    assert (r.queries, r.with_duplicates, r.not_five, r.ok) == (3, 1, 1, False)
