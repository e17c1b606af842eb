"""Calibration, selective prediction, gates, grounding, statistics, decision rules and integrity checks."""

from ..plans import views  # noqa: F401
from ..plans.core import Plan, collect, view
from . import orders  # noqa: F401

_SIG = "CASE WHEN strict THEN 1e0 ELSE 0e0 END"
view("bins", "SELECT model, least(9, greatest(0, CAST(floor(confidence * 10) AS INT))) AS bin, count(*) AS n, avg(confidence) AS conf, avg(CASE WHEN strict THEN 1e0 ELSE 0e0 END) AS acc FROM {answerable} GROUP BY model, least(9, greatest(0, CAST(floor(confidence * 10) AS INT)))")
# one row per model and threshold: abstain below tau; truth: should_abstain
view("swept", "SELECT split, model, k, tau, count_if(should_abstain AND confidence < tau) AS tp, count_if(NOT should_abstain AND confidence < tau) AS fp, count_if(should_abstain AND confidence >= tau) AS fn, count_if(NOT should_abstain AND confidence >= tau) AS tn, count_if(strict AND confidence >= tau) AS good FROM {answers} CROSS JOIN {thresholds} AS t GROUP BY split, model, k, tau")
view("swept_f1", "SELECT *, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1, coalesce(tp * 1e0 / nullif(tp + fp, 0), 0e0) AS precision, coalesce(tp * 1e0 / nullif(tp + fn, 0), 0e0) AS recall, fp * 1e0 / nullif(fp + tn, 0) AS far FROM {swept} AS s")
# abstain below tau, for tau in {0}, all confidences and {1}: counts by distinct value, then running sums
view("tau_sweep", """
SELECT *, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1, coalesce(tp * 1e0 / nullif(tp + fp, 0), 0e0) AS precision
FROM (
  SELECT split, model, tau, tp, fp, all_u - tp AS fn, all_a - fp AS tn
  FROM (
    SELECT split, model, tau,
      CAST(coalesce(sum(u) OVER (PARTITION BY split, model ORDER BY tau ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tp,
      CAST(coalesce(sum(a) OVER (PARTITION BY split, model ORDER BY tau ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fp,
      CAST(sum(u) OVER (PARTITION BY split, model) AS BIGINT) AS all_u, CAST(sum(a) OVER (PARTITION BY split, model) AS BIGINT) AS all_a
    FROM (
      SELECT split, model, tau, sum(u) AS u, sum(a) AS a
      FROM (
        SELECT split, model, confidence AS tau, count_if(should_abstain) AS u, count_if(NOT should_abstain) AS a FROM {answers} GROUP BY split, model, confidence
        UNION ALL SELECT DISTINCT split, model, 0e0, 0, 0 FROM {answers}
        UNION ALL SELECT DISTINCT split, model, 1e0, 0, 0 FROM {answers}) AS c
      GROUP BY split, model, tau) AS v) AS w) AS t""")
view("best_f1", "SELECT model, tau FROM (SELECT model, tau, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, precision DESC, tau) AS r FROM {tau_sweep} AS s WHERE split = 'validation') AS x WHERE r = 1")
# abstain where the score 1 - confidence is at least tau, for tau in all scores
view("score_sweep", """
SELECT *, coalesce(2e0 * tp / nullif(tp + fp + all_u, 0), 0e0) AS f1, coalesce(tp * 1e0 / nullif(all_u, 0), 0e0) AS recall, fp * 1e0 / nullif(all_a, 0) AS far
FROM (
  SELECT split, model, tau,
    CAST(sum(u) OVER (PARTITION BY split, model ORDER BY tau DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
    CAST(sum(a) OVER (PARTITION BY split, model ORDER BY tau DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
    CAST(sum(u) OVER (PARTITION BY split, model) AS BIGINT) AS all_u, CAST(sum(a) OVER (PARTITION BY split, model) AS BIGINT) AS all_a
  FROM (
    SELECT split, model, 1 - confidence AS tau, count_if(should_abstain) AS u, count_if(NOT should_abstain) AS a
    FROM {answers} GROUP BY split, model, 1 - confidence) AS v) AS w""")
view("steps", "SELECT CAST(k AS INT) AS k FROM (SELECT explode(sequence(0, 300)) AS k) AS s", "SELECT CAST(k AS INT) AS k FROM (SELECT unnest(generate_series(0, 300)) AS k) AS s")
view("probs", "SELECT id, model, gold, split, p[1] / s AS a, p[2] / s AS b, p[3] / s AS c, p[4] / s AS d FROM (SELECT *, p[1] + p[2] + p[3] + p[4] AS s FROM (SELECT id, model, gold, split, array(1e0, 1e0 + id % 3, 1e0 + id % 5, 1e0 + id % 7, 1e0 + id % 11) AS p FROM {runs} WHERE NOT should_abstain) AS x) AS y", "SELECT id, model, gold, split, p[2] / s AS a, p[3] / s AS b, p[4] / s AS c, p[5] / s AS d FROM (SELECT *, p[2] + p[3] + p[4] + p[5] AS s FROM (SELECT id, model, gold, split, [1e0, 1e0 + id % 3, 1e0 + id % 5, 1e0 + id % 7, 1e0 + id % 11] AS p FROM {runs} WHERE NOT should_abstain) AS x) AS y")
view("discordant", "SELECT dataset, count_if(sa AND NOT sb) AS b, count_if(NOT sa AND sb) AS c FROM {pairs} GROUP BY dataset")
# two-sided exact binomial tail, summed in logs: ln C(n, i) by running sums of logs
view("mcnemar_p", """SELECT dataset, b, c, n, CASE WHEN n = 0 THEN 1e0 ELSE least(1e0, 2 * sum(CASE WHEN i <= least(b, c) THEN exp(ln_c - n * ln(2e0)) ELSE 0e0 END)) END AS p FROM (
  SELECT dataset, b, c, n, i, sum(CASE WHEN i = 0 THEN 0e0 ELSE ln((n - i + 1) * 1e0) - ln(i * 1e0) END) OVER (PARTITION BY dataset ORDER BY i) AS ln_c
  FROM (SELECT dataset, b, c, b + c AS n, explode(sequence(CAST(0 AS BIGINT), least(b, c))) AS i FROM {discordant} AS d) AS x) AS y GROUP BY dataset, b, c, n""",
  """SELECT dataset, b, c, n, CASE WHEN n = 0 THEN 1e0 ELSE least(1e0, 2 * sum(CASE WHEN i <= least(b, c) THEN exp(ln_c - n * ln(2e0)) ELSE 0e0 END)) END AS p FROM (
  SELECT dataset, b, c, n, i, sum(CASE WHEN i = 0 THEN 0e0 ELSE ln((n - i + 1) * 1e0) - ln(i * 1e0) END) OVER (PARTITION BY dataset ORDER BY i) AS ln_c
  FROM (SELECT dataset, b, c, b + c AS n, unnest(generate_series(CAST(0 AS BIGINT), least(b, c))) AS i FROM {discordant} AS d) AS x) AS y GROUP BY dataset, b, c, n""")  # fmt: skip
view("strata", "SELECT dataset, count_if(sb) * 1e0 AS a, count_if(NOT sb) * 1e0 AS b, count_if(sa) * 1e0 AS c, count_if(NOT sa) * 1e0 AS d, 2e0 * count(*) AS n FROM {pairs} WHERE NOT should_abstain GROUP BY dataset")
_CHI = "CASE WHEN sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) > 0 THEN power(greatest(0e0, abs(sum(a - (a + b) * (a + c) / n)) - 0.5e0), 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) END"
view("cells", f"SELECT model, avg({_SIG}) AS acc, avg(seconds) AS s, avg(CASE WHEN coalesce(truncated, false) THEN 1e0 ELSE 0e0 END) <= 0.15e0 AND avg(CASE WHEN coalesce(parsed, true) THEN 1e0 ELSE 0e0 END) >= 0.9e0 AS eligible FROM {{answerable}} GROUP BY model")
_GAP = "round(avg(CASE WHEN sb THEN 1e0 ELSE 0e0 END) - avg(CASE WHEN sa THEN 1e0 ELSE 0e0 END), 9)"
_GATE = "CASE WHEN {{cond}} THEN sb ELSE sa END"
_AT_COVERAGE = """
SELECT model, pct, round(acc, 9) AS acc
FROM {curve} CROSS JOIN (VALUES (100), (80), (60), (40), (20)) AS p(pct)
WHERE k = CAST(bround(pct * n / 100e0, 0) AS BIGINT)"""
# 101 quantiles of the scores by rounded place (half to even), and one value beyond the greatest
_QUANTILES = """
SELECT DISTINCT model, round(x, 9) AS tau
FROM (
  SELECT v.model, v.x
  FROM (
    SELECT model, x, n, sum(n) OVER (PARTITION BY model ORDER BY x) AS upto, sum(n) OVER (PARTITION BY model) AS total
    FROM (SELECT model, top_rerank_score AS x, count(*) AS n FROM {runs} WHERE split = 'validation' AND top_rerank_score IS NOT NULL GROUP BY model, top_rerank_score) AS c) AS v
  JOIN (SELECT k FROM {steps} WHERE k <= 100) AS g ON bround(g.k / 100e0 * (v.total - 1), 0) >= v.upto - v.n AND bround(g.k / 100e0 * (v.total - 1), 0) < v.upto
  UNION ALL SELECT model, max(top_rerank_score) + 0.01e0 FROM {runs} WHERE split = 'validation' AND top_rerank_score IS NOT NULL GROUP BY model) AS q"""

QUERIES = collect(
    Plan("risk_coverage", "SELECT model, id, round(1 - acc, 9) AS risk, round(k * 1e0 / n, 9) AS coverage FROM {curve}"),
    # the place is rounded, half to even
    Plan("sel_acc_at_cov", _AT_COVERAGE, _AT_COVERAGE.replace("bround(", "round_even(")),
    Plan("top20_wrong", "SELECT model, round(1 - acc, 9) AS wrong FROM {curve} WHERE k = CAST(floor(0.2e0 * n) AS BIGINT)"),
    Plan("aurc", "SELECT model, round(avg(1 - acc), 9) AS aurc FROM {curve} GROUP BY model"),
    Plan("risk_coverage_sys", "SELECT model, id, k AS answered, round(errors * 1e0 / k, 9) AS risk FROM {curve_all}"),
    # without rows of both kinds: 0.5, or null where that must show
    Plan(
        "auroc",
        """
SELECT model, coalesce(auroc, 0.5e0) AS auroc, auroc AS auroc_or_null
FROM (
  SELECT model, round((sum(CASE WHEN good THEN r ELSE 0e0 END) - count_if(good) * (count_if(good) + 1) / 2e0)
    / nullif(count_if(good) * count_if(NOT good), 0), 9) AS auroc
  FROM {binary_ranks} GROUP BY model) AS x""",
    ),
    Plan("ece", "SELECT model, round(sum(n * abs(conf - acc)) / sum(n), 9) AS ece FROM {bins} GROUP BY model"),
    Plan("calibration", f"SELECT b.model, round(b.ece, 9) AS ece, round(b.mce, 9) AS mce, round(p.brier, 9) AS brier, round(p.nll, 9) AS nll FROM (SELECT model, sum(n * abs(conf - acc)) / sum(n) AS ece, max(abs(conf - acc)) AS mce FROM {{bins}} GROUP BY model) AS b JOIN (SELECT model, avg(power(confidence - {_SIG}, 2)) AS brier, avg(-ln(greatest(1e-12, CASE WHEN strict THEN confidence ELSE 1 - confidence END))) AS nll FROM {{answerable}} GROUP BY model) AS p ON b.model = p.model"),
    Plan(
        "fit_temperature",
        """
SELECT model, round(t, 9) AS t
FROM (
  SELECT model, t, row_number() OVER (PARTITION BY model ORDER BY round(nll, 10), CASE WHEN t = 1 THEN 0 ELSE 1 END, t) AS r
  FROM (
    SELECT model, t, avg(-ln(greatest(1e-12, power(CASE gold WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END, 1 / t)
      / (power(a, 1 / t) + power(b, 1 / t) + power(c, 1 / t) + power(d, 1 / t))))) AS nll
    FROM (SELECT model, split, gold, greatest(a, 1e-12) AS a, greatest(b, 1e-12) AS b, greatest(c, 1e-12) AS c, greatest(d, 1e-12) AS d FROM {probs}) AS p
    CROSS JOIN (SELECT 1e0 AS t UNION ALL SELECT 0.1e0 + k * ((30e0 - 0.1e0) / 300) FROM {steps}) AS g
    WHERE split = 'validation' AND gold IS NOT NULL GROUP BY model, t) AS n) AS x
WHERE r = 1""",
    ),
    Plan("temp_scaled_conf", "SELECT id, round(power(greatest(a, b, c, d), 0.5e0) / (power(a, 0.5e0) + power(b, 0.5e0) + power(c, 0.5e0) + power(d, 0.5e0)), 9) AS conf FROM {probs}"),
    Plan("renorm_probs", "SELECT id, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c, round(d, 9) AS d FROM {probs}"),
    Plan("argmax_letter", "SELECT id, CASE WHEN a >= b AND a >= c AND a >= d THEN 'A' WHEN b >= c AND b >= d THEN 'B' WHEN c >= d THEN 'C' ELSE 'D' END AS letter FROM {probs}"),
    Plan("sc_features", "SELECT qid, round(avg(CASE WHEN coalesce(truncated, false) THEN 1e0 ELSE 0e0 END), 9) AS truncation_rate, round(avg(CASE WHEN pred IS NULL THEN 1e0 ELSE 0e0 END), 9) AS insufficient_rate FROM {runs} GROUP BY qid"),
    Plan(
        "eval_fixed_cov",
        f"""
SELECT a.model, count_if(a.confidence < t.tau) AS abstained, round(avg(CASE WHEN a.confidence >= t.tau THEN {_SIG} END), 9) AS acc
FROM {{answerable}} AS a
JOIN (SELECT model, confidence AS tau FROM {{curve_validation}} WHERE k = CAST(floor(0.8e0 * n) AS BIGINT)) AS t ON a.model = t.model
WHERE a.split = 'test' GROUP BY a.model""",
    ),
    Plan("tune_tau_f1", "SELECT model, tau FROM {best_f1}"),
    Plan(
        "eval_abstention",
        """
SELECT model, tp, fp, fn, tn, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 9) AS f1
FROM (
  SELECT a.model, count_if(should_abstain AND confidence < tau) AS tp, count_if(NOT should_abstain AND confidence < tau) AS fp,
    count_if(should_abstain AND confidence >= tau) AS fn, count_if(NOT should_abstain AND confidence >= tau) AS tn
  FROM {answers} AS a JOIN {best_f1} AS b ON a.model = b.model WHERE a.split = 'test' GROUP BY a.model) AS x""",
    ),
    Plan("tune_tau_grid", "SELECT model, min(tau) AS tau FROM (SELECT model, tau, round(f1, 12) AS f1, max(round(f1, 12)) OVER (PARTITION BY model) AS best FROM {swept_f1} AS s WHERE split = 'validation') AS x WHERE f1 = best GROUP BY model"),
    Plan(
        "conformal_tau",
        """
SELECT m.model, CASE WHEN m.answerable > 0 THEN coalesce(b.tau, 1e0) END AS tau
FROM (SELECT model, count_if(NOT should_abstain) AS answerable FROM {answers} WHERE split = 'validation' GROUP BY model) AS m
LEFT JOIN (
  SELECT model, tau, row_number() OVER (PARTITION BY model ORDER BY recall DESC, far, tau) AS r
  FROM {score_sweep} AS s WHERE split = 'validation' AND far <= 0.05e0) AS b ON m.model = b.model AND b.r = 1""",
    ),
    Plan(
        "conformal_score",
        """
SELECT model, tau
FROM (
  SELECT model, tau, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, recall DESC, tau) AS r
  FROM {score_sweep} AS s WHERE split = 'validation' AND far <= 0.05e0) AS x
WHERE r = 1""",
    ),
    Plan("best_rule", "SELECT model, tau FROM (SELECT model, tau, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, far, tp + fp DESC, tau) AS r FROM {swept_f1} AS s WHERE split = 'test') AS x WHERE r = 1"),
    Plan("tau_for_coverage", "SELECT model, confidence AS tau FROM {curve} WHERE n - k = CAST(ceil((n - 1) * 0.25e0) AS BIGINT)"),
    # 51 thresholds k / 50: rows are counted by the last threshold that their score reaches, and these counts are added up
    Plan(
        "risk_cov_grid",
        """
SELECT model, k, round(tp * 1e0 / nullif(tp + fn, 0), 9) AS recall, round(fp * 1e0 / nullif(fp + tn, 0), 9) AS far,
  round(coalesce(tp * 1e0 / nullif(tp + fp, 0), 0e0), 9) AS precision, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 9) AS f1,
  round((tn + fn) * 1e0 / (tp + fp + fn + tn), 9) AS coverage, round(coalesce(good * 1e0 / nullif(tn, 0), 0e0), 9) AS accuracy
FROM (
  SELECT model, k, CAST(sum(CASE WHEN reached >= k THEN u ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN reached >= k THEN a ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN reached < k THEN u ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN reached < k THEN a ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN reached < k THEN good ELSE 0 END) AS BIGINT) AS good
  FROM (
    SELECT model, reached, count_if(should_abstain) AS u, count_if(NOT should_abstain) AS a, count_if(NOT should_abstain AND correct) AS good
    FROM (
      SELECT model, should_abstain, correct, CASE WHEN s >= (b + 1) / 50e0 THEN b + 1 WHEN s < b / 50e0 THEN b - 1 ELSE b END AS reached
      FROM (SELECT model, should_abstain, correct, 1 - confidence AS s, CAST(floor((1 - confidence) * 50) AS INT) AS b FROM {answers} WHERE split = 'test') AS x) AS y
    GROUP BY model, reached) AS c
  CROSS JOIN (SELECT k FROM {steps} WHERE k <= 50) AS g
  GROUP BY model, k) AS t""",
    ),
    Plan("quantile_grid", _QUANTILES, _QUANTILES.replace("bround(", "round_even(")),
    # gates and grounding
    Plan("adaptive_gate", f"SELECT qid, {_GATE.replace('{{cond}}', 'coalesce(rerank >= 0.5e0, false)')} AS by_rerank, {_GATE.replace('{{cond}}', 'cb > ca')} AS by_conf, {_GATE.replace('{{cond}}', 'coalesce(rerank >= 0.5e0, false) AND cb > ca + 0.05e0')} AS combined FROM {{pairs}}"),
    Plan("tune_gate", "SELECT delta, tau FROM (SELECT delta, tau, row_number() OVER (ORDER BY good DESC, delta, tau) AS r FROM (SELECT delta, tau, count_if(CASE WHEN coalesce(rerank >= tau, false) AND cb > ca + delta THEN sb ELSE sa END) AS good FROM {pairs} CROSS JOIN {thresholds} AS t CROSS JOIN (VALUES (0e0), (0.05e0), (0.1e0), (0.2e0)) AS d(delta) WHERE split = 'validation' GROUP BY delta, tau) AS g) AS x WHERE r = 1"),
    Plan("gate_cost", "SELECT dataset, round(avg(ta + CASE WHEN coalesce(rerank >= 0.5e0, false) THEN tb + 0.1273e0 ELSE 0e0 END), 9) AS s_per_q FROM {pairs} GROUP BY dataset"),
    Plan("rag_transitions", "SELECT dataset, count_if(NOT sa AND sb) AS fixed, count_if(sa AND NOT sb) AS induced, count_if(NOT sa AND sb) - count_if(sa AND NOT sb) AS net FROM {pairs} GROUP BY dataset"),
    # statistics
    Plan("mcnemar", "SELECT dataset, b, c, round(p, 9) AS p, round(CASE WHEN b > 0 THEN c * 1e0 / b ELSE (c + 0.5e0) / (b + 0.5e0) END, 9) AS odds FROM {mcnemar_p}"),
    Plan("holm", "SELECT dataset, round(max(least(1e0, (m - r + 1) * p)) OVER (ORDER BY r), 9) AS p_holm FROM (SELECT dataset, p, row_number() OVER (ORDER BY p, dataset) AS r, count(*) OVER () AS m FROM {mcnemar_p}) AS x"),
    Plan("paired_wald", "SELECT dataset, round(d, 9) AS d, round(d - 1.959963984540054e0 * se, 9) AS lo, round(d + 1.959963984540054e0 * se, 9) AS hi FROM (SELECT dataset, (c - b) * 1e0 / n AS d, sqrt(greatest(0e0, (b + c) - power(c - b, 2) * 1e0 / n)) / n AS se FROM (SELECT dataset, count(*) AS n, count_if(sa AND NOT sb) AS b, count_if(NOT sa AND sb) AS c FROM {pairs} GROUP BY dataset) AS t) AS x"),
    Plan("cmh_simple", f"SELECT round(odds, 9) AS odds, CASE WHEN chi2 < 3.841458820694124e0 THEN 'no effect' WHEN odds > 1 THEN 'helps' ELSE 'harms' END AS reading FROM (SELECT sum(a * d / n) / nullif(sum(b * c / n), 0) AS odds, {_CHI} AS chi2 FROM {{strata}}) AS x"),
    Plan("delta_aurc", "SELECT round(max(CASE WHEN model = 'm1' THEN a END) - max(CASE WHEN model = 'm0' THEN a END), 9) AS delta FROM (SELECT model, avg(1 - acc) AS a FROM {curve} GROUP BY model) AS x"),
    # decision rules
    Plan("budget_rule", "SELECT model, coalesce(min(CASE WHEN rate <= 0.2e0 THEN cap END), 4096) AS cap FROM (SELECT model, cap, avg(CASE WHEN finished_naturally AND gen_tokens <= cap THEN 0e0 ELSE 1e0 END) AS rate FROM {runs} CROSS JOIN (VALUES (256), (512), (1024), (2048)) AS c(cap) GROUP BY model, cap) AS x GROUP BY model"),
    Plan("stability_rule", "SELECT dataset, max(g) - min(g) <= 10 AND (min(g) >= 0 OR max(g) <= 0) AS stable FROM (SELECT dataset, category, 100 * (avg(CASE WHEN sb THEN 1e0 ELSE 0e0 END) - avg(CASE WHEN sa THEN 1e0 ELSE 0e0 END)) AS g FROM {pairs} GROUP BY dataset, category) AS x GROUP BY dataset"),
    Plan("deploy_rule", "SELECT CASE WHEN a.eligible AND NOT b.eligible THEN 'm0' WHEN b.eligible AND NOT a.eligible THEN 'm1' WHEN a.acc > b.acc + 0.05e0 THEN 'm0' WHEN b.acc > a.acc + 0.05e0 THEN 'm1' WHEN a.s <= b.s THEN 'm0' ELSE 'm1' END AS pick FROM {cells} AS a JOIN {cells} AS b ON a.model = 'm0' AND b.model = 'm1'"),
    Plan("trunc_sensitivity", f"SELECT model, round(avg({_SIG}), 9) AS primary_acc, round(avg(CASE WHEN NOT coalesce(truncated, false) THEN {_SIG} END), 9) AS answered_only FROM {{answerable}} GROUP BY model"),
    Plan("sweep_agreement", "SELECT round(avg(CASE WHEN a.pred = b.pred THEN 1e0 ELSE 0e0 END), 9) AS agreement, count(*) AS n FROM {runs} AS a JOIN {runs} AS b ON a.qid = b.qid AND a.model = 'm0' AND b.model = 'm1' WHERE a.finished_naturally AND a.gen_tokens <= 1024 AND a.pred IS NOT NULL AND b.pred IS NOT NULL"),
    # integrity gates: check, ok
    Plan("gate_dataset", "SELECT 'unique ids' AS check_name, count(*) = count(DISTINCT id) AS ok FROM {runs} UNION ALL SELECT 'valid answers', count_if(gold NOT IN ('A', 'B', 'C', 'D')) = 0 FROM {runs} UNION ALL SELECT 'disjoint splits', count(*) = 0 FROM (SELECT qid FROM {runs} GROUP BY qid HAVING count(DISTINCT split) > 1) AS x"),
    Plan("gate_corpus", "SELECT count(*) = count(DISTINCT doc_id) AS unique_ids, count_if(text IS NULL OR text = '') = 0 AS non_empty, count(*) >= 100 AS enough FROM {documents}"),
    Plan("gate_rerank", "SELECT count_if(score IS NULL OR isnan(score)) AS not_finite, count(*) - count(DISTINCT (qid, idx)) AS scored_twice FROM {ranked}", "SELECT count_if(score IS NULL OR isnan(score)) AS not_finite, count(*) - count(DISTINCT (qid, idx)) AS scored_twice FROM {ranked}"),
    Plan("verify_run", "SELECT model, count(*) = count(DISTINCT qid) AS one_per_question, avg(CASE WHEN coalesce(parsed, true) THEN 1e0 ELSE 0e0 END) >= 0.9e0 AS parses, count_if(correct) >= count_if(strict) AS consistent FROM {answers} GROUP BY model"),
    Plan("row_schema_gate", "SELECT count_if(id IS NULL) AS no_id, count_if(correct IS NULL) AS no_correct, count_if(strict IS NULL) AS no_strict FROM {answers}"),
    Plan("format_gate", "SELECT model, avg(CASE WHEN coalesce(parsed, true) THEN 1e0 ELSE 0e0 END) >= 0.95e0 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY md5(CAST(id AS STRING))) AS k FROM {runs}) AS x WHERE k <= 8 GROUP BY model"),
)
