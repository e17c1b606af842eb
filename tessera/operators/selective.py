"""Abstention thresholds by exact sweeps, grounding by citations, reliability features, and tests with their intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import responses as R
from ..plans import views  # noqa: F401
from ..plans.core import Plan, collect, derived, view
from . import orders, questions  # noqa: F401
from .ranks import running


def erfc(x: str) -> str:
    """SQL for the complementary error function of x >= 0: a rational approximation with a relative error below 1.2e-7."""
    t = f"(1 / (1 + ({x}) / 2e0))"
    series = "-1.26551223e0"
    terms = (1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)  # fixed values of the approximation
    inner = "0e0"
    for c in reversed(terms):
        inner = f"{t} * ({c!r}e0 + {inner})" if inner != "0e0" else f"{t} * {c!r}e0"
    return f"({t} * exp(-({x}) * ({x}) {series} + {inner}))"


def wilson(k: str, n: str, end: str, z: str = "1.96e0") -> str:
    """SQL for one end (- or +) of the Wilson interval of k in n; null where n is 0."""
    p = f"(({k}) * 1e0 / nullif({n}, 0))"
    inner = f"{p} + {z} * {z} / (2 * nullif({n}, 0)) {end} {z} * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {z} * {z} / (4e0 * nullif({n}, 0) * {n}))"
    return f"least(1e0, greatest(0e0, ({inner}) / (1 + {z} * {z} / nullif({n}, 0))))"


def score_sweep(scored: DataFrame) -> DataFrame:
    """What is abstained from at each threshold: rows whose score is the threshold or more. scored: which (name of the score),
    split, model, score, should_abstain, correct. Counted by distinct score, then added up from the top by ranges.
    """
    by = ["which", "split", "model"]
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    each = scored.groupBy(*by, F.col("score").alias("tau")).agg(n("should_abstain", "u"), n("NOT should_abstain", "a"), n("NOT should_abstain AND correct", "good"))
    all_of = each.groupBy(*by).agg(F.sum("u").alias("all_u"), F.sum("a").alias("all_a"), F.sum("good").alias("all_good"))
    return running(each, by, [F.desc("tau")], ["u", "a", "good"]).join(all_of, by).select(*by, "tau", F.col("upto_u").alias("tp"), F.col("upto_a").alias("fp"), F.col("upto_good").alias("good"), "all_u", "all_a", "all_good")


view("scored", """
SELECT 'confidence' AS which, split, model, 1 - confidence AS score, should_abstain, correct FROM {answers}
UNION ALL SELECT 'rerank', split, model, 1 - top_rerank_score, should_abstain, correct FROM {answers} WHERE top_rerank_score IS NOT NULL""")
_SUM = "CAST(sum({c}) OVER (PARTITION BY which, split, model ORDER BY tau DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {n}"
_ALL = "CAST(sum({c}) OVER (PARTITION BY which, split, model) AS BIGINT) AS all_{c}"
derived(
    "sweep",
    ("scored",),
    score_sweep,
    f"""
SELECT which, split, model, tau, {_SUM.format(c='u', n='tp')}, {_SUM.format(c='a', n='fp')}, {_SUM.format(c='good', n='good')},
  {_ALL.format(c='u')}, {_ALL.format(c='a')}, {_ALL.format(c='good')}
FROM (
  SELECT which, split, model, score AS tau, count_if(should_abstain) AS u, count_if(NOT should_abstain) AS a, count_if(NOT should_abstain AND correct) AS good
  FROM {{scored}} AS s GROUP BY which, split, model, score) AS c""",
)
# with the threshold that nothing reaches
view("sweep_open", """
SELECT which, split, model, tau, (all_a - fp) * 1e0 / nullif(all_a, 0) AS coverage, (all_good - good) * 1e0 / nullif(all_a - fp, 0) AS acc FROM {sweep} AS s
UNION ALL
SELECT which, split, model, CAST('Infinity' AS DOUBLE), CASE WHEN max(all_a) > 0 THEN 1e0 END, max(all_good) * 1e0 / nullif(max(all_a), 0) FROM {sweep} AS s GROUP BY which, split, model""")

# passages of a question with their texts; an option's text is "grade" and its letter
view("passages", """
SELECT l_orderkey AS qid, CAST(l_linenumber AS BIGINT) AS rank, concat('grade ', substr('ABCD', CAST(l_partkey % 4 AS INT) + 1, 1), ', line ', l_linestatus) AS text,
  l_extendedprice / 110000e0 AS entailed
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS copy FROM {lineitem}) AS x
WHERE copy = 1 AND l_linenumber <= 5""")


def cited(answers: DataFrame, raw: DataFrame) -> DataFrame:
    """Answers with the passages that their outputs cite."""
    return answers.join(raw.select("id", R.parse_citations(F.col("said"), 5).alias("cites")), "id")


derived(
    "cited",
    ("answers", "raw_answers"),
    cited,
    """
SELECT a.*, list_filter(list_distinct(list_transform(regexp_extract_all(CASE WHEN regexp_matches(said, '\\[[^\\]]*[0-9]')
  THEN array_to_string(regexp_extract_all(said, '\\[([^\\]]+)\\]', 1), ' ') ELSE regexp_extract(said, '(?i)evidence\\s*:\\s*([^\\n]*)', 1) END, '[0-9]+'),
  lambda x: CAST(x AS BIGINT))), lambda c: c BETWEEN 1 AND 5) AS cites
FROM {answers} AS a JOIN {raw_answers} AS r ON a.id = r.id""",
)
# a row per answer: how many passages it cites, and which of them hold the chosen option, the right one
view("support", """
SELECT a.model, a.id, a.qid, a.dataset, a.split, a.strict, a.confidence, count_if(array_contains(a.cites, p.rank)) AS cited,
  count_if(array_contains(a.cites, p.rank) AND coalesce(contains(p.text, concat('grade ', a.pred, ',')), false)) AS matching,
  count_if(coalesce(contains(p.text, concat('grade ', a.pred, ',')), false)) AS held,
  count_if(contains(p.text, concat('grade ', a.gold, ','))) AS gold_there,
  count_if(contains(p.text, concat('grade ', a.gold, ',')) AND array_contains(a.cites, p.rank)) AS gold_cited,
  count_if(array_contains(a.cites, p.rank) AND p.entailed >= 0.5e0) AS entailed_cited, count_if(p.entailed >= 0.5e0) AS entailed_there
FROM {cited} AS a JOIN {passages} AS p ON a.qid = p.qid WHERE NOT a.should_abstain
GROUP BY a.model, a.id, a.qid, a.dataset, a.split, a.strict, a.confidence""")
# five runs of a question as five samples
view("samples", """
SELECT qid, split, should_abstain, max(n) * 1e0 / sum(n) AS agreement, max_by(answer, n * 10 - CASE WHEN answer = 'ABSTAIN' THEN 0.9e0 ELSE ascii(answer) / 100e0 END) AS majority,
  max(CASE WHEN cut > 0 THEN 1 ELSE 0 END) AS any_cut, max(CASE WHEN answer = 'ABSTAIN' THEN 1 ELSE 0 END) AS any_unsure,
  sum(cut) * 1e0 / sum(n) AS cut_rate, sum(CASE WHEN answer = 'ABSTAIN' THEN n ELSE 0 END) * 1e0 / sum(n) AS unsure_rate
FROM (SELECT qid, split, should_abstain, coalesce(pred, 'ABSTAIN') AS answer, count(*) AS n, count_if(coalesce(truncated, false)) AS cut FROM {runs} GROUP BY qid, split, should_abstain, coalesce(pred, 'ABSTAIN')) AS x
GROUP BY qid, split, should_abstain""")
view("coarse", "SELECT model, strict, CASE WHEN model = 'm0' THEN round(confidence * 4, 0) / 4 ELSE confidence END AS confidence FROM {answerable}")
view("agreement_tau", "SELECT CAST(x AS DOUBLE) AS tau FROM (VALUES (0.2e0), (0.4e0), (0.6e0), (0.8e0), (1e0)) AS t(x)")
view("judged", "SELECT count_if(quality = 1 AND toxic = 0) AS tp, count_if(quality = 0 AND toxic = 0) AS fp, count_if(quality = 1 AND toxic = 1) AS fn, count_if(quality = 0 AND toxic = 1) AS tn FROM {labels}")
view("used_strata", """
SELECT a, b, c, d, a + b + c + d AS n FROM (
  SELECT dataset, category, count_if(sb) * 1e0 AS a, count_if(NOT sb) * 1e0 AS b, count_if(sa) * 1e0 AS c, count_if(NOT sa) * 1e0 AS d
  FROM {pairs} WHERE NOT should_abstain GROUP BY dataset, category) AS x
WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0 AND a + b + c + d > 1""")

_SORTED = ("sort_array(array(a, b, c, d), false)", "list_reverse_sort([a, b, c, d])")
_STATS = """
SELECT id, round(s[0], 9) AS top1, round(s[0] - s[1], 9) AS margin,
  round(-(CASE WHEN a > 0 THEN a * ln(a) ELSE 0e0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0e0 END + CASE WHEN c > 0 THEN c * ln(c) ELSE 0e0 END + CASE WHEN d > 0 THEN d * ln(d) ELSE 0e0 END) / ln(4e0), 9) AS entropy
FROM (SELECT *, SORTED AS s FROM {probs}) AS p"""
_STATS_SPARK = _STATS.replace("SORTED", _SORTED[0])
_STATS_DUCK = _STATS.replace("SORTED", _SORTED[1]).replace("s[1]", "s[2]").replace("s[0]", "s[1]")
view("stats_of_options", _STATS_SPARK, _STATS_DUCK)
_Z = "(abs(wp - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0))"
_CMH = "abs(sum(a) - sum((a + b) * (a + c) / n))"
_VAR = "sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)))"

QUERIES = collect(
    # least threshold with the greatest coverage among those that reach the target and cover half; else the most accurate
    Plan(
        "tune_tau_safe",
        """
SELECT model, tau
FROM (
  SELECT model, tau, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN acc >= 0.3e0 THEN 0 ELSE 1 END,
    CASE WHEN acc >= 0.3e0 THEN coverage ELSE acc END DESC, CASE WHEN acc >= 0.3e0 THEN acc ELSE coverage END DESC, tau) AS r
  FROM {sweep_open} AS s WHERE which = 'confidence' AND split = 'validation' AND coverage >= 0.5e0) AS x
WHERE r = 1""",
    ),
    Plan(
        "far_budget_table",
        """
SELECT which, model, budget, round(max(tp * 1e0 / nullif(all_u, 0)), 9) AS recall
FROM {sweep} AS s JOIN (VALUES (0.01e0), (0.02e0), (0.05e0), (0.1e0), (0.15e0)) AS b(budget) ON fp * 1e0 / nullif(all_a, 0) <= budget
WHERE split = 'validation' GROUP BY which, model, budget""",
    ),
    Plan(
        "cwa_rate",
        f"""
SELECT model, n, round(k90 * 1e0 / nullif(n, 0), 9) AS at90, round({wilson('k90', 'n', '-')}, 9) AS at90_lo, round({wilson('k90', 'n', '+')}, 9) AS at90_hi,
  round(k80 * 1e0 / nullif(n, 0), 9) AS at80, round({wilson('k80', 'n', '-')}, 9) AS at80_lo, round({wilson('k80', 'n', '+')}, 9) AS at80_hi
FROM (SELECT model, count(*) AS n, count_if(confidence >= 0.9e0) AS k90, count_if(confidence >= 0.8e0) AS k80 FROM {{answers}} WHERE NOT strict GROUP BY model) AS x""",
    ),
    # the values themselves as bins if there are five at most; else five of equal width
    Plan(
        "ece_bins",
        """
SELECT model, bin, n, round(conf, 9) AS conf, round(acc, 9) AS acc, round(abs(acc - conf), 9) AS error
FROM (
  SELECT a.model, CASE WHEN v.levels <= 5 THEN a.confidence ELSE least(4e0, floor(a.confidence * 5)) / 5 END AS bin, count(*) AS n,
    avg(a.confidence) AS conf, avg(CASE WHEN a.strict THEN 1e0 ELSE 0e0 END) AS acc
  FROM {coarse} AS a JOIN (SELECT model, count(DISTINCT confidence) AS levels FROM {coarse} AS c GROUP BY model) AS v ON a.model = v.model
  GROUP BY a.model, CASE WHEN v.levels <= 5 THEN a.confidence ELSE least(4e0, floor(a.confidence * 5)) / 5 END) AS b""",
    ),
    Plan(
        "ece_discrete",
        """
SELECT model, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece
FROM (
  SELECT a.model, CASE WHEN v.levels <= 5 THEN a.confidence ELSE least(4e0, floor(a.confidence * 5)) / 5 END AS bin, count(*) AS n,
    avg(a.confidence) AS conf, avg(CASE WHEN a.strict THEN 1e0 ELSE 0e0 END) AS acc
  FROM {coarse} AS a JOIN (SELECT model, count(DISTINCT confidence) AS levels FROM {coarse} AS c GROUP BY model) AS v ON a.model = v.model
  GROUP BY a.model, CASE WHEN v.levels <= 5 THEN a.confidence ELSE least(4e0, floor(a.confidence * 5)) / 5 END) AS b
GROUP BY model""",
    ),
    Plan(
        "sc_rules_sweep",
        """
SELECT rule, tau, count_if(should_abstain AND hit) AS tp, count_if(NOT should_abstain AND hit) AS fp, count_if(should_abstain AND NOT hit) AS fn, count_if(NOT should_abstain AND NOT hit) AS tn
FROM (
  SELECT r.rule, t.tau, s.should_abstain, s.agreement < t.tau OR CASE r.rule WHEN 'current' THEN any_cut = 1 OR any_unsure = 1
    WHEN 'fraction' THEN cut_rate >= 0.6e0 OR unsure_rate >= 0.6e0 ELSE majority = 'ABSTAIN' END AS hit
  FROM {samples} AS s CROSS JOIN {agreement_tau} AS t CROSS JOIN (VALUES ('current'), ('fraction'), ('agreement_only')) AS r(rule)) AS x
GROUP BY rule, tau""",
    ),
    # option probabilities
    Plan("option_stats", "SELECT id, top1, margin, entropy FROM {stats_of_options}"),
    Plan(
        "reliability_features",
        """
SELECT r.id, CASE WHEN coalesce(r.truncated, false) THEN 1 ELSE 0 END AS truncated, round(least(1e0, coalesce(r.gen_tokens, 0) / 1024e0), 9) AS token_frac,
  coalesce(s.top1, 0e0) AS confidence, coalesce(s.margin, 0e0) AS margin, coalesce(s.entropy, 1e0) AS entropy, coalesce(r.top_rerank_score, 0e0) AS top_rerank
FROM {runs} AS r LEFT JOIN {stats_of_options} AS s ON r.id = s.id""",
    ),
    Plan(
        "scaled_gold",
        """
SELECT id, round(greatest(a, b, c, d) / (a + b + c + d), 9) AS confidence,
  round(coalesce(CASE gold WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d END / (a + b + c + d), 1e-12), 12) AS gold_p
FROM (
  SELECT id, gold, power(greatest(a, 1e-12), 1 / 1.5e0) AS a, power(greatest(b, 1e-12), 1 / 1.5e0) AS b, power(greatest(c, 1e-12), 1 / 1.5e0) AS c, power(greatest(d, 1e-12), 1 / 1.5e0) AS d
  FROM {probs}) AS p""",
    ),
    # grounding
    Plan(
        "confident_errors",
        """
SELECT model, count_if(NOT strict AND confidence >= 0.9e0) AS n, round(count_if(NOT strict AND confidence >= 0.9e0) * 1e0 / count(*), 9) AS of_all,
  round(count_if(NOT strict AND confidence >= 0.9e0) * 1e0 / nullif(count_if(NOT strict), 0), 9) AS of_wrong
FROM {answerable} GROUP BY model""",
    ),
    Plan(
        "cited_support",
        """
SELECT model, strict, count(*) AS n, count_if(matching > 0) AS cited_support, count_if(held > 0) AS evidence_support,
  round(count_if(matching > 0) * 1e0 / count(*), 9) AS cited_rate, round(count_if(held > 0) * 1e0 / count(*), 9) AS evidence_rate
FROM {support} AS s GROUP BY model, strict""",
    ),
    Plan(
        "citation_prf",
        """
SELECT model, count(*) AS n, count_if(matching > 0) AS faithful, round(count_if(matching > 0) * 1e0 / count(*), 9) AS faithfulness,
  round(coalesce(sum(matching) * 1e0 / nullif(sum(cited), 0), 0e0), 9) AS precision, round(coalesce(sum(gold_cited) * 1e0 / nullif(sum(gold_there), 0), 0e0), 9) AS recall
FROM {support} AS s GROUP BY model""",
    ),
    Plan(
        "rag_did",
        """
SELECT dataset, n_in, n_not, round(gain_in, 9) AS gain_in, round(gain_not, 9) AS gain_not, round(gain_in - gain_not, 9) AS did
FROM (
  SELECT p.dataset, count_if(g.there) AS n_in, count_if(NOT g.there) AS n_not,
    avg(CASE WHEN g.there THEN (CASE WHEN p.sb THEN 1e0 ELSE 0e0 END) - (CASE WHEN p.sa THEN 1e0 ELSE 0e0 END) END) AS gain_in,
    avg(CASE WHEN NOT g.there THEN (CASE WHEN p.sb THEN 1e0 ELSE 0e0 END) - (CASE WHEN p.sa THEN 1e0 ELSE 0e0 END) END) AS gain_not
  FROM {pairs} AS p JOIN (SELECT qid, max(gold_there) > 0 AS there FROM {support} AS s GROUP BY qid) AS g ON p.qid = g.qid
  GROUP BY p.dataset) AS x""",
    ),
    # the rate corrected by the judge's own precision and false negative rate, and the ends of its interval by theirs
    Plan(
        "nli_citation_metrics",
        f"""
SELECT model, pairs, round(rate, 9) AS pair_rate, round(rate * prec + (1 - rate) * fnr, 9) AS corrected, round(rate * prec_lo + (1 - rate) * fnr_lo, 9) AS corrected_lo,
  round(rate * prec_hi + (1 - rate) * fnr_hi, 9) AS corrected_hi, round(answer_rate, 9) AS answer_rate, round(recall, 9) AS recall
FROM (
  SELECT model, CAST(sum(cited) AS BIGINT) AS pairs, coalesce(sum(entailed_cited) * 1e0 / nullif(sum(cited), 0), 0e0) AS rate, avg(CASE WHEN entailed_cited > 0 THEN 1e0 ELSE 0e0 END) AS answer_rate,
    coalesce(count_if(entailed_cited > 0 AND entailed_there > 0) * 1e0 / nullif(count_if(entailed_there > 0), 0), 0e0) AS recall
  FROM {{support}} AS s GROUP BY model) AS m
CROSS JOIN (
  SELECT tp * 1e0 / nullif(tp + fp, 0) AS prec, {wilson('tp', '(tp + fp)', '-')} AS prec_lo, {wilson('tp', '(tp + fp)', '+')} AS prec_hi,
    fn * 1e0 / nullif(fn + tn, 0) AS fnr, {wilson('fn', '(fn + tn)', '-')} AS fnr_lo, {wilson('fn', '(fn + tn)', '+')} AS fnr_hi
  FROM {{judged}} AS j) AS e""",
    ),
    Plan(
        "cohen_kappa",
        """
SELECT tp, fp, fn, tn, round(prec, 9) AS precision, round(npv, 9) AS npv, round((po - pe) / nullif(1 - pe, 0), 9) AS kappa, round(w * prec + (1 - w) * npv, 9) AS weighted_accuracy
FROM (
  SELECT *, tp * 1e0 / nullif(tp + fp, 0) AS prec, tn * 1e0 / nullif(fn + tn, 0) AS npv, (tp + tn) * 1e0 / (tp + fp + fn + tn) AS po,
    ((tp + fp) * 1e0 * (tp + fn) + (fn + tn) * 1e0 * (fp + tn)) / ((tp + fp + fn + tn) * 1e0 * (tp + fp + fn + tn)) AS pe
  FROM {judged} AS j) AS x CROSS JOIN (SELECT avg(CASE WHEN entailed >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS w FROM {passages} AS p) AS s""",
    ),
    # tests: the interval of the common odds ratio by Robins, Breslow and Greenland
    Plan(
        "cmh",
        f"""
SELECT round(odds, 9) AS odds, round(exp(ln(odds) - 1.96e0 * se), 9) AS lo, round(exp(ln(odds) + 1.96e0 * se), 9) AS hi, round(raw, 9) AS chi2_raw, round(cc, 9) AS chi2,
  round({erfc('sqrt(raw / 2)')}, 6) AS p_raw, round({erfc('sqrt(cc / 2)')}, 6) AS p
FROM (
  SELECT sum(r) / nullif(sum(s), 0) AS odds, CASE WHEN sum(r) > 0 AND sum(s) > 0 THEN sqrt(sum(p * r) / (2 * sum(r) * sum(r)) + sum(p * s + q * r) / (2 * sum(r) * sum(s)) + sum(q * s) / (2 * sum(s) * sum(s))) END AS se,
    coalesce(power({_CMH}, 2) / nullif({_VAR}, 0), 0e0) AS raw, coalesce(power(greatest(0e0, {_CMH} - 0.5e0), 2) / nullif({_VAR}, 0), 0e0) AS cc
  FROM (SELECT *, a * d / n AS r, b * c / n AS s, (a + d) / n AS p, (b + c) / n AS q FROM {{used_strata}} AS u) AS x) AS y""",
    ),
    # under five differences: the exact sign test
    Plan(
        "wilcoxon",
        f"""
SELECT dataset, n, round(wp, 9) AS w, CASE WHEN n < 5 THEN least(1e0, 2 * CASE WHEN least(up, n - up) = 0 THEN 1e0 WHEN least(up, n - up) = 1 THEN 1e0 + n ELSE power(2e0, n) END / power(2e0, n))
  ELSE round(least(1e0, {erfc(f'{_Z} / sqrt(2e0)')}), 6) END AS p
FROM (SELECT dataset, count(*) AS n, count_if(d > 0) AS up, sum(CASE WHEN d > 0 THEN r ELSE 0e0 END) AS wp FROM {{signed_ranks}} AS s GROUP BY dataset) AS x""",
    ),
)
