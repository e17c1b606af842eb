"""Integrity gates over any tables: overlap of splits, frozen digests, tuned parameters, outputs, sweeps, tables and reports.

Each Plan takes its inputs by name; the views below derive them from the benchmark tables, with faults in some.
"""

from __future__ import annotations

from ..plans import views  # noqa: F401
from ..plans.core import Plan, collect, view

# questions of two sets, each with a test and a validation part
view("audit_parts", """
SELECT concat('base_', CASE WHEN p_partkey % 10 < 3 THEN 'val' ELSE 'test' END) AS part, concat('p', CAST(p_partkey AS STRING)) AS id, lower(p_name) AS question FROM {part}
UNION ALL
SELECT concat('extra_', CASE WHEN doc_id % 10 < 3 THEN 'val' ELSE 'test' END), concat('d', CAST(doc_id AS STRING)), md5(coalesce(text, '')) FROM {documents}""")
_IN = ", ".join(f"count_if(part = '{p}') AS {c}" for p, c in (("base_test", "bt"), ("base_val", "bv"), ("extra_test", "et"), ("extra_val", "ev")))
_CHECKS = {
    "base_test ids differ": ("id", "bt > 1"),
    "base_val ids differ": ("id", "bv > 1"),
    "extra_test ids differ": ("id", "et > 1"),
    "extra_val ids differ": ("id", "ev > 1"),
    "base ids of test and val": ("id", "bt > 0 AND bv > 0"),
    "base texts of test and val": ("text", "bt > 0 AND bv > 0"),
    "extra ids of test and val": ("id", "et > 0 AND ev > 0"),
    "extra texts of test and val": ("text", "et > 0 AND ev > 0"),
    "ids of base and extra": ("id", "bt + bv > 0 AND et + ev > 0"),
    "test texts of base and extra": ("text", "bt > 0 AND et > 0"),
}
_OVERLAP = f"""
SELECT c.check_name, count_if(CASE c.check_name {' '.join(f"WHEN '{n}' THEN k.side = '{side}' AND {cond}" for n, (side, cond) in _CHECKS.items())} END) AS faults,
  count_if(CASE c.check_name {' '.join(f"WHEN '{n}' THEN k.side = '{side}' AND {cond}" for n, (side, cond) in _CHECKS.items())} END) = 0 AS ok
FROM (
  SELECT 'id' AS side, bt, bv, et, ev FROM (SELECT id, {_IN} FROM {{audit_parts}} AS p GROUP BY id) AS x
  UNION ALL SELECT 'text', bt, bv, et, ev FROM (SELECT question, {_IN} FROM {{audit_parts}} AS p GROUP BY question) AS y) AS k
CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in _CHECKS)}) AS c(check_name)
GROUP BY c.check_name"""


def digest(rows: str, name: str, value: str, duck: bool) -> str:
    """SQL: (name, n, digest) of rows in any order. Each row's SHA-256 is cut into eight numbers, these are added up over all
    rows, and the sums are hashed: partial sums only, no group of rows comes together.
    """
    sha = f"sha256({value})" if duck else f"sha2({value}, 256)"
    part = (lambda k: f"CAST(('0x' || substr(h, {1 + 8 * k}, 8)) AS BIGINT)") if duck else (lambda k: f"CAST(conv(substr(h, {1 + 8 * k}, 8), 16, 10) AS BIGINT)")
    sums = ", '-', ".join(f"CAST(sum({part(k)}) % 9007199254740881 AS STRING)" for k in range(8))
    whole = f"concat(CAST(count(*) AS STRING), ':', {sums})"
    return f"SELECT {name}, count(*) AS n, {'sha256' if duck else 'sha2'}({whole}{'' if duck else ', 256'}) AS digest FROM (SELECT {name}, {sha} AS h FROM {rows} AS r0) AS r1 GROUP BY {name}"


# what was frozen, and what is there now: one passage changed, one table gone
view("frozen_rows", "SELECT 'benchmark' AS name, concat(CAST(item_id AS STRING), ' ', text) AS v FROM {benchmark} UNION ALL SELECT 'nation', n_name FROM {nation} UNION ALL SELECT 'region', r_name FROM {region}")
view("current_rows", "SELECT 'benchmark' AS name, concat(CAST(item_id AS STRING), ' ', CASE WHEN item_id = 3 THEN concat(text, '.') ELSE text END) AS v FROM {benchmark} UNION ALL SELECT 'nation', n_name FROM {nation}")


def _hashes(duck: bool) -> str:
    return f"""
SELECT f.name, coalesce(f.digest = c.digest AND f.n = c.n, false) AS ok
FROM ({digest('{frozen_rows}', 'name', 'v', duck)}) AS f LEFT JOIN ({digest('{current_rows}', 'name', 'v', duck)}) AS c ON f.name = c.name"""


# which questions each tuned parameter was fitted on; one was fitted on all
view("fit_log", """
SELECT DISTINCT 'tau' AS parameter, qid FROM {answers} WHERE split = 'validation'
UNION ALL SELECT DISTINCT 'delta', qid FROM {pairs} WHERE split = 'validation' UNION ALL SELECT DISTINCT 'leaky', qid FROM {pairs}""")
view("question_splits", "SELECT DISTINCT qid, split FROM {runs}")
# outputs of a model each with its own fault: rows missing, rows twice, other gold, none
view("expected_answers", "SELECT DISTINCT qid, gold FROM {runs} WHERE model = 'm0'")
view("model_outputs", """
SELECT model, qid, CASE WHEN model = 'm3' AND qid % 30 = 0 THEN 'E' ELSE gold END AS gold, category FROM {runs} WHERE NOT (model = 'm1' AND qid % 50 = 0)
UNION ALL SELECT model, qid, gold, category FROM {runs} WHERE model = 'm2' AND qid % 40 = 0
UNION ALL SELECT model, qid + 1000000000, gold, category FROM {runs} WHERE model = 'm4' AND qid % 60 = 0""")
# a report's lines, as text; the count of one model is wrong
view("report_lines", """
SELECT concat('| ', model, ' | ', CAST(n + CASE WHEN model = 'm4' THEN 1 ELSE 0 END AS STRING), ' | ', CAST(good AS STRING), ' |') AS line
FROM (SELECT model, count(*) AS n, count_if(strict) AS good FROM {answers} GROUP BY model) AS x""")
_ID_SUM = ("CAST(sum(xxhash64(qid) % 1000000007) AS BIGINT)", "CAST(sum(hash(qid) % 1000000007) AS BIGINT)")


def _sweeps(k: int) -> str:
    return f"""
SELECT o.model, o.n = e.n AS count_ok, o.ids = e.ids AND o.distinct_ids = e.n AS ids_ok, o.categories = e.categories AS rule_ok
FROM (SELECT model, count(*) AS n, count(DISTINCT qid) AS distinct_ids, {_ID_SUM[k]} AS ids, count(DISTINCT category) AS categories FROM {{model_outputs}} AS m GROUP BY model) AS o
CROSS JOIN (SELECT count(*) AS n, {_ID_SUM[k]} AS ids, max(c) AS categories FROM (SELECT DISTINCT qid FROM {{runs}} AS r) AS d CROSS JOIN (SELECT count(DISTINCT category) AS c FROM {{runs}} AS r) AS s) AS e"""


QUERIES = collect(
    Plan("audit_overlap", _OVERLAP),
    Plan("audit_hashes", _hashes(False), _hashes(True)),
    Plan(
        "audit_fit_split",
        """
SELECT l.parameter, count(*) AS n, count_if(coalesce(s.split, '') <> 'validation') AS outside, count_if(coalesce(s.split, '') <> 'validation') = 0 AS ok
FROM {fit_log} AS l LEFT JOIN {question_splits} AS s ON l.qid = s.qid GROUP BY l.parameter""",
    ),
    Plan(
        "audit_outputs",
        """
SELECT o.model, sum(o.n) AS n, count_if(o.n > 1) AS duplicates, max(e.n) - count_if(q.qid IS NOT NULL) AS missing, count_if(q.qid IS NULL) AS unexpected,
  count_if(o.gold <> q.gold) AS misaligned,
  count_if(o.n > 1) = 0 AND max(e.n) = count_if(q.qid IS NOT NULL) AND count_if(q.qid IS NULL) = 0 AND count_if(o.gold <> q.gold) = 0 AS ok
FROM (SELECT model, qid, min(gold) AS gold, count(*) AS n FROM {model_outputs} AS m GROUP BY model, qid) AS o
LEFT JOIN {expected_answers} AS q ON o.qid = q.qid CROSS JOIN (SELECT count(*) AS n FROM {expected_answers} AS a) AS e
GROUP BY o.model""",
    ),
    Plan("audit_sweeps", _sweeps(0), _sweeps(1)),
    Plan(
        "cross_check",
        """
SELECT t.model, t.n, t.good, r.n AS said_n, r.good AS said_good, coalesce(t.n = r.n AND t.good = r.good, false) AS ok
FROM (SELECT model, count(*) AS n, count_if(strict) AS good FROM {answers} GROUP BY model) AS t
LEFT JOIN (
  SELECT regexp_extract(line, '[|] ([a-z0-9]+) [|]', 1) AS model, CAST(regexp_extract(line, '[|] ([0-9]+) [|] [0-9]+ [|]', 1) AS BIGINT) AS n,
    CAST(regexp_extract(line, '[|] [0-9]+ [|] ([0-9]+) [|]', 1) AS BIGINT) AS good
  FROM {report_lines} AS l) AS r ON t.model = r.model""",
    ),
    # every question has exactly five candidates, none twice
    Plan(
        "gate_retrieval",
        """
SELECT count(*) AS queries, count_if(n <> d) AS with_duplicates, count_if(n < 1) AS empty, count_if(n <> 5) AS not_five, count_if(n <> d OR n <> 5) = 0 AS ok
FROM (SELECT qid, count(*) AS n, count(DISTINCT idx) AS d FROM {ranked} GROUP BY qid) AS x""",
    ),
)
