"""Derived inputs: model runs, question sets, rank lists and documents, from the benchmark tables by arithmetic alone."""

from .core import view

view("runs", """
SELECT event_id AS id, qid, concat('m', CAST(event_id % 5 AS STRING)) AS model, dataset,
  CASE WHEN qid % 10 < 3 THEN 'validation' ELSE 'test' END AS split, dataset = 'unanswerable' AS should_abstain,
  CASE WHEN dataset = 'unanswerable' THEN NULL ELSE substr('ABCD', CAST(qid % 4 AS INT) + 1, 1) END AS gold,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE substr('ABCD', CAST((event_id * 7 + CAST(floor(v) AS BIGINT)) % 4 AS INT) + 1, 1) END AS pred,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 17 <> 0 END AS parsed,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id % 11 = 0 END AS truncated,
  event_id % 11 <> 0 AS finished_naturally, event_id % 2048 AS gen_tokens, v / (v + 10e0) AS confidence, v / 10e0 + 0.1e0 AS seconds,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 97) / 97e0 END AS top_rerank_score,
  substr('abcdef', CAST(qid % 6 AS INT) + 1, 1) AS category, qid % 9 = 2 AS control
FROM (SELECT *, CASE WHEN qid % 3 = 0 THEN 'medqa' WHEN qid % 3 = 1 THEN 'pubmedqa' ELSE 'unanswerable' END AS dataset
  FROM (SELECT event_id, CAST(floor(event_id / 5) AS BIGINT) AS qid, abs(value) AS v FROM {events}) AS e) AS d""")
view("answers", """
SELECT *, coalesce(pred = gold, false) AS correct,
  NOT coalesce(truncated, false) AND coalesce(parsed, true) AND coalesce(pred = gold, false) AS strict FROM {runs}""")
view("answerable", "SELECT * FROM {answers} WHERE NOT should_abstain")
view("pairs", """
SELECT a.qid, a.dataset, a.split, a.category, a.control, a.model AS model_a, b.model AS model_b, a.strict AS sa, b.strict AS sb,
  a.confidence AS ca, b.confidence AS cb, a.seconds AS ta, b.seconds AS tb, b.top_rerank_score AS rerank, a.should_abstain
FROM {answers} AS a JOIN {answers} AS b ON a.qid = b.qid AND a.model = 'm0' AND b.model = 'm1'""")
view("ranked", """
SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS dense_rank,
  row_number() OVER (PARTITION BY qid ORDER BY other DESC, idx) AS bm25_rank, relevant
FROM (SELECT l_orderkey AS qid, CAST(l_linenumber AS BIGINT) AS idx, l_extendedprice AS score, l_quantity AS other,
  l_returnflag = 'R' AS relevant, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM {lineitem}) AS x WHERE k = 1""")
view("binary", """
SELECT a.id, a.model, a.confidence AS score, a.strict AS good, a.dataset, a.split FROM {answerable} AS a""")
view("thresholds", "SELECT CAST(k AS INT) AS k, k / 50e0 AS tau FROM (SELECT explode(sequence(5, 49)) AS k) AS s", "SELECT CAST(k AS INT) AS k, k / 50e0 AS tau FROM (SELECT unnest(generate_series(5, 49)) AS k) AS s")
