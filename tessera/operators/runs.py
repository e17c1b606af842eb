"""Projections, joins and aggregates over model runs."""

from ..plans import views  # noqa: F401
from ..plans.core import Plan, collect
from . import orders  # noqa: F401

_W = lambda k, n: f"""round(({k} / {n} + 3.8416e0 / (2 * {n}) - 1.96e0 * sqrt(({k} / {n} * (1 - {k} / {n}) + 3.8416e0 / (4 * {n})) / {n})) / (1 + 3.8416e0 / {n}), 9) AS lo,
  round(({k} / {n} + 3.8416e0 / (2 * {n}) + 1.96e0 * sqrt(({k} / {n} * (1 - {k} / {n}) + 3.8416e0 / (4 * {n})) / {n})) / (1 + 3.8416e0 / {n}), 9) AS hi"""  # noqa: E731
_F1 = """round(coalesce(tp * 1e0 / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp * 1e0 / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"""

QUERIES = collect(
    # projections and filters
    Plan("strict_correct", "SELECT id, correct, strict, coalesce(correct, false) AS fallback, coalesce(truncated, false) AS is_truncated, coalesce(parsed, true) AS is_parsed FROM {answers}"),
    Plan("strict_at_cap", "SELECT cap, model, count_if(finished_naturally AND gen_tokens <= cap AND correct) AS strict, count_if(NOT (finished_naturally AND gen_tokens <= cap)) AS truncated FROM {answerable} CROSS JOIN (VALUES (256), (512), (1024), (2048)) AS c(cap) GROUP BY cap, model"),
    Plan("confidence", "SELECT id, coalesce(top_rerank_score, 0e0) AS default_zero, coalesce(top_rerank_score, 0.5e0) AS default_half FROM {runs}"),
    Plan("pred_source", "SELECT id, CASE WHEN coalesce(parsed, true) AND pred IS NOT NULL THEN 'parsed' WHEN pred IS NOT NULL THEN 'logprob' ELSE 'none' END AS pred_source FROM {runs}"),
    Plan("dataset_filter", "SELECT id, dataset FROM {runs} WHERE split = 'test' AND (dataset = 'medqa' OR should_abstain)"),
    Plan("condition_questions", "SELECT DISTINCT qid, CASE WHEN dataset = 'medqa' THEN 'C1' WHEN dataset = 'pubmedqa' THEN 'C3' ELSE 'C4' END AS condition FROM {runs} WHERE split = 'test'"),
    Plan("recode_label", "SELECT doc_id, CASE quality WHEN 1 THEN 'A' WHEN 0 THEN 'B' ELSE 'C' END AS answer FROM {labels}"),
    Plan("risk_label", "SELECT id, should_abstain OR NOT correct AS risk FROM {answers}"),
    Plan("abstain_unified", "SELECT id, NOT coalesce(parsed, true) OR coalesce(truncated, false) OR pred IS NULL OR confidence < 0.5e0 AS abstains FROM {runs}"),
    Plan("runtime_abstain", "SELECT r.id, coalesce(r.truncated, false) OR coalesce(r.top_rerank_score < t.p20, false) AS abstains FROM {runs} AS r CROSS JOIN (SELECT percentile_cont(0.2) WITHIN GROUP (ORDER BY top_rerank_score) AS p20 FROM {runs} WHERE split = 'validation') AS t WHERE r.split = 'test'"),
    # joins
    Plan("paired_runs", "SELECT qid, model_a, model_b, sa, sb FROM {pairs}"),
    Plan("paired_runs_4way", "SELECT qid, count(*) AS n, count_if(strict) AS n_strict FROM {answers} WHERE model <> 'm4' GROUP BY qid HAVING count(DISTINCT model) = 4"),
    Plan("candidate_chunks", "SELECT r.qid, r.idx, r.dense_rank, o.o_orderpriority AS title FROM {ranked} AS r JOIN {orders} AS o ON r.qid = o.o_orderkey WHERE r.dense_rank <= 5"),
    Plan("run_evidence", "SELECT a.id, a.strict, e.relevant, e.score FROM {answers} AS a JOIN {ranked} AS e ON a.qid = e.qid AND e.dense_rank = 1"),
    Plan("leakage_antijoin", "SELECT DISTINCT a.qid FROM {runs} AS a WHERE NOT EXISTS (SELECT 1 FROM {ranked} AS b WHERE a.qid = b.qid)"),
    Plan("missing_unexpected_ids", "SELECT 'missing' AS side, o.o_orderkey AS id FROM {orders} AS o LEFT ANTI JOIN (SELECT DISTINCT l_orderkey AS qid FROM {lineitem}) AS r ON o.o_orderkey = r.qid UNION ALL SELECT 'unexpected', r.qid FROM (SELECT DISTINCT l_orderkey AS qid FROM {lineitem}) AS r LEFT ANTI JOIN {orders} AS o ON o.o_orderkey = r.qid", "SELECT 'missing' AS side, o.o_orderkey AS id FROM {orders} AS o WHERE o.o_orderkey NOT IN (SELECT qid FROM {ranked}) UNION ALL SELECT 'unexpected', r.qid FROM (SELECT DISTINCT qid FROM {ranked}) AS r WHERE r.qid NOT IN (SELECT o_orderkey FROM {orders})"),
    Plan("resume_todo", "SELECT DISTINCT r.qid FROM {runs} AS r LEFT ANTI JOIN {labels} AS l ON r.qid = l.doc_id", "SELECT DISTINCT r.qid FROM {runs} AS r WHERE NOT EXISTS (SELECT 1 FROM {labels} AS l WHERE r.qid = l.doc_id)"),
    Plan("gold_mismatch", "SELECT a.qid, a.pred AS a, b.pred AS b FROM {runs} AS a JOIN {runs} AS b ON a.qid = b.qid AND a.model = 'm0' AND b.model = 'm2' WHERE a.pred <> b.pred"),
    Plan("fabricated_pairs", "SELECT qid, max(CASE WHEN model = 'm0' THEN pred END) AS fake, max(CASE WHEN model = 'm1' THEN pred END) AS real FROM {runs} GROUP BY qid HAVING count(CASE WHEN model = 'm0' THEN 1 END) > 0 AND count(CASE WHEN model = 'm1' THEN 1 END) > 0"),
    Plan("greedy_fallback", "SELECT a.qid, coalesce(a.pred, b.pred) AS pred, CASE WHEN a.pred IS NOT NULL THEN 'own' WHEN b.pred IS NOT NULL THEN 'reference' ELSE 'none' END AS provenance FROM {runs} AS a LEFT JOIN {runs} AS b ON a.qid = b.qid AND b.model = 'm3' WHERE a.model = 'm0'"),
    Plan("variant_align", "SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS k FROM {runs} WHERE model IN ('m1', 'm2') AND qid IN (SELECT qid FROM {runs} WHERE split = 'validation')) AS x WHERE k = 1"),
    Plan("threshold_sweep", "SELECT model, k, count_if(confidence < tau) AS abstained, count_if(confidence >= tau AND strict) AS good FROM {answerable} CROSS JOIN {thresholds} AS t GROUP BY model, k"),
    Plan("first_by_priority", "SELECT qid, model, pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY model, id) AS k FROM {runs} WHERE pred IS NOT NULL) AS x WHERE k = 1"),
    Plan("shard_merge_report", "SELECT id % 4 AS shard, count(*) AS n, count(*) - count(DISTINCT id) AS duplicates FROM {runs} GROUP BY id % 4"),
    # aggregates
    Plan("docs_per_source", "SELECT source, count(*) AS n FROM {documents} GROUP BY source"),
    Plan("label_distribution", "SELECT split, dataset, gold, count(*) AS n FROM {runs} GROUP BY split, dataset, gold"),
    Plan("accuracy_by_model", "SELECT model, dataset, round(avg(CASE WHEN strict THEN 1e0 ELSE 0e0 END), 9) AS strict, round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END), 9) AS fallback, round(avg(CASE WHEN coalesce(parsed, true) THEN 1e0 ELSE 0e0 END), 9) AS parse_rate, round(avg(CASE WHEN coalesce(truncated, false) THEN 1e0 ELSE 0e0 END), 9) AS trunc_rate FROM {answerable} GROUP BY model, dataset"),
    Plan("run_summary", "SELECT model, coalesce(dataset, 'overall') AS dataset, count(*) AS n, count_if(correct) AS correct, count_if(coalesce(parsed, true)) AS parsed, round(avg(seconds), 9) AS mean_seconds FROM {answers} GROUP BY GROUPING SETS ((model, dataset), (model))"),
    Plan("stage_summary", "SELECT model, dataset, count_if(strict) AS strict, count_if(correct) AS fallback, count_if(coalesce(truncated, false)) AS trunc, round(avg(seconds), 9) AS s_per_q FROM {answers} WHERE NOT should_abstain OR control GROUP BY model, dataset"),
    Plan("model_cell", f"SELECT model, k, n, round(k / n, 9) AS rate, {_W('k', 'n')} FROM (SELECT model, count_if(strict) * 1e0 AS k, count(*) * 1e0 AS n FROM {{answerable}} GROUP BY model) AS x"),
    Plan("wilson", f"SELECT dataset, {_W('k', 'n')} FROM (SELECT dataset, count_if(correct) * 1e0 AS k, count(*) * 1e0 AS n FROM {{answerable}} GROUP BY dataset) AS x"),
    Plan("efficiency", "SELECT model, round(avg(seconds), 9) AS mean_s, round(median(seconds), 9) AS median_s, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY seconds), 9) AS p90_s, round(avg(gen_tokens), 9) AS mean_tokens, round(avg(gen_tokens) / avg(seconds), 9) AS tok_s, count_if(top_rerank_score IS NULL) AS excluded FROM {runs} GROUP BY model"),
    Plan("latency_p95", "SELECT model, round(seconds, 9) AS p95 FROM {by_seconds} WHERE k - 1 = CAST(floor(0.95e0 * n) AS BIGINT)"),
    Plan("throughput_sum", "SELECT model, round(sum(gen_tokens) / sum(seconds), 9) AS tok_s FROM {runs} GROUP BY model"),
    Plan("majority_vote", "SELECT qid, pred AS majority, votes / 5e0 AS agreement, distinct_answers FROM (SELECT qid, pred, votes, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, first_at) AS k, count(*) OVER (PARTITION BY qid) AS distinct_answers FROM (SELECT qid, pred, count(*) AS votes, min(id) AS first_at FROM {runs} WHERE pred IS NOT NULL GROUP BY qid, pred) AS v) AS x WHERE k = 1"),
    Plan("category_breakdown", "SELECT category, control, count(*) AS n, count_if(pred IS NULL) AS abstained FROM {runs} WHERE should_abstain GROUP BY category, control"),
    Plan("confusion_matrix", "SELECT gold, count_if(pred = 'A') AS a, count_if(pred = 'B') AS b, count_if(pred = 'C') AS c, count_if(pred = 'D') AS d FROM {answerable} GROUP BY gold"),
    Plan("prf_multiclass", f"SELECT label, {_F1} FROM (SELECT label, count_if(gold = label AND pred = label) AS tp, count_if(gold <> label AND pred = label) AS fp, count_if(gold = label AND (pred IS NULL OR pred <> label)) AS fn FROM {{answerable}} CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D')) AS l(label) GROUP BY label) AS x"),
    Plan("macro_f1", "SELECT model, round(avg(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS macro_f1 FROM (SELECT model, label, count_if(gold = label AND pred = label) AS tp, count_if(gold <> label AND pred = label) AS fp, count_if(gold = label AND (pred IS NULL OR pred <> label)) AS fn FROM {answerable} CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D')) AS l(label) GROUP BY model, label) AS x GROUP BY model"),
    Plan("rule_metrics", f"SELECT model, tp, fp, fn, tn, {_F1}, round(fp * 1e0 / nullif(fp + tn, 0), 9) AS far FROM (SELECT model, count_if(should_abstain AND confidence < 0.5e0) AS tp, count_if(NOT should_abstain AND confidence < 0.5e0) AS fp, count_if(should_abstain AND confidence >= 0.5e0) AS fn, count_if(NOT should_abstain AND confidence >= 0.5e0) AS tn FROM {{answers}} GROUP BY model) AS x"),
    Plan("safety_metrics", "SELECT model, round(avg(CASE WHEN should_abstain THEN NULL WHEN confidence >= 0.5e0 THEN 1e0 ELSE 0e0 END), 9) AS coverage, round(avg(CASE WHEN NOT should_abstain AND confidence >= 0.5e0 THEN CASE WHEN strict THEN 1e0 ELSE 0e0 END END), 9) AS accuracy, round(avg(CASE WHEN confidence >= 0.5e0 AND (should_abstain OR NOT strict) THEN 1e0 ELSE 0e0 END), 9) AS unsafe FROM {answers} GROUP BY model"),
    Plan("idk_pool_metrics", "SELECT split, count(*) AS n, count_if(pred IS NULL AND should_abstain) AS right_idk, count_if(pred IS NULL AND NOT should_abstain) AS wrong_idk, round(avg(CASE WHEN should_abstain THEN 1e0 ELSE 0e0 END), 9) AS always_abstain FROM {answers} GROUP BY split"),
    Plan("discordant_counts", "SELECT dataset, count_if(sa AND sb) AS a, count_if(sa AND NOT sb) AS b, count_if(NOT sa AND sb) AS c, count_if(NOT sa AND NOT sb) AS d FROM {pairs} GROUP BY dataset"),
    Plan("budget_hours", "SELECT model, round(avg(seconds) * count(*) / 3600, 9) AS hours FROM {runs} GROUP BY model"),
    Plan("duplicate_ids", "SELECT conv_id, count(*) AS n FROM {conversations} GROUP BY conv_id HAVING count(*) > 1"),
    Plan("schema_conformance", "SELECT split, count(*) AS n, count_if(gold IS NULL AND NOT should_abstain) AS no_gold, count_if(gold IS NOT NULL AND should_abstain) AS extra_gold, count_if(pred NOT IN ('A', 'B', 'C', 'D')) AS bad_pred FROM {runs} GROUP BY split"),
    # sets
    Plan("union_splits", "SELECT id, 'validation' AS split FROM {runs} WHERE split = 'validation' UNION ALL SELECT id, 'test' FROM {runs} WHERE split = 'test'"),
    Plan("split_intersection", "SELECT qid FROM {runs} WHERE model = 'm0' INTERSECT SELECT qid FROM {runs} WHERE model = 'm1' AND pred IS NOT NULL"),
    Plan("symmetric_diff", "(SELECT doc_id AS id FROM {documents} EXCEPT ALL SELECT doc_id FROM {labels}) UNION ALL (SELECT doc_id FROM {labels} EXCEPT ALL SELECT doc_id FROM {documents})"),
    # windows and ranks
    Plan("rrf_fusion", "SELECT qid, idx, round(rrf, 9) AS rrf, dense_rank, bm25_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, idx) AS k FROM (SELECT qid, idx, dense_rank, bm25_rank, 1e0 / (60 + dense_rank) + 1e0 / (60 + bm25_rank) AS rrf FROM {ranked}) AS f) AS x WHERE k <= 20"),
    Plan("rerank_topk", "SELECT qid, idx, k AS rank, bm25_rank AS rrf_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, bm25_rank) AS k FROM {ranked}) AS x WHERE k <= 5"),
    Plan("avg_rank", "SELECT id, avg_rank FROM {token_ranks}"),
    Plan("fixed_cov_tau", "SELECT model, confidence AS tau FROM {curve_validation} WHERE k = CAST(floor(0.8e0 * n) AS BIGINT)"),
    Plan("shard_assign", "SELECT id, (row_number() OVER (PARTITION BY model ORDER BY id) - 1) % 4 AS shard FROM {runs}"),
    Plan("batch_assign", "SELECT id, CAST(floor((row_number() OVER (PARTITION BY model ORDER BY gen_tokens DESC, id) - 1) / 32e0) AS BIGINT) AS batch FROM {runs}"),
    Plan("head_n", "SELECT id, model FROM {runs} ORDER BY id LIMIT 80"),
    Plan("ir_metrics", "SELECT count(*) AS n, round(avg(CASE WHEN first_hit <= 1 THEN 1e0 ELSE 0e0 END), 9) AS r1, round(avg(CASE WHEN first_hit <= 5 THEN 1e0 ELSE 0e0 END), 9) AS r5, round(avg(CASE WHEN first_hit <= 10 THEN 1e0 ELSE 0e0 END), 9) AS r10, round(avg(CASE WHEN first_hit <= 20 THEN 1e0 ELSE 0e0 END), 9) AS r20, round(avg(hits5 * 1e0 / least(5, n)), 9) AS p5, round(avg(CASE WHEN first_hit <= 10 THEN 1e0 / first_hit ELSE 0e0 END), 9) AS mrr10, round(avg(coalesce(ap / nullif(hits10, 0), 0)), 9) AS map10, round(avg(coalesce(dcg / nullif(idcg, 0), 0)), 9) AS ndcg10 FROM (SELECT qid, count(*) AS n, min(CASE WHEN relevant THEN r END) AS first_hit, count_if(relevant AND r <= 5) AS hits5, count_if(relevant AND r <= 10) AS hits10, sum(CASE WHEN relevant AND r <= 10 THEN seen * 1e0 / r ELSE 0e0 END) AS ap, sum(CASE WHEN relevant AND r <= 10 THEN 1 / log2(r + 1) ELSE 0e0 END) AS dcg, sum(CASE WHEN relevant AND r <= 10 THEN 1 / log2(seen + 1) ELSE 0e0 END) AS idcg FROM (SELECT qid, relevant, dense_rank AS r, sum(CASE WHEN relevant THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY dense_rank) AS seen FROM {ranked}) AS s GROUP BY qid) AS q"),
    Plan("split_sample", "SELECT qid FROM (SELECT qid, row_number() OVER (PARTITION BY dataset ORDER BY md5(concat('42-', CAST(qid AS STRING)))) AS k FROM (SELECT DISTINCT qid, dataset FROM {runs}) AS d) AS x WHERE k <= 50"),
    Plan("stratified_split", "SELECT qid, category, CASE WHEN k <= 33 THEN 'validation' ELSE 'test' END AS split FROM (SELECT qid, category, row_number() OVER (PARTITION BY category ORDER BY md5(concat('7-', CAST(qid AS STRING)))) AS k FROM (SELECT DISTINCT qid, category FROM {runs} WHERE should_abstain) AS d) AS x WHERE k <= 50"),
    Plan("pilot_sample", "SELECT qid, control FROM (SELECT qid, control, row_number() OVER (PARTITION BY control ORDER BY md5(concat('9-', CAST(qid AS STRING)))) AS k FROM (SELECT DISTINCT qid, control FROM {runs}) AS d) AS x WHERE k <= CASE WHEN control THEN 12 ELSE 28 END"),
)
