"""Operators that take functions: of columns to columns, so that what they compute stays inside Spark's plans."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import selective  # noqa: F401  (views)

Metric = Callable[[], Column]


def stratified(df: DataFrame, strata: Mapping[str, Callable[[], Column]], metrics: Mapping[str, Metric]) -> DataFrame:
    """(stratum, value, metrics): every metric (an aggregate) for every value of every stratum, and for all rows, in one pass."""
    pairs = F.array(F.struct(F.lit("all").alias("stratum"), F.lit("all").alias("value")), *[F.struct(F.lit(n).alias("stratum"), f().cast("string").alias("value")) for n, f in strata.items()])
    return df.withColumn("_s", F.explode(pairs)).groupBy(F.col("_s.stratum").alias("stratum"), F.col("_s.value").alias("value")).agg(*[m().alias(n) for n, m in metrics.items()])


def ranking_metrics(questions: DataFrame, passages: DataFrame, rank: Callable[[], Column], match: Callable[[], Column], k: int = 10, key: str = "qid") -> DataFrame:
    """(n, recall, mrr, hits): passages ordered by rank within a question and matched by match (a condition on both sides'
    columns); the share of questions with a match among the first k, the mean of one over the first match's place, and
    how many of the first k match on average.
    """
    w = Window.partitionBy(key).orderBy(rank())
    rows = questions.join(passages, key).withColumn("_hit", F.coalesce(match(), F.lit(False))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    each = rows.groupBy(key).agg(F.min(F.when(F.col("_hit"), F.col("_r"))).alias("first"), F.count_if("_hit").alias("hits"))
    all_of = questions.select(key).distinct().join(each, key, "left")
    return all_of.agg(F.count("*").alias("n"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 9).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr"), F.round(F.avg(F.coalesce("hits", F.lit(0))), 9).alias("hits"))


def abstaining(df: DataFrame, abstain: Callable[[], Column], should: Callable[[], Column], by: str) -> DataFrame:
    """(by, tp, fp, fn, tn) of any abstention rule; null counts as not abstaining."""
    a, s = F.coalesce(abstain(), F.lit(False)), F.coalesce(should(), F.lit(False))
    return df.groupBy(by).agg(F.count_if(a & s).alias("tp"), F.count_if(a & ~s).alias("fp"), F.count_if(~a & s).alias("fn"), F.count_if(~a & ~s).alias("tn"))


def _view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    from .questions import _view as view

    return view(spark, sf, name)


def stratified_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("strict").cast("double")
    return stratified(
        _view(spark, sf, "answerable"),
        {"model": lambda: F.col("model"), "surest": lambda: F.col("confidence") >= 0.8, "split": lambda: F.col("split")},
        {"n": lambda: F.count("*"), "accuracy": lambda: F.round(F.avg(good), 9), "mean_tokens": lambda: F.round(F.avg("gen_tokens"), 6)},
    )


def hooked_ranking(spark: SparkSession, sf: str) -> DataFrame:
    q = _view(spark, sf, "answers").where("model = 'm0' AND NOT should_abstain").select("qid", "gold")
    return ranking_metrics(q, _view(spark, sf, "passages"), lambda: F.struct(-F.col("entailed"), F.col("rank")), lambda: F.contains("text", F.concat(F.lit("grade "), F.col("gold"), F.lit(","))), 3)


def hooked_abstention(spark: SparkSession, sf: str) -> DataFrame:
    return abstaining(_view(spark, sf, "answers"), lambda: (F.col("confidence") < 0.4) | F.col("pred").isNull() | F.col("truncated"), lambda: F.col("should_abstain"), "model")


def _oracle(sql: str) -> str:
    from ..plans.core import Plan

    return Plan("", sql).oracle()


def oracles() -> dict[str, str]:
    part = lambda name, value: f"SELECT '{name}' AS stratum, {value} AS value, count(*) AS n, round(avg(CASE WHEN strict THEN 1e0 ELSE 0e0 END), 9) AS accuracy, round(avg(gen_tokens), 6) AS mean_tokens FROM {{answerable}} AS a GROUP BY {value}"
    return {
        "stratified_accuracy": _oracle(" UNION ALL ".join(part(n, v) for n, v in (("all", "'all'"), ("model", "model"), ("surest", "CASE WHEN confidence >= 0.8e0 THEN 'true' ELSE 'false' END"), ("split", "split")))),
        "hooked_ranking": _oracle(
            """
SELECT count(*) AS n, round(avg(CASE WHEN f IS NOT NULL THEN 1e0 ELSE 0e0 END), 9) AS recall, round(avg(coalesce(1e0 / f, 0e0)), 9) AS mrr, round(avg(coalesce(h, 0)), 9) AS hits
FROM (SELECT DISTINCT qid FROM {answers} WHERE model = 'm0' AND NOT should_abstain) AS q LEFT JOIN (
  SELECT qid, min(CASE WHEN hit THEN r END) AS f, count_if(hit) AS h FROM (
    SELECT a.qid, contains(p.text, concat('grade ', a.gold, ',')) AS hit, row_number() OVER (PARTITION BY a.qid ORDER BY p.entailed DESC, p.rank) AS r
    FROM {answers} AS a JOIN {passages} AS p ON a.qid = p.qid WHERE a.model = 'm0' AND NOT a.should_abstain) AS x WHERE r <= 3 GROUP BY qid) AS e ON q.qid = e.qid"""
        ),
        "hooked_abstention": _oracle(
            """
SELECT model, count_if(a AND s) AS tp, count_if(a AND NOT s) AS fp, count_if(NOT a AND s) AS fn, count_if(NOT a AND NOT s) AS tn
FROM (SELECT model, confidence < 0.4e0 OR pred IS NULL OR coalesce(truncated, false) AS a, should_abstain AS s FROM {answers}) AS x GROUP BY model"""
        ),
    }


def _queries():
    sql = oracles()
    return {n: (f, sql[n]) for n, f in (("stratified_accuracy", stratified_accuracy), ("hooked_ranking", hooked_ranking), ("hooked_abstention", hooked_abstention))}


QUERIES = _queries()
