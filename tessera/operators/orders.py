"""Inputs that are ordered by a score: risk curves, order statistics and average ranks, none of them by a window over a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.core import derived
from .ranks import average_ranks, running


def _numbered(rows: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """Rows with k (from 1), running sums and n, the rows of their model. Rows of a model are counted apart: a join of as
    many rows as there are models.
    """
    sizes = rows.groupBy(F.col("model").alias("_m")).agg(F.count("*").alias("n"))
    return running(rows, ["model"], order, sums).join(sizes, F.col("model").eqNullSafe(F.col("_m"))).drop("_m")


def risk_curve(answers: DataFrame) -> DataFrame:
    """(model, id, confidence, k, n, acc): acc is the share of strict answers among the k surest, ties by id."""
    rows = answers.select("model", "id", "confidence", F.col("strict").cast("int").alias("good"))
    return _numbered(rows, [F.desc("confidence"), F.col("id")], ["good"]).select("model", "id", "confidence", "k", "n", (F.col("upto_good") / F.col("k")).alias("acc"))


def risk_curve_of_all(answers: DataFrame) -> DataFrame:
    """(model, id, k, errors): to answer what should be left unanswered is an error."""
    rows = answers.select("model", "id", "confidence", (~(F.col("strict") & ~F.col("should_abstain"))).cast("int").alias("bad"))
    return running(rows, ["model"], [F.desc("confidence"), F.col("id")], ["bad"]).select("model", "id", "k", F.col("upto_bad").alias("errors"))


def by_seconds(runs: DataFrame) -> DataFrame:
    return _numbered(runs.select("model", "id", "seconds"), [F.col("seconds"), F.col("id")])


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """(dataset, d, r): differences of confidence that are not zero, with the average rank of their sizes."""
    rows = pairs.select("dataset", F.round(F.col("cb") - F.col("ca"), 9).alias("d")).where("d <> 0")
    return average_ranks(rows.withColumn("size", F.abs("d")), ["dataset"], "size", "r").drop("size")


def _curve(source: str, where: str = "true") -> str:
    good = "CASE WHEN strict THEN 1e0 ELSE 0e0 END"
    return f"""SELECT model, id, confidence, k, n, avg({good}) OVER (PARTITION BY model ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY confidence DESC, id) AS k, count(*) OVER (PARTITION BY model) AS n FROM {{{source}}} WHERE {where}) AS x"""


_AVERAGE = "rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2e0"

derived("curve", ("answerable",), risk_curve, _curve("answerable"))
derived("curve_validation", ("answerable",), lambda a: risk_curve(a.where("split = 'validation'")), _curve("answerable", "split = 'validation'"))
derived(
    "curve_all",
    ("answers",),
    risk_curve_of_all,
    """SELECT model, id, k, sum(CASE WHEN strict AND NOT should_abstain THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS errors
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY confidence DESC, id) AS k FROM {answers}) AS x""",
)
derived("by_seconds", ("runs",), by_seconds, "SELECT model, id, seconds, row_number() OVER (PARTITION BY model ORDER BY seconds, id) AS k, count(*) OVER (PARTITION BY model) AS n FROM {runs}")
derived("binary_ranks", ("binary",), lambda b: average_ranks(b, ["model"], "score", "r"), f"SELECT *, {_AVERAGE.format(g='model', v='score')} AS r FROM {{binary}}")
derived("token_ranks", ("runs",), lambda r: average_ranks(r.select("id", "model", "gen_tokens"), ["model"], "gen_tokens", "avg_rank"), f"SELECT id, {_AVERAGE.format(g='model', v='gen_tokens')} AS avg_rank FROM {{runs}}")
derived("signed_ranks", ("pairs",), signed_ranks, f"SELECT dataset, d, {_AVERAGE.format(g='dataset', v='abs(d)')} AS r FROM (SELECT dataset, round(cb - ca, 9) AS d FROM {{pairs}}) AS p WHERE d <> 0")
