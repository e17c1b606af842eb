"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import calibration, gates, hooks, index, inference, invented, questions, replicates, responses, runs, scorer, selective, text

MODULES: tuple = (runs, calibration, selective, gates, hooks, text, index, questions, invented, inference, replicates, scorer, responses)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
