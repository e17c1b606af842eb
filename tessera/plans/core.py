"""Plans: relational operators as SQL over named inputs. Catalyst plans them in Spark; any DataFrame with the columns can
be an input, and views derive the usual inputs from the benchmark tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: SQL of each view over tables and other views, or (inputs, function) for Spark; with a second text where the dialects differ.
VIEWS: dict[str, tuple[str | tuple[tuple[str, ...], Callable[..., DataFrame]], str]] = {}


def view(name: str, sql: str, duck: str | None = None) -> None:
    VIEWS[name] = (sql, duck or sql)


def derived(name: str, inputs: tuple[str, ...], make: Callable[..., DataFrame], duck: str) -> None:
    """A view that Spark makes by a function of other inputs, where SQL would gather a group in one task."""
    VIEWS[name] = ((inputs, make), duck)


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


@dataclass(frozen=True)
class Plan:
    """sql: in Spark's dialect, with {inputs}; duck: in DuckDB's where they differ."""

    name: str
    sql: str
    duck: str | None = None

    def run(self, spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        """The operator over given inputs; those left out must be views of given ones."""
        return _resolve(spark, self.sql, lambda n: inputs[n], dict(inputs))

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return _resolve(spark, self.sql, lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"), {})

    def oracle(self) -> str:
        return _counts(_inline(self.duck or self.sql))


def _resolve(spark: SparkSession, sql: str | tuple, table, known: dict[str, DataFrame]) -> DataFrame:
    if isinstance(sql, tuple):
        inputs, make = sql
        return make(*[_input(spark, n, table, known) for n in inputs])
    return spark.sql(sql, **{n: _input(spark, n, table, known) for n in _names(sql)})


def _input(spark: SparkSession, name: str, table, known: dict[str, DataFrame]) -> DataFrame:
    if name not in known:
        known[name] = _resolve(spark, VIEWS[name][0], table, known) if name in VIEWS else table(name)
    return known[name]


def _counts(sql: str) -> str:
    """count_if(c) as count(CASE WHEN c THEN 1 END), which is a BIGINT in DuckDB."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 1, k + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:k], "count(CASE WHEN ", _counts(sql[k + 9 : end - 1]), " THEN 1 END)"]
        at = end
    return "".join([*out, sql[at:]])


def _inline(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: f"({_inline(VIEWS[m[1]][1])})" if m[1] in VIEWS else m[1], sql)


def collect(*plans: Plan) -> dict[str, tuple[Plan, str]]:
    return {p.name: (p, p.oracle()) for p in plans}
