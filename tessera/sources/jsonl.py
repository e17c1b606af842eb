"""JSON Lines and CSV sources and sinks, and a manifest of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines give no row."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Committed as a whole, or not at all."""
    df.write.mode("append" if append else "overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def shard_report(shards: list[DataFrame], expected: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Shards put together as they are, and a row that tells (n, duplicates, duplicate_ids, as_expected)."""
    merged = shards[0]
    for s in shards[1:]:
        merged = merged.unionByName(s, allowMissingColumns=True)
    per_id = merged.groupBy(id_col).agg(F.count("*").alias("k"))
    rows = F.coalesce(F.sum("k"), F.lit(0))
    twice = F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0))
    return merged, per_id.agg(rows.alias("n"), twice.alias("duplicates"), F.count_if(F.col("k") > 1).alias("duplicate_ids"), (rows == expected).alias("as_expected"))


def log_rates(spark: SparkSession, path: str) -> DataFrame:
    """(model, baseline, rag): seconds a question, from each log's first line of a finished model."""
    line = r"([\w.\-]+)\s+(?:DONE|PROBLEM)\s+[\d.]+\s+[\d.]+\s+[\d./]+\s+([\d.]+)/([\d.]+)"
    log = spark.read.text(path, wholetext=True).where(F.col("value").rlike(line))
    part = lambda k: F.regexp_extract("value", line, k)
    return log.select(part(1).alias("model"), part(2).cast("double").alias("baseline"), part(3).cast("double").alias("rag"))
