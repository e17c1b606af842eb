"""Tables that cut a plan in two, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession, kind: str = "table") -> str:
    """A fresh folder below spark.checkpoint.dir, or below a temporary one where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written and read again: its rows no longer depend on how, or how often, they are worked out."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew if its rows lie in fewer partitions than there are cores, as one large row group does: for work that costs
    far more than moving a row. Partitions are counted without reading a column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.groupBy(F.spark_partition_id()).agg(F.lit(1)).count()
    return df.repartition(2 * cores) if 0 < filled < cores else df
