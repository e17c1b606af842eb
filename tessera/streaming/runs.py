"""Incremental ingestion of run records: each id is appended once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def append_new(batch: DataFrame, number: int, out: str, key: str) -> None:
    """Appends the rows of a micro-batch whose key isn't in out yet. Its folder is its number: a batch that runs again after a
    failure replaces what it wrote before and doesn't take its own rows for old ones. Of rows with one key in one batch, the
    least stays. What is there already is read by its keys alone and joined, so no stream state grows with the ids.
    """
    spark = batch.sparkSession
    cols = [c for c in batch.columns if c != key]
    one = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("r")).select(key, "r.*").select(*batch.columns)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        schema = batch.select(key).schema.add("batch", "long")
        there = spark.read.schema(schema).parquet(out).where(F.col("batch") != number).select(key)
        one = one.join(there, key, "left_anti")
    one.write.mode("overwrite").parquet(f"{out}/batch={number}")


def ingest(spark: SparkSession, source: str, key: str = "event_id", columns: Sequence[str] = ("user_id", "event_type", "value"), top: str | None = None) -> DataFrame:
    """Streams what is new in a file or folder to the end and returns all that was ever appended. top: the folder of output and
    progress; a later call with the same one goes on where the last one ended. Without it, a fresh shared folder.
    """
    top = top or shared_dir(spark, "stream")
    out = f"{top}/out"
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(source if source.endswith("/") else f"{source}*").select(key, *columns)
    query = rows.writeStream.foreachBatch(lambda df, n: append_new(df, n, out, key)).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
