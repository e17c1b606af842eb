"""Ranks and running sums within groups of any size. Rows are range-partitioned by group and order, so one group spreads
over many tasks; each task numbers its own rows in one pass, and what earlier tasks hold of a group is added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..sources.tables import written


def _running(batches: Iterator[pa.RecordBatch], group: str, sums: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with their number in their group and running sums, both counted from the task's first row."""
    last, carried = None, [0.0] * (len(sums) + 1)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g = batch.column(batch.schema.get_field_index(group))
        starts = np.ones(n, bool)
        starts[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
        if last is not None and g[0].as_py() == last:
            starts[0] = False
        else:
            carried = [0] * (len(sums) + 1)
        first = np.maximum.accumulate(np.where(starts, np.arange(n), -1))  # -1: begun in an earlier batch
        out = []
        for j, c in enumerate([None, *sums]):
            x = np.ones(n, np.int64) if c is None else pc.fill_null(batch.column(batch.schema.get_field_index(c)), 0).to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(x)])
            run = total[1:] - total[np.maximum(first, 0)] + np.where(first < 0, carried[j], 0)
            carried[j] = run[-1]
            out.append(pa.array(run.astype(x.dtype)))
        last = g[n - 1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Sequence[str] = (), position: str = "k", prefix: str = "upto_") -> DataFrame:
    """df with position (from 1, in its group, by order) and, for each numeric column of sums, its sum up to and with this
    row (nulls count as 0) as prefix + its name. Rows that tie in order are numbered in any one order, all differently.
    Null groups are groups. The sorted rows are written once: sampled range bounds can't differ between their two readers.
    Broadcast is one row at most for each task that goes on with an earlier task's group.
    """
    kinds = {c: DoubleType() if df.schema[c].dataType.simpleString() in ("double", "float") or "decimal" in df.schema[c].dataType.simpleString() else LongType() for c in sums}
    helpers, names = [f"_x{j}" for j in range(len(sums))], ["_k", *[f"_s{j}" for j in range(len(sums))]]
    key = F.to_json(F.struct(*[F.col(c).alias(f"g{j}") for j, c in enumerate(group)])) if group else F.lit("")
    keyed = df.withColumns({"_group": key} | {h: F.col(c).cast(kinds[c]) for h, c in zip(helpers, sums)})
    rows = keyed.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    schema = StructType([*keyed.schema.fields, *[StructField(n, LongType() if n == "_k" else kinds[sums[int(n[2:])]]) for n in names]])
    numbered = rows.mapInArrow(lambda batches: _running(batches, "_group", helpers, names), schema)
    numbered = written(numbered.withColumn("_part", F.spark_partition_id()).drop(*helpers))
    parts = numbered.groupBy("_group", "_part").agg(F.max("_k").alias("n"), *[F.max_by(s, "_k").alias(s) for s in names[1:]])
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = parts.select("_group", "_part", F.sum("n").over(before).alias("_n0"), *[F.sum(s).over(before).alias(f"{s}0") for s in names[1:]]).where("_n0 IS NOT NULL")
    held = held.select(F.col("_group").alias("_g2"), F.col("_part").alias("_p2"), "_n0", *[f"{s}0" for s in names[1:]])
    out = numbered.join(F.broadcast(held), (F.col("_group") == F.col("_g2")) & (F.col("_part") == F.col("_p2")), "left")
    made = {position: F.col("_k") + F.coalesce("_n0", F.lit(0))} | {f"{prefix}{c}": F.col(s) + F.coalesce(f"{s}0", F.lit(0)) for c, s in zip(sums, names[1:])}
    return out.select(*df.columns, *[c.alias(n) for n, c in made.items()])


def average_ranks(df: DataFrame, group: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """df with the average rank of value in its group, least first; rows that tie share the mean of their places. Counted
    by distinct value first: what is sorted is values, and rows get their rank by a join on group and value.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    upto = running(counts, group, [F.col(value)], ["_n"], "_k").select(*[F.col(c).alias(f"_g{j}") for j, c in enumerate(group)], F.col(value).alias("_v"), (F.col("upto__n") - (F.col("_n") - 1) / 2).alias(rank))
    same = F.col(value).eqNullSafe(F.col("_v"))
    for j, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{j}"))
    return df.join(upto, same).select(*df.columns, rank)
