"""Connected components by alternating large-star and small-star contraction, on joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, written

MAX_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links: pairs of comparable ids. Returns (node, root) for every id of a link between different ids; root is the
    smallest id that can be reached. Null ids and self-links are left out. No group is gathered in one task: each step
    takes the least neighbour by a partial aggregate and joins it back, which adaptive execution may split at hubs.
    Each round ends in a table in the shared folder.
    """
    spark = links.sparkSession
    u, v = F.col("u"), F.col("v")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    edges = edges.where("_a IS NOT NULL AND _b IS NOT NULL AND _a <> _b").select("u", "v").distinct()
    path = shared_dir(spark)
    edges = written(edges, path)
    seen = _digest(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = shared_dir(spark)
        edges = written(small, new)
        discard(spark, path)
        path, before, seen = new, seen, _digest(edges)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(u.alias("node"), v.alias("root")).unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first())
