"""Prefix trie of conversations, built level by level and rolled up level by level.

A node is a distinct sequence of first turns, named by its depth and its least conversation. Per depth, live conversations
are grouped by (node, next turn). A conversation that is alone in its node leaves the levels: all nodes below are its own
and known at once. So there are as many levels as the longest beginning that two conversations share has turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running
from .common import discard, shared_dir, written

#: Conversations of a node are dealt to so many parts before they are joined with the nodes below it.
SALTS = 64
#: Conversations before 0, 20, 40, ... lend their first turns to the 19 that follow; at most LENT - 1 turns.
FAMILY, LENT = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns by turn (null first), numbered from 1; ties by role, then text. Null roles and
    texts become empty; rows without a conv_id are left out. Conversations of any length: turns are numbered by ranges.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], position="pos").drop("turn")


def lent(conv_id: Column) -> Column:
    """How many turns of conversation c - c % 20 stand before c's own (% as SQL has it, with the sign of c)."""
    return F.crc32(conv_id.cast("string").cast("binary")) % LENT


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, words) of the rebuilt conversations, and (conv_id, length) of all, turnless ones included. key:
    SHA-256 of role and text; words: of the text.
    """
    key = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    t = turns.select("conv_id", "pos", key.alias("key"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    own = t.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", lent(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    # a family has 20 conversations on either side of 0 at most, and lends 3 turns
    first = t.where((F.col("pos") < LENT) & (F.col("conv_id") % FAMILY == 0))
    head = first.select(F.col("conv_id").alias("base"), "pos", "key", "words").join(own.select("conv_id", "base", "h"), "base").where("pos <= h")
    lends = first.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("m"))
    sizes = own.join(lends, "base", "left").select("conv_id", "n", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("m"))
    tail = t.join(sizes, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "key", "words")
    return head.select("conv_id", "pos", "key", "words").unionByName(tail), sizes.select("conv_id", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("m")).alias("length"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order within each node, comma-joined; a row per node and batch."""
    for batch in batches:
        depth, node, ids = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        out: list[tuple] = []
        for i in range(1, len(ids) + 1):
            if i == len(ids) or (depth[i], node[i]) != (depth[at], node[at]):
                out.append((depth[at], node[at], ids[at], ",".join(map(str, ids[at:i]))))
                at = i
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "node", "first", "ids"), r)) for r in out], schema=pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order within each node, one digest a node; what is held is one state, however many pieces there are."""
    at, state = None, None
    for batch in batches:
        rows = []
        for depth, node, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("depth", "node", "ids"))):
            if (depth, node) == at:
                state.update(b"," + ids.encode())
                continue
            if at:
                rows.append((*at, state.hexdigest()))
            at, state = (depth, node), hashlib.sha256(ids.encode())
        yield _named(rows)
    if at:
        yield _named([(*at, state.hexdigest())])


def _named(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("depth", "node", "ends_sha256"), r)) for r in rows], schema=pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())]))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, conv_id). Ids are sorted and joined in ranges, so a node with many is
    spread over tasks; one digest reads its pieces in order as a stream.
    """
    ranged = ends.select("depth", "node", "conv_id").repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    pieces = ranged.mapInArrow(_joined_ids, "depth long, node long, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id (least member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Other columns of conversations are ignored; repeated rows are turns of their own; an empty
    table gives no node. The tables of the levels go to the shared folder and are deleted once the result is written.
    """
    spark = conversations.sparkSession
    used: list[str] = []

    def table(df: DataFrame) -> DataFrame:
        used.append(shared_dir(spark))
        return written(df, used[-1])

    raw = table(turns_of(conversations))
    turns, lengths = rebuilt(raw)
    # by position, so that a level reads little more than its own turns
    turns, lengths = table(turns.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id")), table(lengths)
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("length").alias("length")).first()
    zero, least = F.lit(0).cast("long"), F.lit(top.conv_id).cast("long")
    root = spark.range(1 if top.n else 0).select(zero.alias("depth"), least.alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(top.n).cast("long").alias("n_convs"), zero.alias("words"), F.lit(top.length).cast("long").alias("length"))
    nodes, live = [root], lengths.select("conv_id", least.alias("node"), "length").where(F.lit(top.n > 1))
    levels = [live]
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")
    while (depth := len(levels)) and not live.where(F.col("length") >= depth).isEmpty():
        at = turns.where(F.col("pos") == depth).select("conv_id", "key", "words")
        moved = table(live.where(F.col("length") >= depth).join(at, "conv_id").select("conv_id", "node", "length", "key", "words", salt))
        parts = moved.groupBy("node", "key", "salt").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("length").alias("length"))
        groups = table(parts.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.max("length").alias("length")))
        nodes.append(groups.select(F.lit(depth).cast("long").alias("depth"), "conv_id", F.col("node").alias("parent"), "n_convs", "words", "length"))
        shared = groups.where("n_convs > 1").select("node", "key", F.col("conv_id").alias("child"))
        by_salt = moved.select("node", "key", "salt").distinct().join(shared, ["node", "key"])
        live = table(moved.join(by_salt, ["node", "key", "salt"]).select("conv_id", F.col("child").alias("node"), "length"))
        levels.append(live)
    below, out = None, []
    for depth in range(len(nodes) - 1, -1, -1):
        level, alone = nodes[depth], F.col("n_convs") == 1
        if below is None:
            summed = level.withColumns({"n_children": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            up = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            summed = level.join(up, "conv_id", "left")
        more = F.when(alone, (F.col("length") > depth).cast("long")).otherwise(F.coalesce("n_children", F.lit(0)))
        leaves = F.when(alone, F.lit(1)).otherwise(F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)))
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))
        below = table(summed.select("depth", "conv_id", "parent", "n_convs", more.cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), "length"))
        out.append(below)
    all_nodes = reduce(DataFrame.unionByName, out)
    own = F.sha2(F.col("conv_id").cast("string"), 256)
    one = all_nodes.where("n_convs = 1")
    chain = one.where("length > depth").select(F.explode(F.sequence(F.col("depth") + 1, F.col("length"))).alias("depth"), "conv_id", "length")
    chain = chain.select("conv_id", "depth", F.col("conv_id").alias("parent"), F.lit(1).cast("long").alias("n_convs"), (F.col("length") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("length") == F.col("depth"), own).otherwise(NO_ENDS).alias("ends_sha256"))
    alone = one.withColumn("ends_sha256", F.when(F.col("length") == F.col("depth"), own).otherwise(NO_ENDS))
    ends = reduce(DataFrame.unionByName, [x.where(F.col("length") == d).select(F.lit(d).cast("long").alias("depth"), "node", "conv_id") for d, x in enumerate(levels)])
    digests = end_digests(ends).select("depth", F.col("node").alias("conv_id"), "ends_sha256")
    several = all_nodes.where("n_convs > 1").join(digests, ["depth", "conv_id"], "left")
    several = several.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    cols = ("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    result = written(several.select(*cols).unionByName(alone.select(*cols)).unionByName(chain.select(*cols)))
    discard(spark, *used)
    return result
