"""Sequence packing by first-fit decreasing, with a tournament tree over bin capacities, in randomised groups."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .ranked import ranked_encoder

CAPACITY = 2048
#: Documents, and bytes of text, that a group has on average at most; groups are packed on their own.
GROUP_DOCS, GROUP_BYTES = 4096, 32 << 20


def first_fit_decreasing(lengths: Sequence[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item (each at most capacity long). The leaves of a complete binary tree hold the room left
    in each bin and every inner node the most room below it, so the first bin with room is found from the root.
    """
    n = len(lengths)
    size = 1 << max(0, math.ceil(math.log2(max(n, 1))))
    room = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
        need, node = lengths[i], 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, copy): each document's ids and end_id, cut every capacity ids. copy
    counts the rows of the same id and ids that a task met before.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = ranked_encoder(tokenizer), Counter()
        for b in slices(batches, "_text"):
            ids, bounds = encoder.encode(b.column(1), end=end_id)
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            totals = np.diff(bounds)
            counts = -(-totals // capacity)
            doc = np.repeat(np.arange(len(totals)), counts)
            starts = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
            lens = np.minimum(capacity, totals[doc] - starts)
            at = bounds[:-1][doc] + starts
            crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), lens.tolist())]
            copies = []
            for key in zip(b.column(0).to_pylist(), [crc[k] for k in (np.cumsum(counts) - 1).tolist()], totals.tolist()):
                copies.append(met[key])
                met[key] += 1
            columns = (pa.array(starts), pa.array(lens), pa.array(crc, pa.int64()), pa.array(totals[doc]), pa.array(np.array(copies, np.int64)[doc]))
            yield pa.record_batch([b.column(0).take(pa.array(doc)), *columns], ["_id", "start", "length", "ids_crc32", "doc_tokens", "copy"])

    return rows.mapInArrow(run, "_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long").withColumnRenamed("_id", id_col)


def packed(items: DataFrame, groups: int, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """items (pieces()) with sequence_id and offset. Documents go to groups at random, by a hash, with their last pieces;
    full pieces, which fill a sequence each, are spread over all groups so that a long document doesn't make one group
    large. Sequences are filled gaplessly from offset 0.
    """
    schema = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(g["length"].tolist(), capacity)
        return g.drop(columns=["_group", "copy"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    place = F.when(F.col("length") < capacity, F.lit(-1)).otherwise(F.col("start"))
    at = F.pmod(F.xxhash64("_id", "copy", place), F.lit(groups))
    return items.withColumnRenamed(id_col, "_id").withColumn("_group", at).groupBy("_group").applyInPandas(pack, schema).withColumnRenamed("_id", id_col)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every document of docs in sequences of at most capacity tokens; a null text counts as empty and has its end id.

    Repeated rows are packed each, and spread over the groups like others. A null id keeps its row. An empty table gives
    an empty result. Other columns are not looked at.
    """
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, math.ceil(size.rows / group_docs), math.ceil(size.bytes / group_bytes))
    return packed(pieces(docs, tokenizer, end_id, capacity), groups, capacity)
