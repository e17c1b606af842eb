"""Token ids in ORC files: run-length encoded integers, row indexes, and Bloom filters on document ids.

Files are in ascending order of document id, part by part, and rows within a file too; stripes can be read in parallel,
and readers skip files, stripes and row groups by the least and greatest document id and by the Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, slices
from .ranked import ranked_encoder

SCHEMA = "doc_id long, first long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "2000",
    "compression": "snappy",
    "maxRecordsPerFile": "0",  # a task writes one file, in which first counts on
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One row per row of docs, in order of id (nulls first): ids of its text with end_id after them, and first, the ids
    before it in its file. The text is shuffled once, before it is encoded; the tokenizer runs once on each text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = ranked_encoder(tokenizer), 0
        for b in slices(batches, "text"):
            ids, bounds = encoder.encode(b.column(1), end=end_id)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.record_batch([b.column(0), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), lists], ["doc_id", "first", "n_tokens", "ids"])
            before += int(bounds[-1])

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start is the number of ids in all documents before it. doc_ids prunes by metadata."""
    read = spark.read.schema(SCHEMA).orc(path)
    at = read.select("doc_id", "n_tokens", F.col("_metadata.file_path").alias("_file"))
    # a row per file comes to the driver, not one per document
    files = at.groupBy("_file").agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.sum("n_tokens").alias("n")).collect()
    bases, total = [], 0
    for f in sorted(files, key=lambda f: (f.nulls == 0, f.least is not None, f.least or 0)):
        bases.append((f["_file"], total))
        total += f.n
    before = spark.createDataFrame(bases, T.StructType([T.StructField("_file", T.StringType()), T.StructField("_base", T.LongType())]))
    if doc_ids is not None:
        read = read.where(F.col("doc_id").isin(*doc_ids))
    rows = read.withColumn("_file", F.col("_metadata.file_path")).join(F.broadcast(before), "_file")  # a row per file
    return rows.select("doc_id", (F.col("_base") + F.col("first")).alias("start"), "n_tokens", "ids")


def crcs(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_token_files()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            bounds = lists.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs' token files to a fresh shared folder and reads them back as crcs().

    A null or empty text has only the end id. Repeated rows each have a row of their own. An empty table gives an empty
    result.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    write_token_files(docs, path, tokenizer, end_id)
    return crcs(read_token_files(spark, path))
