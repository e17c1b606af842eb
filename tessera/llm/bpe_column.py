"""Encoding and decoding of a text column by speculative BPE."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import speculative_bpe, speculative_encoder


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded string). A null or empty text has no ids and decodes to an empty text."""
    return _mapped(docs, tokenizer, id_col, text_col, digests=False)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of encoded(), worked out where it is encoded."""
    return _mapped(docs, tokenizer, id_col, text_col, digests=True)


def _mapped(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = speculative_bpe(tokenizer)
        encoder = speculative_encoder(bpe)
        for b in slices(batches, "_text"):
            ids, bounds = encoder.encode(b.column(1))
            cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            listed = ids.tolist()
            texts = [bpe.decode(listed[a:z]) for a, z in cuts]
            if digests:
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                of_ids = [hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in cuts]
                of_texts = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                yield pa.record_batch([b.column(0), pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.record_batch([b.column(0), lists, pa.array(texts, pa.string())], ["_id", "ids", "decoded"])

    schema = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "_id long, ids array<int>, decoded string"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
