"""Batch scoring with a model that may run out of memory: longest rows first, and a batch that fails is halved."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scorer(Protocol):
    """What a model must offer: a result for each text, or each pair of texts where second is given. A number (score), a list
    of numbers (embed) or a text (generate).
    """

    def __call__(self, first: Sequence[str], second: Sequence[str] | None) -> Sequence: ...


RESULTS = {"score": ("double", pa.float64()), "embed": ("array<float>", pa.list_(pa.float32())), "generate": ("string", pa.string())}


def out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or isinstance(error, RuntimeError) and "out of memory" in str(error).lower()


def halving(scorer: Scorer, first: Sequence[str], second: Sequence[str] | None) -> list:
    """The scorer's results; a batch for which memory doesn't suffice goes in two halves, each halved again if need be. One row
    for which it doesn't suffice is an error, as is any other failure. No recursion: halves wait in a list.
    """
    out: list = [None] * len(first)
    waiting = [(0, len(first))] if first else []
    while waiting:
        a, b = waiting.pop()
        try:
            got = scorer(first[a:b], None if second is None else second[a:b])
        except Exception as e:
            if not out_of_memory(e) or b - a == 1:
                raise
            middle = (a + b) // 2
            waiting += [(middle, b), (a, middle)]
            continue
        if len(got) != b - a:
            raise ValueError(f"{len(got)} results for {b - a} rows")
        out[a:b] = list(got)
    return out


def _scored(batches: Iterator[pa.RecordBatch], make: Callable[[], Scorer], cols: Sequence[str], size: int, kind: str, name: str) -> Iterator[pa.RecordBatch]:
    scorer = None
    for batch in batches:
        scorer = scorer or make()  # once a task, and not for a task without rows
        texts = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in cols]
        whole = [i for i in range(batch.num_rows) if all(t[i] is not None for t in texts)]
        longest = sorted(whole, key=lambda i: -sum(len(t[i]) for t in texts))
        results: list = [None] * batch.num_rows
        for at in range(0, len(longest), size):
            rows = longest[at : at + size]
            parts = [[t[i] for i in rows] for t in texts]
            for i, r in zip(rows, halving(scorer, parts[0], parts[1] if len(parts) > 1 else None)):
                results[i] = r.tolist() if isinstance(r, np.ndarray) else r
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, RESULTS[kind][1])], names=[*batch.schema.names, name])


def score(df: DataFrame, make: Callable[[], Scorer], first: str, second: str | None = None, size: int = 64, kind: str = "score", name: str = "score") -> DataFrame:
    """df with the scorer's result for each row; null where a text is null. make: called on the executors, once a task, to load
    the model. Rows are sorted by length within an Arrow batch only, so nothing is gathered and order among rows is kept.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    cols = [first] + ([second] if second else [])
    return df.mapInArrow(lambda batches: _scored(batches, make, cols, size, kind, name), f"{ddl}, `{name}` {RESULTS[kind][0]}")


def six_digits(x: float) -> float:
    """x, not negative, to six digits; halves go up, as SQL rounds doubles, where round() goes by the exact binary value."""
    whole = math.floor(x * 1e6)
    return (whole + (x * 1e6 - whole >= 0.5)) / 1e6


class Overlap:
    """A scorer without a model: the share of the first text's different words that the second has, six digits. It claims to be
    out of memory beyond so many characters, batches as models pad them: rows times the longest row.
    """

    def __init__(self, characters: int = 200_000) -> None:
        self.characters, self.calls = characters, 0

    def __call__(self, first: Sequence[str], second: Sequence[str] | None) -> list[float]:
        self.calls += 1
        pairs = list(zip(first, second if second is not None else first))
        if len(pairs) > 1 and len(pairs) * max(len(a) + len(b) for a, b in pairs) > self.characters:
            raise RuntimeError("out of memory")
        out = []
        for a, b in pairs:
            # one letter has a lower case of two code points in Python alone
            x, y = (set(re.findall("[a-z]+", t.replace("\u0130", "i").lower())) for t in (a, b))
            out.append(six_digits(len(x & y) / len(x)) if x else 0.0)
        return out


def batch_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation against the turn before it, by Overlap; turns without a text take no part."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text IS NOT NULL")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    pairs = c.select("conv_id", "turn", "text").join(before, ["conv_id", "turn"])
    return score(pairs, Overlap, "before", "text").select("conv_id", "turn", "score")


QUERIES = {
    "batch_scores": (
        batch_scores,
        """
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM conversations WHERE text IS NOT NULL)
SELECT b.conv_id, b.turn, CASE WHEN len(a.ws) = 0 THEN 0e0 ELSE round(len(list_intersect(a.ws, b.ws)) * 1e0 / len(a.ws), 6) END AS score
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    )
}
