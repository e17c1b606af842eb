"""Hard-negative mining with a vector-approximation file.

The file holds blocks of vectors. Each dimension of a block is cut into cells of about equally many vectors, a vector keeps
the number of its cell in one byte a dimension, and the block keeps the least and greatest value of each cell. For an
anchor, a table per dimension gives what a cell adds to a score at least and at most; adding up looked-up entries bounds
the score of every vector. Only vectors whose bounds reach into a window, and past what the window has already, are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shared_dir, written

#: Cells of a dimension, vectors of a block, anchors whose tables are made at once.
CELLS, BLOCK, AT_ONCE = 32, 4096, 32
#: Anchors of a round: so many bytes of components, which every task gets. There are as many rounds as it takes.
ROUND_BYTES = 16 << 20
#: The file is written in as many parts as there are pieces of this size.
PART_BYTES = 8 << 20
LEAST, MOST = 1 - (1 << 63), (1 << 63) - 1
FILE = pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("kind", pa.string()), ("cells", pa.int64()), *[(c, pa.binary()) for c in ("ids", "labels", "values", "codes", "low", "high")]])
FILE_DDL = "n long, dim long, kind string, cells long, ids binary, labels binary, values binary, codes binary, low binary, high binary"


def vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """(id, label, q): components become floor(scale * x), x as double. Left out: rows with a null id, label or vector, or
    with a component that is null or not finite. Repeated rows count once.
    """
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("x"), bad.alias("bad"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND NOT bad")
    return rows.select("id", "label", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("q")).dropDuplicates(["id", "label", "q"])


def _matrices(batch: pa.RecordBatch, name: str = "q") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vectors."""
    col = batch.column(batch.schema.get_field_index(name))
    at, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[at[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)


def _block(ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> dict:
    """One block, by label, then id."""
    order = np.lexsort((ids, labels))
    ids, labels, q = ids[order], labels[order], q[order]
    n, dim = q.shape
    cells = int(min(CELLS, max(2, n // 8)))
    top = float(np.abs(q.astype(np.float64)).max(initial=0))
    kind = next((k for k in ("int8", "int16", "int32") if top < np.iinfo(k).max), "int64")
    ranked = np.sort(q, axis=0)
    cuts = ranked[(np.arange(1, cells) * n) // cells]
    codes = np.zeros((dim, n), np.uint8)
    low, high = np.zeros((dim, cells), np.int64), np.zeros((dim, cells), np.int64)
    for d in range(dim):
        codes[d] = np.searchsorted(cuts[:, d], q[:, d], side="right")
        first = np.searchsorted(ranked[:, d], cuts[:, d], side="left")
        begin, end = np.concatenate([[0], first]), np.concatenate([first, [n]])
        low[d], high[d] = ranked[np.minimum(begin, n - 1), d], ranked[np.maximum(end - 1, 0), d]
    return {"n": n, "dim": dim, "kind": kind, "cells": cells, "ids": ids.tobytes(), "labels": labels.tobytes(), "values": q.astype(kind).tobytes(), "codes": codes.tobytes(), "low": low.tobytes(), "high": high.tobytes()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}

    def out(dim: int) -> pa.RecordBatch:
        ids, labels, q = (np.concatenate(x) for x in zip(*held.pop(dim)))
        return pa.RecordBatch.from_pylist([_block(ids, labels, q)], schema=FILE)

    for batch in batches:
        ids, labels = (batch.column(i).to_numpy() for i in (0, 1))
        for rows, q in _matrices(batch):
            dim = q.shape[1]
            most = max(1, min(BLOCK, PART_BYTES // (8 * max(dim, 1))))
            for i in range(0, len(rows), most):
                held.setdefault(dim, []).append((ids[rows[i : i + most]], labels[rows[i : i + most]], q[i : i + most]))
                if sum(len(x[0]) for x in held[dim]) >= most or len(held) > 64:
                    yield out(dim)
    for dim in list(held):
        yield out(dim)


def write_file(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The vector-approximation file of vectors(): a row per block of vectors of one length, by label and id within."""
    size = rows.agg(F.sum(F.size("q") + 2)).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(least, size // 4096), size * 8 // PART_BYTES)
    return written(rows.repartition(parts, "id").mapInArrow(_blocks, FILE_DDL), path)


@dataclass
class Anchor:
    """windows: least and greatest score; best: for each window, up to k (-score, id), best first."""

    key: int
    id: int
    label: int
    windows: list[tuple[int, int]]
    tags: list[int]
    best: list[list[tuple[int, int]]] = field(default_factory=list)


def _exact(q: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of rows of q with a, exact; cut to 64 bits."""
    top = int(np.abs(q.astype(np.float64)).max(initial=0)) * int(np.abs(a.astype(np.float64)).max(initial=0)) * max(1, len(a))
    if top < 1 << 52:
        return (q.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    if top < 1 << 61:
        return q.astype(np.int64) @ a
    return np.array([min(MOST, max(LEAST, sum(x * y for x, y in zip(r, a.tolist())))) for r in q.astype(np.int64).tolist()], np.int64)


def _bounds(codes: np.ndarray, low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(least, greatest) scores, (vectors, anchors), by table lookup; None where sums might not fit."""
    dim, n = codes.shape
    top = max(int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (low, high)) * int(np.abs(anchors.astype(np.float64)).max(initial=0)) * max(1, dim)
    if top >= 1 << 61:
        return None
    kind = np.int32 if top < 1 << 30 else np.int64
    a = anchors.T[:, None, :].astype(np.int64)
    x, y = low[:, :, None] * a, high[:, :, None] * a
    tables = np.concatenate([np.minimum(x, y), np.maximum(x, y)], axis=2).astype(kind)
    sums = np.zeros((n, 2 * len(anchors)), kind)
    for at in range(0, n, 1024):
        part = sums[at : at + 1024]
        for d in range(dim):
            part += tables[d].take(codes[d, at : at + 1024], axis=0)
    return sums[:, : len(anchors)], sums[:, len(anchors) :]


def _search(a: Anchor, vector: np.ndarray, ids: np.ndarray, q: np.ndarray, least: np.ndarray | None, most: np.ndarray | None, k: int) -> int:
    """Takes rows into the windows of a; returns how many it scored exactly."""
    if least is None:
        rows = np.arange(len(ids))
    else:
        wanted = np.zeros(len(ids), bool)
        some = np.flatnonzero((most >= min(w[0] for w in a.windows)) & (least <= max(w[1] for w in a.windows)) & (ids != a.id))
        l, m = least[some], most[some]
        for (lo, hi), best in zip(a.windows, a.best):
            bar = -best[-1][0] if len(best) == k else lo
            sure = l[(l >= lo) & (m <= hi)]
            if len(sure) >= k:
                bar = max(bar, int(np.partition(sure, len(sure) - k)[len(sure) - k]))
            wanted[some[(m >= max(lo, bar)) & (l <= hi)]] = True
        rows = np.flatnonzero(wanted)
    rows = rows[ids[rows] != a.id]
    if len(rows):
        scores, names = _exact(q[rows], vector), ids[rows]
        for j, (lo, hi) in enumerate(a.windows):
            fit = np.flatnonzero((scores >= lo) & (scores <= hi))
            if len(a.best[j]) == k:
                fit = fit[scores[fit] >= -a.best[j][-1][0]]
            if len(fit) > k:  # all that tie with the k-th stay until ids decide
                s = scores[fit]
                fit = fit[s >= np.sort(s)[len(s) - k]]
                fit = fit[np.lexsort((names[fit], -scores[fit]))[:k]]
            a.best[j] = sorted([*a.best[j], *((-int(scores[i]), int(names[i])) for i in fit)])[:k]
    return len(rows)


def _scan(batches: Iterator[pa.RecordBatch], anchors: list[tuple], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """What the blocks of this task hold for each anchor (key, id, label, q, windows, tags): k rows a window at most, from rows
    of its label (same) or of all others.
    """
    found = [Anchor(key, i, label, windows, tags, [[] for _ in windows]) for key, i, label, _, windows, tags in anchors]
    by_shape: dict[tuple, list[int]] = {}
    for j, (_, _, label, q, windows, _) in enumerate(anchors):
        if windows:
            by_shape.setdefault((len(q), label if same else None), []).append(j)
    arrays = [np.array(x[3], np.int64) for x in anchors]
    for batch in batches:
        for b in batch.to_pylist():
            n, dim, cells = b["n"], b["dim"], b["cells"]
            ids, labels = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
            values, codes = np.frombuffer(b["values"], b["kind"]).reshape(n, dim), np.frombuffer(b["codes"], np.uint8).reshape(dim, n)
            low, high = (np.frombuffer(b[c], np.int64).reshape(dim, cells) for c in ("low", "high"))
            for (size, label), group in by_shape.items():
                d = min(size, dim)  # what a shorter vector lacks counts as 0
                begin, end = (int(np.searchsorted(labels, label, s)) for s in ("left", "right")) if same else (0, n)
                if begin == end:
                    continue
                for at in range(0, len(group), AT_ONCE):
                    js = group[at : at + AT_ONCE]
                    bounds = _bounds(codes[:d, begin:end], low[:d], high[:d], np.array([arrays[j][:d] for j in js]).reshape(len(js), d))
                    for c, j in enumerate(js):
                        parts = [(begin, end)]
                        if not same:
                            cut = [int(np.searchsorted(labels, found[j].label, s)) for s in ("left", "right")]
                            parts = [(0, cut[0]), (cut[1], n)]
                        for p, e in parts:
                            if p < e:
                                lo, hi = (None, None) if bounds is None else (bounds[0][p - begin : e - begin, c], bounds[1][p - begin : e - begin, c])
                                _search(found[j], arrays[j][:d], ids[p:e], values[p:e, :d], lo, hi, k)
    rows = [(a.key, a.id, tag, w[1], i, -s) for a in found for tag, w, best in zip(a.tags, a.windows, a.best) for s, i in best]
    cols = ("key", "anchor_id", "tag", "top", "id", "score")
    yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(cols)})


_FOUND = "key long, anchor_id long, tag long, top long, id long, score long"


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, q) of vectors().
    Scores are exact inner products of integers, higher first, ties by smaller id; what lies beyond 64 bits is cut to their
    range. An anchor's positives are the first other rows (other ids) of its label, its negatives for a positive the first
    rows of other labels that score from least_percent of the positive's score up to it. Vectors may differ in length.
    Every anchor meets every row, in blocks; anchors go round by round, so that a task holds a bounded part of them. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    paths = [shared_dir(spark) for _ in range(2)]
    rows = written(rows, paths[0])
    file = write_file(rows, paths[1])
    anchors = rows.where(is_anchor).withColumn("key", F.xxhash64("id", "label", "q"))
    size = anchors.agg(F.sum(F.size("q") + 8)).first()[0] or 0
    rounds = 1 + size * 8 // ROUND_BYTES
    out = []
    for r in range(rounds):
        chosen = [(a.key, a.id, a.label, list(a.q)) for a in anchors.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r).collect()]
        first = [(*a, [(LEAST, MOST)], [0]) for a in chosen]
        near = _best(file.mapInArrow(lambda batches, first=first: _scan(batches, first, True, positives), _FOUND), ["key"], positives)
        held: dict[int, list[tuple[int, int]]] = {}
        for x in near.select("key", "id", "score").collect():
            held.setdefault(x.key, []).append((x.score, x.id))
        second = []
        for a in chosen:
            windows = [(s, i, -(-least_percent * s // 100)) for s, i in held.get(a[0], []) if -(-least_percent * s // 100) <= s]
            if windows:
                second.append((*a, [(lo, s) for s, _, lo in windows], [i for _, i, _ in windows]))
        mined = _best(file.mapInArrow(lambda batches, second=second: _scan(batches, second, False, negatives), _FOUND), ["key", "tag", "top"], negatives)
        out.append(shared_dir(spark))
        written(mined.select("anchor_id", F.col("tag").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score")), out[-1])
    discard(spark, *paths)
    return spark.read.parquet(*out)
