"""Paired bootstraps of rank statistics: AUROC, area under the risk-coverage curve, and pooled differences of gains.

A replicate gives each row a Poisson(1) weight, drawn from the row's id and the seed alone. Both scores of a row so get the
same weight, whatever task it is in, and no row is drawn, copied or joined. A task holds a few vectors with an entry for
each replicate; where a statistic needs what lies before it in order, tasks are put in order afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import views  # noqa: F401
from ..sources.tables import written
from .inference import REPLICATES, SEED, _interval, gain
from .questions import _view

#: Rows whose weights a task makes at once.
ROWS = 2000


def weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(rows, replicates): Poisson(1) draws by inversion of a hash of id, replicate and seed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # the finaliser of SplitMix64
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    steps = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 19)])])
    return np.searchsorted(steps, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.int8)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of at most ROWS rows of one group."""
    for batch in batches:
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        g = cols["g"]
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else [0]
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, ROWS):
                yield {n: c[at : min(b, at + ROWS)] for n, c in cols.items()}


class Ties:
    """Weights of positive and negative rows by score, least first: done with (u: pairs that the positive wins, a tie counts
    half), and the open score, whose rows may go on. The first score stays apart: it may have begun elsewhere.
    """

    def __init__(self) -> None:
        self.first = self.done = self.open = None

    def add(self, score: float, p: np.ndarray, n: np.ndarray) -> None:
        if self.open is not None and self.open[0] == score:
            self.open = (score, self.open[1] + p, self.open[2] + n)
            return
        self._close()
        self.open = (score, p, n)

    def _close(self) -> None:
        if self.open is None:
            return
        score, p, n = self.open
        if self.first is None:
            self.first = self.open
        else:
            self.between(p * n / 2, p, n)

    def between(self, u: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """What lies wholly above all before it."""
        if self.done is None:
            self.done = (u, p, n)
        else:
            du, dp, dn = self.done
            self.done = (du + u + p * dn, dp + p, dn + n)

    def segments(self) -> list[tuple[float | None, np.ndarray | None, np.ndarray, np.ndarray]]:
        """(score, None, p, n) of the first and the open score, (None, u, p, n) of what lies between."""
        out = []
        if self.first is not None:
            out.append((self.first[0], None, *self.first[1:]))
        if self.done is not None:
            out.append((None, *self.done))
        if self.open is not None:
            out.append((self.open[0], None, *self.open[1:]))
        return out


def _tied(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, part, score, id, label) by g, score: the segments of each group in this task. Replicate 0 weighs all as 1."""
    at, held, part = None, None, 0

    def out() -> pa.RecordBatch:
        rows = [{"g": at, "part": part, "seq": i, "score": s, "u": u, "p": p, "n": n} for i, (s, u, p, n) in enumerate(held.segments())]
        return pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows], schema=_TIED)

    for x in _pieces(batches):
        if x["g"][0] != at:
            if held is not None:
                yield out()
            at, held, part = x["g"][0], Ties(), int(x["part"][0])
        w = np.concatenate([np.ones((len(x["id"]), 1)), weights(x["id"], replicates, seed)], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], x["score"][1:] != x["score"][:-1]]))
        y = x["label"].astype(bool)[:, None]
        p, n = (np.add.reduceat(np.where(side, w, 0), starts, axis=0) for side in (y, ~y))
        for i, k in enumerate(starts):
            held.add(float(x["score"][k]), p[i], n[i])
    if held is not None:
        yield out()


_TIED = pa.schema([("g", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("score", pa.float64()), *[(c, pa.list_(pa.float64())) for c in ("u", "p", "n")]])
_TIED_DDL = "g string, part long, seq long, score double, u array<double>, p array<double>, n array<double>"


def _wins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order: (g, auroc of each replicate); a stream, one set of vectors at a time. 0.5 without both kinds."""
    at, held = None, None
    schema = pa.schema([("g", pa.string()), ("draws", pa.list_(pa.float64()))])

    def out() -> pa.RecordBatch:
        rest = Ties()
        for s, u, p, n in held.segments():
            rest.between(p * n / 2 if u is None else u, p, n)
        u, p, n = rest.done
        return pa.RecordBatch.from_pylist([{"g": at, "draws": np.where(p * n > 0, u / np.maximum(p * n, 1), 0.5).tolist()}], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            if r["g"] != at:
                if held is not None:
                    yield out()
                at, held = r["g"], Ties()
            p, n = np.array(r["p"]), np.array(r["n"])
            if r["score"] is not None:
                held.add(r["score"], p, n)
            else:  # above all that is held, so nothing stays open
                held._close()
                held.open = None
                held.between(np.array(r["u"]), p, n)
    if held is not None:
        yield out()


def auroc_draws(rows: DataFrame, group: str, score: Column, label: Column, id_col: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(group, draws): the AUROC of all rows, then of each replicate. Rows are sorted by score in ranges, so a group, and a
    score that many rows share, spread over tasks.
    """
    x = rows.select(F.col(group).cast("string").alias("g"), score.cast("double").alias("score"), F.xxhash64(id_col).alias("id"), label.cast("boolean").alias("label")).dropna()
    x = x.repartitionByRange("g", "score", "id").sortWithinPartitions("g", "score").withColumn("part", F.spark_partition_id().cast("long"))
    parts = x.mapInArrow(lambda batches: _tied(batches, replicates, seed), _TIED_DDL)
    ordered = parts.repartition("g").sortWithinPartitions("g", "part", "seq")
    return ordered.mapInArrow(_wins, "g string, draws array<double>").withColumnRenamed("g", group)


def _two_intervals(pdf, names: Sequence[str]):
    """Value, lo and hi of the first draws, of the second, and of second less first."""
    import pandas as pd

    out = []
    for r in pdf.itertuples(index=False):
        a, b = np.asarray(r.a), np.asarray(r.b)
        row = [r.g]
        for x in (a, b, b - a):
            row += [float(x[0]), *_interval(x[1:])]
        out.append(row)
    return pd.DataFrame(out, columns=["g", *names])


def _paired(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    names = [f"{v}{end}" for v in ("first", "second", "difference") for end in ("", "_lo", "_hi")]
    both = a.select(F.col(group).alias("g"), F.col("draws").alias("a")).join(b.select(F.col(group).alias("g"), F.col("draws").alias("b")), "g")
    out = both.mapInPandas(lambda it: (_two_intervals(pdf, names) for pdf in it), "g string, " + ", ".join(f"{n} double" for n in names))
    return out.withColumnRenamed("g", group)


def paired_auroc(rows: DataFrame, group: str, first: Column, second: Column, label: Column, id_col: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(group, first, first_lo, first_hi, second.., difference..): the AUROCs of two scores of the same rows and their
    difference, with percentile intervals; rows are resampled together. Rows with a null take no part.
    """
    whole = rows.where(first.isNotNull() & second.isNotNull() & label.isNotNull())
    return _paired(*[auroc_draws(whole, group, s, label, id_col, replicates, seed) for s in (first, second)], group)


def _totals(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(g, part, w, e): weights and weighted errors of each group in this task."""
    held: list = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"g": held[0], "part": held[1], "w": held[2].tolist(), "e": held[3].tolist()}], schema=_TOTALS)

    for x in _pieces(batches):
        if held and (x["g"][0], int(x["part"][0])) != (held[0], held[1]):
            yield out()
            held = []
        w = np.concatenate([np.ones((len(x["id"]), 1)), weights(x["id"], replicates, seed)], axis=1)
        sums = w.sum(axis=0), (w * x["bad"][:, None]).sum(axis=0)
        held = [held[0], held[1], held[2] + sums[0], held[3] + sums[1]] if held else [x["g"][0], int(x["part"][0]), *sums]
    if held:
        yield out()


_TOTALS = pa.schema([("g", pa.string()), ("part", pa.int64()), ("w", pa.list_(pa.float64())), ("e", pa.list_(pa.float64()))])


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies before each part of a group; parts in order."""
    at, w, e = None, None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["g"] != at:
                at, w, e = r["g"], np.zeros(len(r["w"])), np.zeros(len(r["w"]))
            out.append({"g": at, "part": r["part"], "w": w.tolist(), "e": e.tolist()})
            w, e = w + r["w"], e + r["e"]
        yield pa.RecordBatch.from_pylist(out, schema=_TOTALS)


def _risks(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows by (g, part, k), led by one with what lies before the part: (g, area, w), sums of risks and of weights."""
    at, k, e, area, total = None, None, None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"g": at[0], "area": area.tolist(), "w": total.tolist()}], schema=pa.schema([("g", pa.string()), ("area", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))]))

    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        g, part, place, ids, bad = (cols[c].to_numpy(zero_copy_only=False) for c in ("g", "part", "place", "id", "bad"))
        heads = np.flatnonzero(place == 0).tolist()
        for a, b in zip([0, *heads], [*heads, len(g)]):
            if a < b and place[a] == 0:
                if at is not None:
                    yield out()
                at, k, e = (g[a], part[a]), np.array(cols["w"][a].as_py()), np.array(cols["e"][a].as_py())
                area, total, a = np.zeros(len(k)), np.zeros(len(k)), a + 1
            for s in range(a, b, ROWS):
                t = min(b, s + ROWS)
                w = np.concatenate([np.ones((t - s, 1)), weights(ids[s:t], replicates, seed)], axis=1)
                wrong = w * bad[s:t, None]
                before, errors = k + np.cumsum(w, axis=0) - w, e + np.cumsum(wrong, axis=0) - wrong
                for j in range(1, int(w.max(initial=0)) + 1):  # a row of weight w stands w times in a row
                    area += np.where(w >= j, (errors + bad[s:t, None] * j) / (before + j), 0).sum(axis=0)
                k, e, total = k + w.sum(axis=0), e + wrong.sum(axis=0), total + w.sum(axis=0)
    if at is not None:
        yield out()


def aurc_draws(rows: DataFrame, group: str, confidence: Column, correct: Column, id_col: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(group, draws): the mean risk over all coverages, of all rows, then of each replicate; the surest rows come first, ties
    by id. Sorted by ranges once; each task starts from what the tasks before it add up to.
    """
    x = rows.select(F.col(group).cast("string").alias("g"), (-confidence.cast("double")).alias("key"), F.col(id_col).alias("tie"), F.xxhash64(id_col).alias("id"), (~correct.cast("boolean")).cast("double").alias("bad")).dropna(subset=["g", "key", "bad"])
    x = x.repartitionByRange("g", "key", "tie").sortWithinPartitions("g", "key", "tie")
    x = written(x.select("g", F.spark_partition_id().cast("long").alias("part"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).alias("place"), "id", "bad"))
    # rows of a part stay in their order: place is their number in it
    per_part = x.repartition("g", "part").sortWithinPartitions("g", "part", "place").select("g", "part", "id", "bad")
    sums = per_part.mapInArrow(lambda batches: _totals(batches, replicates, seed), "g string, part long, w array<double>, e array<double>")
    heads = sums.repartition("g").sortWithinPartitions("g", "part").mapInArrow(_offsets, "g string, part long, w array<double>, e array<double>")
    none = F.lit(None).cast("array<double>")
    led = x.select("g", "part", "place", "id", "bad", none.alias("w"), none.alias("e")).unionByName(heads.select("g", "part", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("bad"), "w", "e"))
    led = led.repartition("g", "part").sortWithinPartitions("g", "part", "place")
    areas = led.mapInArrow(lambda batches: _risks(batches, replicates, seed), "g string, area array<double>, w array<double>")
    each = areas.select("g", F.posexplode(F.arrays_zip("area", "w")).alias("r", "x")).groupBy("g", "r").agg(F.sum("x.area").alias("area"), F.sum("x.w").alias("w"))
    value = F.coalesce(F.try_divide("area", "w"), F.lit(0.0))
    draws = each.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", value.alias("v")))), lambda s: s["v"]).alias("draws"))  # one entry a replicate
    return draws.withColumnRenamed("g", group)


def paired_aurc(rows: DataFrame, group: str, first: tuple[Column, Column], second: tuple[Column, Column], id_col: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """first and second: (confidence, correct) of two runs over the same rows. (group, first.., second.., difference..,
    significant): significant if the whole interval of the difference lies below 0.
    """
    whole = rows.where(first[0].isNotNull() & second[0].isNotNull())
    draws = [aurc_draws(whole, group, c, F.coalesce(ok, F.lit(False)), id_col, replicates, seed) for c, ok in (first, second)]
    return _paired(*draws, group).withColumn("significant", F.col("difference_hi") < 0)


def pooled_did(counts: DataFrame, model: str, stratum: str, cells: Sequence[str], first: str, second: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(estimate, lo, hi, models): the gain in stratum first less that in second, resampled within each model and stratum,
    averaged over models in each replicate; the estimate is the mean of the replicates. counts: a row per model and
    stratum with cells (both, first run only, second run only, neither). Models without rows in either stratum have no
    gain to compare and are left out.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf[model].iloc[0])
        rng, did = np.random.default_rng([seed, zlib.crc32(name.encode())]), np.zeros(replicates)
        for sign, s in ((1, first), (-1, second)):
            n = pdf.loc[pdf[stratum].astype(str) == s, list(cells)].to_numpy(np.int64).sum(axis=0)
            if not n.sum():
                return pd.DataFrame({"r": np.zeros(0, np.int64), "did": np.zeros(0)})
            did += sign * gain(rng.multinomial(n.sum(), n / n.sum(), replicates))
        return pd.DataFrame({"r": np.arange(replicates), "did": did})

    draws = counts.select(model, stratum, *cells).groupBy(model).applyInPandas(run, "r long, did double")
    pooled = draws.groupBy("r").agg(F.avg("did").alias("did"), F.count("*").alias("models"))
    place = lambda q: F.get(F.sort_array(F.collect_list("did")), F.lit(min(int(q * replicates), replicates - 1)))
    return pooled.agg(F.round(F.avg("did"), 4).alias("estimate"), F.round(place(0.025), 4).alias("lo"), F.round(place(0.975), 4).alias("hi"), F.max("models").alias("models"))


def bootstrap_auroc(spark, sf):
    p = _view(spark, sf, "pairs")
    return paired_auroc(p, "split", 1 - F.col("ca"), 1 - F.col("cb"), F.col("should_abstain"), "qid")


def bootstrap_aurc(spark, sf):
    p = _view(spark, sf, "pairs").where("NOT should_abstain")
    return paired_aurc(p, "split", (F.col("ca"), F.col("sa")), (F.col("cb"), F.col("sb")), "qid")


def pooled_did_query(spark, sf):
    """Each other model's gain over m0 on questions whose gold passage was retrieved, less its gain on the others."""
    a = _view(spark, sf, "answerable")
    base = a.where("model = 'm0'").select("qid", F.col("strict").alias("sa"))
    hit = _view(spark, sf, "ranked").groupBy("qid").agg(F.bool_or(F.expr("relevant AND dense_rank <= 5")).alias("hit"))
    x = a.where("model <> 'm0'").join(base, "qid").join(hit, "qid", "left").withColumn("place", F.when(F.coalesce("hit", F.lit(False)), "in").otherwise("out"))
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    cells = x.groupBy("model", "place").agg(n("sa AND strict", "both"), n("sa AND NOT strict", "only_a"), n("strict AND NOT sa", "only_b"), n("NOT sa AND NOT strict", "neither"))
    return pooled_did(cells, "model", "place", ("both", "only_a", "only_b", "neither"), "in", "out")


QUERIES = {k: (f, None) for k, f in {"bootstrap_auroc": bootstrap_auroc, "bootstrap_aurc": bootstrap_aurc, "pooled_did": pooled_did_query}.items()}
