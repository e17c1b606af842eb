"""Document fingerprints by a randomised edit embedding.

All texts take the same random walk: at step j a character c is written out, and random bit (j, c) tells whether the walk
moves on to the next character. Two texts some edits apart soon walk in step again, so the Hamming distance of what they
write follows their edit distance. A fingerprint samples the embedding at shared steps: for each of its cells the step
with the least shared random number among all steps taken, so that texts of like length sample the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, slices, written
from .components import connected_components

CELLS, PERIOD, CLASSES, GRAM = 128, 1024, 256, 4
SEED = 20240229
#: Bands of cells, and how many fingerprints of a band one task compares all with all.
BANDS, GROUP = 32, 2000
#: Bytes of text for which there is a partition of documents in order of their ids.
PART_BYTES = 32 << 20
#: How often a band is split at most: each time its fingerprints are dealt to as many bands as may differ, and one more.
LEVELS = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


class EditEmbedding:
    def __init__(self, cells: int = CELLS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (CLASSES, PERIOD)).astype(bool)
        bits[:, rng.integers(0, PERIOD)] = True
        numbers = list(range(PERIOD))
        self.rows = []
        for b in bits:
            ones = np.flatnonzero(b)
            at = np.searchsorted(ones, np.arange(PERIOD))
            nxt = np.append(ones, ones[0] + PERIOD)[at] + 1  # the step at which the next character begins
            self.rows.append([numbers[t % PERIOD] for t in nxt.tolist()])
        # steps at which the least of a cell's random numbers falls again: r, then r / U, as for independent draws
        self.records = np.full((cells, 128), np.iinfo(np.int64).max)
        for k in range(cells):
            r, i = 1.0, 0
            while r < 2**45 and i < 128:
                self.records[k, i] = int(r)
                r, i = np.floor(r / rng.random()) + 1, i + 1
        self.cells = cells
        self.salt = rng.integers(1, 2**63, cells).astype(np.uint64)

    def walk(self, codes: np.ndarray, at: int = 0) -> np.ndarray:
        """The step after each character, from step at on. codes: code points."""
        t, out = at % PERIOD, []
        put, rows = out.append, self.rows
        for c in ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes():
            t = rows[c][t]
            put(t)
        steps = np.diff(np.array(out, np.int64), prepend=at % PERIOD) % PERIOD
        steps[steps == 0] = PERIOD
        return at + np.cumsum(steps)

    def sample(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A byte (1 to 255) per cell; all 0 for an empty text."""
        if not len(codes):
            return np.zeros(self.cells, np.uint8)
        taken = int(ends[-1])
        p = self.records[np.arange(self.cells), (self.records <= taken).sum(axis=1) - 1]
        i = np.searchsorted(ends, p)  # the character that is written at step p
        h = self.salt + p.astype(np.uint64) * _MIX
        for g in range(GRAM):
            c = np.where(i + g < len(codes), codes[np.minimum(i + g, len(codes) - 1)], 0).astype(np.uint64)
            h = (h ^ (c + np.uint64(g))) * _MIX
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(40)).astype(np.uint64).astype(np.int64).__mod__(255).astype(np.uint8) + np.uint8(1)

    def fingerprint(self, text: str | None) -> np.ndarray:
        codes = code_points(text)
        return self.sample(codes, self.walk(codes))


@lru_cache(maxsize=2)
def embedding(cells: int = CELLS, seed: int = SEED) -> EditEmbedding:
    return EditEmbedding(cells, seed)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal cells, less what chance gives: 0 to 1."""
    same = float(np.mean(a == b))
    return max(0.0, (same - 1 / 255) / (1 - 1 / 255))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint as hex). A null text is an empty one; equal texts have equal fingerprints."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = embedding()
        for b in slices(batches, "_text"):
            yield pa.record_batch([b.column(0), pa.array([e.fingerprint(t).tobytes().hex() for t in b.column(1).to_pylist()], pa.string())], ["_id", "fingerprint"])

    return rows.mapInArrow(run, "_id long, fingerprint string").withColumnRenamed("_id", id_col)


def _near(a: str, b: str) -> Column:
    same = sum((F.substring(a, 2 * c + 1, 2) == F.substring(b, 2 * c + 1, 2)).cast("int") for c in range(CELLS))
    return F.greatest(F.lit(0.0), (same / CELLS - 1 / 255) / (1 - 1 / 255))


def _compare(far: int) -> Callable[[pa.Table], pa.Table]:
    """Compares the members of a group, all with all; links that connect what all its links connect."""

    def run(group: pa.Table) -> pa.Table:
        names = group.column("fingerprint").unique().to_pylist()
        cells = np.frombuffer(bytes.fromhex("".join(names)), np.uint8).reshape(len(names), CELLS)
        root, a, b, same = np.arange(len(names)), [], [], []
        for i in range(len(names) - 1):
            other = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            agree = (cells[other] == cells[i]).sum(axis=1)
            for k in np.flatnonzero(agree >= CELLS - far).tolist():
                j = int(other[k])
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    a.append(names[i])
                    b.append(names[j])
                    same.append(int(agree[k]))
        near = np.maximum(0.0, (np.array(same, float) / CELLS - 1 / 255) / (1 - 1 / 255))
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "near": near})

    return run


def near_pairs(fps: DataFrame, least: float = 0.8, group: int = GROUP, used: list[str] | None = None) -> DataFrame:
    """Bit-sampled banding with verification: (a, b, near) for distinct fingerprints, pairs whose chains connect all that are
    at least so like. Nothing is lost: two such fingerprints agree on all but as many of the disjoint bands as cells in which
    they may differ, so that one band more than that holds all such pairs.

    A band's members are compared with its least one. Where some are far from it, a band of up to `group` members is
    compared all with all in one task; a larger one is split once by a further band, and what is still larger then is
    compared block by block, which takes quadratic time. So no group of one task holds more than two blocks. used gets
    the folders of tables that the result reads.
    """

    def table(df: DataFrame) -> DataFrame:
        path = shared_dir(df.sparkSession)
        if used is not None:
            used.append(path)
        return written(df, path)

    far = max((d for d in range(CELLS) if (1 - d / CELLS - 1 / 255) / (1 - 1 / 255) >= least), default=-1)
    if not 0 <= far < CELLS - 1:
        raise ValueError("least must be above 0 and at most 1")
    n = max(BANDS, far + 1)
    levels, tried = min(LEVELS, n - far), far + 1
    deal = [sorted(c.tolist()) for c in np.array_split(np.random.default_rng(SEED + 1).permutation(CELLS), n)]
    hashes = F.array(*[F.xxhash64(F.lit(k), *[F.substring("fingerprint", 2 * c + 1, 2) for c in cs]) for k, cs in enumerate(deal)])
    one = table(fps.select("fingerprint").where("fingerprint IS NOT NULL").distinct().withColumn("_f", F.xxhash64("fingerprint")))
    banded = one.select("_f", F.explode(F.slice(F.transform(hashes, lambda h, k: F.struct(h.alias("key"), F.array(k).alias("used"))), 1, tried)).alias("x")).select("_f", "x.*")
    met = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    now = banded.join(met, "key").join(one, "_f").select("key", "used", "fingerprint")
    found, small = [], []
    for depth in range(1, levels + 1):
        now = table(now)
        firsts = now.groupBy("key").agg(F.min("fingerprint").alias("first"))
        checked = table(now.join(firsts, "key").select("key", "used", "fingerprint", "first", _near("first", "fingerprint").alias("near")))
        found.append(checked.where(F.col("near") >= least).where("fingerprint <> first").select(F.col("first").alias("a"), F.col("fingerprint").alias("b"), "near"))
        mixed = checked.groupBy("key").agg(F.count("*").alias("n"), F.min("near").alias("least")).where(F.col("least") < least).select("key", "n")
        rest = checked.join(mixed, "key")
        small.append(rest.where(F.col("n") <= group).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fingerprint"))
        large = rest.where(F.col("n") > group)
        if large.isEmpty():
            break
        if depth < levels:
            others = F.slice(F.filter(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))), lambda x: ~F.array_contains("used", x.k)), 1, tried)
            split = large.select("key", "used", "fingerprint", F.explode(others).alias("x")).select(F.xxhash64("key", "x.h").alias("key"), F.concat("used", F.array("x.k")).alias("used"), "fingerprint")
            now = split.join(split.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key")
        else:
            blocks = F.ceil(2 * F.col("n") / group).cast("int")
            own = large.select("key", "fingerprint", blocks.alias("blocks")).withColumn("at", F.pmod(F.xxhash64("fingerprint", F.lit("block")), F.col("blocks")).cast("int"))
            small.append(own.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"), "at", "fingerprint").select("key", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "fingerprint"))
    groups = reduce(DataFrame.unionByName, small).groupBy("key", "i", "j")
    return reduce(DataFrame.unionByName, [*found, groups.applyInArrow(_compare(far), "a string, b string, near double")]).distinct()


def with_components(rows: DataFrame, id_col: str, fp_col: str = "fingerprint", least: float = 0.8) -> DataFrame:
    """rows with component_id: the least id that links of fingerprints at least so like reach, itself included. Rows of one
    fingerprint are linked; a null id keeps its row, without counting as the least. rows are read several times.
    """
    fps = rows.select(F.col(fp_col).alias("fingerprint"))
    used: list[str] = []
    roots = connected_components(near_pairs(fps, least, used=used)).select(F.col("node").alias("_node"), "root")
    discard(rows.sparkSession, *used)
    least_id = rows.groupBy(F.col(fp_col).alias("_node")).agg(F.min(id_col).alias("_least")).join(roots, "_node", "left")
    least_id = written(least_id.select("_node", F.coalesce("root", "_node").alias("_root"), "_least"))
    of_root = least_id.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = least_id.join(of_root, "_root").select("_node", "component_id")
    return rows.join(named, F.col(fp_col) == F.col("_node")).drop("_node")


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id): the least id that links of fingerprints at least so like reach, itself included.
    Equal texts are linked; a null text is an empty one; a null id keeps its row, without counting as the least.
    """
    return with_components(written(fingerprints(docs, id_col, text_col)), id_col, least=least)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (_p, _more, _has, _id, _hash, _text) dealt and sorted so that each document stands before the next one in descending
    id (nulls last, which _has tells; equal ids by hash), the first standing after the last. _more marks a copy of the row
    that comes after a partition's last; nothing but these copies and bounds of as many values as partitions is gathered.
    There is a partition for each part_bytes of text, and a task for each partition.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // part_bytes))
    own = F.col(id_col).cast("long")
    rows = docs.select(own.isNotNull().alias("_has"), F.coalesce(own, F.lit(-(1 << 63))).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    cuts = docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts})
    p = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= F.col("_id"))) if bounds else F.lit(0)
    rows = rows.select(p.alias("_p"), F.lit(False).alias("_more"), "_has", "_id", "_hash", "_text")
    heads = sorted(tuple(r) for r in rows.groupBy("_p").agg(F.max(F.struct("_has", "_id", "_hash")).alias("m")).select("_p", "m.*").collect())
    if not heads:
        return rows
    after = [(heads[k - 1][0], *heads[k - 1][1:], heads[k][0]) for k in range(len(heads))]  # the head of each is next for the partition above; k = 0: wraps round
    small = spark.createDataFrame(after, "_q int, _there boolean, _i long, _h long, _to int")
    small = F.broadcast(small)  # at most a row for each partition
    more = rows.join(small, (rows._p == small._q) & (rows._has == small._there) & (rows._id == small._i) & (rows._hash == small._h)).select(F.col("_to").alias("_p"), F.lit(True).alias("_more"), "_has", "_id", "_hash", "_text")
    both = rows.unionByName(more)
    return both.repartitionById(parts, "_p").sortWithinPartitions("_p", "_more", F.desc("_has"), F.desc("_id"), F.desc("_hash"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last half of its code points replaced by as many
    of the next document's first), and how like they are to it: (id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next). A null text is empty; a null id stays null; repeated rows stay.
    """
    import hashlib

    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, held = embedding(), None
        for b in slices(batches, "_text"):
            out = []
            for p, more, has, i, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 5))):
                text, i = text or "", i if has else None
                codes = code_points(text)
                ends = e.walk(codes)
                now = (p, more, i, text, codes, ends, e.sample(codes, ends))
                if held is not None and held[0] == p and not held[1]:
                    _, _, own, own_text, c, t, fp = held
                    n = len(c)
                    keep = n - n // 2
                    edited = np.concatenate([c[:keep], codes[: n // 2]])
                    tail = e.walk(edited[keep:], int(t[keep - 1])) if keep else t[:0]
                    efp = e.sample(edited, np.concatenate([t[:keep], tail]))
                    digest = hashlib.sha256((own_text[:keep] + text[: n // 2]).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own, n, digest, fp.tobytes().hex(), efp.tobytes().hex(), likeness(fp, efp), likeness(fp, now[6])))
                held = now
            if out:
                yield pa.record_batch([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(map(list, zip(*out)))], names)

    schema = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
