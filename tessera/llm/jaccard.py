"""Near-duplicates of five-word shingles by SimHash: its balls propose pairs, and exact Jaccard similarity decides.

Sets that share 0.8 are often more than three bits apart, so a prefix filter finds what the balls leave: all pairs of 0.8
or more, whatever their fingerprints.

Shingles of all documents have one order. Two sets of n and m shingles that share LEAST of their union share at least
o = ceil(LEAST / (1 + LEAST) * (n + m)), so the first that they share stands before the last o - 1 of both: sets meet in
a bucket of one of their first shingles, and no pair is missed. Shingles that are frequent in a sample come last in the
order; the sample decides how many pairs are looked at, never which are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, slices, table_path, written
from .components import connected_components
from .simhash import fingerprint
from .simhash import links as ball_links

#: Words of a shingle; the least similarity, as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Documents and shingles that the order is taken from at most; any order gives the same result.
SAMPLE, FREQUENT = 10_000, 100_000
#: Places in a bucket up to which a set's likest neighbour is looked for, and rounds of that after the first. They decide
#: how many pairs the last round is left with, never which are found.
NEIGHBOURS, ROUNDS = 48, 2
#: Stretches of hashes in the signatures that rows of buckets carry.
COLUMNS = 64
#: Values of the hash by which sets that no pair needs are left out before the join.
BITS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, sorted. Words [^ \\t-\\r]+ with A-Z lowered; fewer words than asked make one shingle; none: none."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    k = min(words, len(ws))
    h = np.full(len(ws) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ own[i : i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least number of shared shingles of near sets of these sizes."""
    a, b = LEAST
    return -(-a * (n + m) // (a + b))


LOWEST = -(1 << 63)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text); a null id is the least number."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def _set_hash(shingled: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingled.tobytes())


def signature(shingled: np.ndarray) -> bytes:
    """How many shingles fall to each of 2**k stretches of the hashes, a byte each; at most about four a stretch, COLUMNS
    stretches at least.
    """
    k = max(COLUMNS.bit_length() - 1, int(len(shingled)).bit_length() - 2)
    counts = np.bincount((shingled >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def folded(sig: bytes) -> bytes:
    """A signature of COLUMNS stretches, by which the rows of a bucket are compared at once."""
    if not sig:
        return b"\xff" * COLUMNS
    return np.minimum(np.frombuffer(sig, np.uint8).reshape(COLUMNS, -1).sum(axis=1), 255).astype(np.uint8).tobytes()


def may_share(x: bytes, y: bytes) -> float:
    """More shingles than sets of these signatures can share there are none."""
    if not x or not y:
        return float("inf")
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.minimum(a, b.reshape(len(a), -1).sum(axis=1)).sum())


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(_id, tag, fp, sim, n, sig, few) of each row: hashes of the text and of its set of shingles, its SimHash, the set's
    size, its signature, and that folded.
    """
    rows = _rows(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("tag"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            texts = b.column(2).to_pylist()
            own = [shingles(t, words) for t in texts]
            fp = np.array([_set_hash(x) for x in own], np.uint64).view(np.int64)
            sim = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            size, sigs = pa.array(map(len, own), pa.int64()), list(map(signature, own))
            few = pa.array(map(folded, sigs), pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp), pa.array(sim), size, pa.array(sigs, pa.binary()), few], ["_id", "tag", "fp", "sim", "n", "sig", "few"])

    return rows.mapInArrow(run, "_id long, tag long, fp long, sim long, n long, sig binary, few binary")


def sets(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(fp, set) of _rows(): of equal sets that a task meets only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in slices(batches, "_text"):
            fps, lists = [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, words)
                fp = _set_hash(s)
                if fp not in seen:
                    seen.add(fp)
                    fps.append(fp)
                    lists.append(s.view(np.int64))
            yield pa.record_batch([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], ["fp", "set"])

    return rows.mapInArrow(run, "fp long, set array<long>")


def frequent(rows: DataFrame, total: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several documents of a sample, sorted, and how many have each."""
    share = int((1 << 20) * min(1.0, SAMPLE / max(total, 1)))
    some = sets(rows.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) < share), words).select(F.explode("set").alias("h"))
    got = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = got.column("h").to_numpy(), got.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def prefixes(rows: DataFrame, known: np.ndarray, counts: np.ndarray, words: int = WORDS) -> DataFrame:
    """(key, place, fp): the first shingles of each set, and in place the set's size (above) and the shingle's place in it."""
    a, b = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # one Python step, not two in a row: each would keep a worker of its own
        for batch in slices(batches, "_text"):
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            for t in batch.column(1).to_pylist():
                own = shingles(t, words)
                fp, n = _set_hash(own), len(own)
                if not n or fp in seen:
                    continue
                seen.add(fp)
                h = own.view(np.int64)
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, counts[at], 0)
                first = h[np.lexsort((h, rank))[: n - -(-a * n // b) + 1]]
                for col, x in zip(out, (first, n << 32 | np.arange(len(first)), np.full(len(first), np.uint64(fp).view(np.int64)))):
                    col.append(x)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["key", "place", "fp"])

    return rows.mapInArrow(run, "key long, place long, fp long")


def _column(c: pa.Array) -> np.ndarray:
    """Folded signatures as a matrix, numbers as they are."""
    return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COLUMNS) if pa.types.is_binary(c.type) else c.to_numpy()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets: batches sorted by key, the last key of a batch is carried over."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [_column(c) for c in b.columns]
        if not len(cols[0]):
            continue
        if held and held[0][0][0] == cols[0][-1]:  # still the same bucket
            held.append(cols)
            continue
        cols = [np.concatenate(c) for c in zip(*held, cols)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [c[:cut] for c in cols]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets of several sets, each once."""
    for key, place, fp in _buckets(batches):
        new = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
        key, place, fp = key[new], place[new], fp[new]
        same = key[1:] == key[:-1]
        keep = np.append(same, False) | np.append(False, same)
        yield pa.record_batch([pa.array(c[keep]) for c in (key, place >> 32, place & 0xFFFFFFFF, fp)], ["key", "n", "pos", "fp"])


def _pairs(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, room) of a bucket that may be near and have different roots: for each b the a that leaves the most room,
    of those up to most places before it in order of size; or, without most, every such pair, the least first.
    """
    p, q = LEAST
    for key, n, pos, fp, root, few in _buckets(batches):
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        keep = np.repeat(mixed, np.diff(np.append(starts, len(key))))
        key, n, pos, fp, root, few = key[keep], n[keep], pos[keep], fp[keep], root[keep], few[keep]
        full = few.max(axis=1, initial=0) == 255  # not told
        best, which = np.zeros(len(key)), np.full(len(key), -1)
        i, d = np.arange(len(key)), 1
        while len(i) and (most is None or d <= most):
            i = i[i + d < len(key)]
            i = i[(key[i] == key[i + d]) & (p * n[i + d] <= q * n[i])]  # sorted by key and n: what fails fails further on
            j = i + d
            ok = (root[i] != root[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= overlap(n[i], n[j]))
            i_ok, j_ok = i[ok], j[ok]
            for at in range(0, len(i_ok), 1 << 16):
                x, y = i_ok[at : at + (1 << 16)], j_ok[at : at + (1 << 16)]
                room = np.minimum(few[x], few[y]).sum(axis=1, dtype=np.int64) / overlap(n[x], n[y])
                room[full[x] | full[y]] = 1
                x, y, room = x[room >= 1], y[room >= 1], room[room >= 1]
                if most is not None:
                    more = room > best[y]
                    best[y[more]], which[y[more]] = room[more], x[more]
                elif len(x):
                    yield pa.record_batch([pa.array(np.minimum(fp[x], fp[y])), pa.array(np.maximum(fp[x], fp[y])), pa.array(room)], ["a", "b", "room"])
            d += 1
        own = np.flatnonzero(which >= 0)
        if len(own):
            yield pa.record_batch([pa.array(fp[which[own]]), pa.array(fp[own]), pa.array(best[own])], ["a", "b", "room"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for s, t in zip(batch.column(2), batch.column(3)):
            x, y = s.values.to_numpy(), t.values.to_numpy()
            keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= overlap(len(x), len(y)))
        yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures leave room for a near pair."""
    for batch in batches:
        a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
        keep = [may_share(p, q) >= int(overlap(k, j)) for k, j, p, q in zip(n, m, x, y)]
        yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, own: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of fps whose sets are near. Signatures rule most others out; only texts that a pair needs are read
    into sets. own: fp, n, sig, and first (an id of a row with that set).
    """
    side = lambda x, n, s: own.select(F.col("fp").alias(x), F.col("n").alias(n), F.col("sig").alias(s))
    both = pairs.distinct().join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    pairs = written(both.mapInArrow(_maybe, "a long, b long"))
    need = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    ids = written(need.join(own, "fp").select("first").distinct())
    bits = F.broadcast(ids.select(F.pmod(F.xxhash64("first"), F.lit(BITS)).alias("bit")).distinct())  # BITS rows at most
    maybe = rows.join(bits, F.pmod(F.xxhash64("_id"), F.lit(BITS)) == bits.bit, "left_semi")
    some = written(sets(maybe.join(ids, maybe["_id"] == ids["first"], "left_semi"), words))
    both = pairs.join(some.select(F.col("fp").alias("a"), F.col("set").alias("s")), "a").join(some.select(F.col("fp").alias("b"), F.col("set").alias("t")), "b")
    near = written(both.select("a", "b", "s", "t").mapInArrow(_near, "a long, b long"))
    discard(rows.sparkSession, *map(table_path, (pairs, ids, some)))
    return near


def proposed(sims: DataFrame) -> DataFrame:
    """Pairs (a, b) of fps that SimHash's balls bring together (simhash.links()), and of those with one SimHash."""
    least = sims.groupBy("sim").agg(F.min("fp").alias("of"))
    same = sims.join(least, "sim").where("fp <> of").select(F.least("fp", "of").alias("a"), F.greatest("fp", "of").alias("b"))
    x, y = least.select(F.col("sim").alias("a"), F.col("of").alias("x")), least.select(F.col("sim").alias("b"), F.col("of").alias("y"))
    near = ball_links(least.select(F.col("sim").alias("fp"))).join(x, "a").join(y, "b")
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def links(own: DataFrame, sims: DataFrame, rows: DataFrame, total: int, words: int = WORDS) -> DataFrame:
    """Near pairs that connect all sets which near pairs connect. own: fp, n, sig, first, a row for each set; sims: fp, sim.

    Verified first are the pairs that SimHash proposes and, for each set, the likest of its neighbours in the buckets; so a
    group of near copies is connected in pairs as many as its members. ROUNDS more for what these links leave apart; then
    every pair of a bucket that is still apart and whose signatures leave room, so that no link
    is lost.
    """
    order = ["key", "n", "fp"]
    pre = prefixes(rows, *frequent(rows, total, words), words).repartition("key").sortWithinPartitions("key", "fp")
    pre = written(pre.mapInArrow(_shared, "key long, n long, pos long, fp long"))

    def paired(near: DataFrame | None, most: int | None) -> DataFrame:
        if near is None:
            df = pre.withColumn("root", F.col("fp"))
        else:
            roots = connected_components(near)
            df = pre.join(roots, pre.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
        df = df.join(own.select("fp", "few"), "fp").select("key", "n", "pos", "fp", "root", "few").repartition("key").sortWithinPartitions(*order)
        return df.mapInArrow(lambda batches: _pairs(batches, most), "a long, b long, room double")

    def closest(df: DataFrame) -> DataFrame:
        return df.groupBy("b").agg(F.max(F.struct("room", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")

    near = verified(proposed(sims).unionByName(closest(paired(None, NEIGHBOURS))), own, rows, words)
    for _ in range(ROUNDS):
        near = written(near.unionByName(verified(closest(paired(near, NEIGHBOURS)), own, rows, words)))
    return near.unionByName(verified(paired(near, None).select("a", "b"), own, rows, words))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(_id, tag, root) for each row of docs: rows that links between near sets connect have one root."""
    every = written(sketches(docs, id_col, text_col, words))
    sims = written(every.select("fp", "sim").distinct())
    own = written(every.groupBy("fp").agg(F.min("_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("few").alias("few")))
    roots = connected_components(links(own, sims, _rows(docs, id_col, text_col), every.count(), words))
    return every.join(roots, every.fp == roots.node, "left").select("_id", "tag", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id_col, component_id: least id_col that links between near sets reach).

    Nulls and empty texts are copies of each other; rows with a null id get their group's component_id; repeated rows
    stay. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = classes(docs, id_col, text_col, words).withColumn("_id", F.expr(f"nullif(_id, {LOWEST + 1} - 1)"))
    least = rows.groupBy("root").agg(F.min("_id").alias("component_id"))
    return rows.join(least, "root").select(F.col("_id").alias(id_col), "component_id")


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs without near-duplicates: of each group the row of least id stays (nulls come last, ties go by a hash of the
    text), and of repeated rows one. The columns of docs stay, whatever their names. An empty table gives an empty one.
    """
    by = F.struct((F.col("_id") == LOWEST).alias("none"), F.col("_id").alias("i"), F.col("tag").alias("t"))
    first = written(classes(docs, id_col, text_col, words).groupBy("root").agg(F.min(by).alias("m")).select("m.i", "m.t"))
    i, t, j, u = (fresh(docs, c) for c in ("_i", "_t", "_j", "_u"))
    keys = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)), t: F.xxhash64(F.col(text_col).cast("string"))})
    first = first.select(F.col("i").alias(j), F.col("t").alias(u))
    kept = keys.join(first, (F.col(i) == F.col(j)) & (F.col(t) == F.col(u)), "left_semi")
    return kept.dropDuplicates([i, t]).select(*docs.columns)
