"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 2 bits of some 48, whichever of four 16-bit
blocks is left out (the one with the most differing bits). For each of the four choices every distinct fingerprint emits
the 49 variants of those 48 bits within half of that radius, 1 bit; fingerprints 2 bits apart there meet in a variant.
196 rows a fingerprint do what balls on all 64 bits would need 2,081 + 65 rows for, and 48-bit keys keep chance
meetings rare far beyond a billion fingerprints. A bucket holds at most 49 x 65,536 distinct fingerprints, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import connected_components

RADIUS, BLOCK, BLOCKS = 3, 16, 4
SEED = 42
#: Buckets of more members are linked through tables of the 65,536 values of the block left out.
DENSE = 1024


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned. Words [^ \\t-\\r]+ with A-Z lowered; shingles of so many words, repeats included; none: 0."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(ws) > words:
        starts, ends = starts[: len(ws) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        votes += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): fp is the fingerprint's bits as a signed long. A null or empty text has fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], ["_id", "fp"])

    return rows.mapInArrow(run, "_id long, fp long").withColumnRenamed("_id", id_col)


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp) of distinct fingerprints: 4 x 49 rows each. The key holds the 48 bits and, above, the block left out."""
    fp = F.col("fp")
    bases = []
    for p in range(BLOCKS):
        low = BLOCK * p
        kept = fp.bitwiseAND(F.lit((1 << low) - 1))
        if p < BLOCKS - 1:
            kept = kept.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low + BLOCK), low))
        bases.append(kept.bitwiseOR(F.lit(p << 48)))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << j).cast("long") for j in range(48)])
    wide = fps.select("fp", F.explode(F.array(*bases)).alias("base")).select("fp", "base", F.explode(flips).alias("flip"))
    return wide.select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """fps: column fp, each value once. Returns pairs (a, b) at most 3 bits apart that connect all fingerprints which
    links connect: within a bucket a spanning forest of its verified links, not every pair.
    """
    return variants(fps).repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id: least id_col that links reach).

    Nulls and empty texts have fingerprint zero and are linked like any other; rows with a null id get their group's
    component_id; repeated rows stay. An empty table gives an empty result. Other columns are not looked at.
    """
    fp = written(fingerprints(docs, id_col, text_col, words))
    firsts = fp.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = connected_components(links(firsts.select("fp")))
    # a class is named by the least fingerprint reached; its documents' least id names the group
    own = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    named = own.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fp.join(named, F.col("fp") == F.col("_fp")).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _compact(fp: np.ndarray, p: int) -> np.ndarray:
    low = np.uint64(BLOCK * p)
    kept = fp & np.uint64((1 << (BLOCK * p)) - 1)
    return kept if p == BLOCKS - 1 else kept | ((fp >> (low + np.uint64(BLOCK))) << low)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; the last key of a batch is carried over to the next."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        k, f = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        if len(keys) and keys[0] == k[0] == k[-1]:  # still the same bucket
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            continue
        k, f = np.concatenate([keys, k]), np.concatenate([fps, f])
        cut = int(np.searchsorted(k, k[-1]))
        yield _buckets(k[:cut], f[:cut])
        keys, fps = k[cut:], f[cut:]
    yield _buckets(keys, fps)


def _buckets(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(k):
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        two = starts[sizes == 2]
        near = np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= RADIUS
        a.append(f[two[near]])
        b.append(f[two[near] + 1])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x = f[s : s + n]
            root = _forest(x.view(np.uint64)) if n <= DENSE else _dense(int(k[s]), x.view(np.uint64))
            a.append(x[root != np.arange(n)])
            b.append(x[root[root != np.arange(n)]])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
    return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def _forest(x: np.ndarray) -> np.ndarray:
    """For each member the member that links to it in a spanning forest, or itself."""
    parent = np.arange(len(x))
    rest = np.arange(len(x))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            i, front = front[0], front[1:]
            near = np.bitwise_count(x[rest] ^ x[i]) <= RADIUS
            parent[rest[near]] = i
            front, rest = np.concatenate([front, rest[near]]), rest[~near]
    return parent


def _dense(key: int, x: np.ndarray) -> np.ndarray:
    """As _forest, in time linear in the members. With d the distance of the 48 bits from the key (0 or 1), y the block
    left out: equal y and d = 1 link; d = 1 on both sides links at 1 bit of y; d = 0 and 1 at 2 bits; d = 0 on both at 3.
    Same 48 bits and d = 1 with 2 or 3 bits of y are linked in the bucket whose key those 48 bits are.
    """
    n, p = len(x), key >> 48
    y = ((x >> np.uint64(BLOCK * p)) & np.uint64(0xFFFF)).astype(np.int64)
    zero = _compact(x, p) == np.uint64(key & ((1 << 48) - 1))
    at = {True: np.full(1 << BLOCK, -1), False: np.full(1 << BLOCK, -1)}  # member by y, for d = 0 and for d = 1
    parts = {z: np.flatnonzero(zero == z) for z in (True, False)}
    pairs = []
    for z in (True, False):
        at[z][y[parts[z]][::-1]] = parts[z][::-1]
    ones = parts[False]
    pairs.append((ones, at[False][y[ones]]))
    reps = np.unique(at[False][y[ones]])
    masks = [[sum(1 << i for i in c) for c in combinations(range(BLOCK), r)] for r in range(4)]
    for who, table, most in ((reps, at[False], 1), (parts[True], at[False], 2), (parts[True], at[True], 3)):
        for r in range(most + 1):
            for m in masks[r]:
                other = table[y[who] ^ m]
                pairs.append((who[other >= 0], other[other >= 0]))
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = np.arange(n)
    for i, j in pairs:
        far = np.flatnonzero(parent[i] != parent[j])
        for s, t in zip(i[far].tolist(), j[far].tolist()):
            s, t = find(s), find(t)
            if s != t:
                parent[max(s, t)] = min(s, t)
    for i in range(n):
        tree[i] = find(i)
    return tree
