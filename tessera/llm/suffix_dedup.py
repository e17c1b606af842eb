"""Removal of bytes that lie in a 50-byte string which also starts in an earlier document.

Every 50-byte window is keyed by the least hash of its 16-byte strings, so equal windows have equal keys; a run of windows
with one key travels with its bytes (about 67 for 18 windows) to the key's shard, equal runs of a slice of the input as one.
There, keys that one document alone has are dropped and equal runs are joined. Where all runs of a key are equal, so are their
windows one by one, and the run's least document is that of each; the same holds for a run none of whose windows has the
hash of another run's. The others are sorted by external induction (induced.py); neighbours in suffix order that share 50 bytes, as the queues carried it, form the groups of equal
windows, and each group's least document is compared with every document that holds it. A shard lies in scratch files beyond
a memory limit, so it may be far larger than memory.

Runs that are found often in one slice are hot: their places stay out of the shard. They are dealt evenly instead, and joined
with what the shard found for the run, so a passage that a large share of all documents holds gathers nowhere.

Keys are dealt in PASSES passes over the input, so only a share of the windows is on disk at a time; shards are sized from
the bytes of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, slices, written
from .induced import BASE, BLOCK, IN_MEMORY, Scratch, suffix_order

LENGTH, GRAM = 50, 16
PASSES = 3
#: Bytes of text for which there is one shard in each pass, and one group of documents at the end.
SHARD_TEXT = 12 << 20
#: A run found more often in a slice is hot, or in more than an EIGHTH of its documents if these are few.
HOT, EIGHTH, FEW = 64, 8, 3
#: Bytes whose hashes are worked out together.
STRETCH = 1 << 15
#: Runs of a shard whose heads are looked at together.
HEADS = 1 << 18
#: Windows whose hashes are compared at once; where there are more, all their runs are sorted.
WINDOWS = 1 << 22
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 16-byte string."""
    m = max(0, len(raw) - GRAM + 1)
    if not m:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))
    h = words[:m] * _A
    # mixed before the second half comes in: two changed bytes, one in each half, would often cancel otherwise
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(32)
    h ^= words[8 : m + 8]
    h *= _B
    h ^= h >> np.uint64(31)
    h *= _C
    h ^= h >> np.uint64(29)
    return h


def hashes_and_keys(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gram_hashes(), and for each 50-byte window the least of those in it. Worked out in stretches that fit in a cache."""
    span = LENGTH - GRAM + 1
    grams = np.empty(max(0, len(raw) - GRAM + 1), np.uint64)
    keys = np.empty(max(0, len(raw) - LENGTH + 1), np.uint64)
    for a in range(0, len(grams), STRETCH):
        h = gram_hashes(raw[a : a + STRETCH + LENGTH - 1])
        grams[a : a + STRETCH] = h[:STRETCH]
        have = 1
        while 2 * have <= span and len(h) > have:
            h = np.minimum(h[:-have], h[have:])
            have *= 2
        more = span - have
        own = keys[a : a + STRETCH]
        if len(own):
            np.minimum(h[: len(own)], h[more : more + len(own)], out=own)
    return grams, keys


def _run_hashes(grams: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, from the hashes of 16-byte strings that cover it."""
    h = lens.astype(np.uint64)
    last = starts + lens - GRAM
    live, k = np.arange(len(starts)), 0
    while len(live):
        x = (h[live] ^ grams[np.minimum(starts[live] + k, last[live])]) * _A
        h[live] = x ^ (x >> np.uint64(32))
        k += GRAM
        live = live[lens[live] > k]
    return h


def _gather(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of the runs, one after the other."""
    ends = np.cumsum(lens)
    out = np.empty(int(ends[-1]) if len(ends) else 0, raw.dtype)
    for a in range(0, len(starts), BLOCK // 4):
        z = min(len(starts), a + BLOCK // 4)
        base = int(ends[a - 1]) if a else 0
        at = np.repeat(starts[a:z] - (ends[a:z] - lens[a:z]), lens[a:z]) + np.arange(base, int(ends[z - 1]))
        out[base : int(ends[z - 1])] = raw[at]
    return out


def _window_hashes(raw: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of runs that stand one after the other, from those of 16-byte strings that cover it."""
    grams = gram_hashes(raw)
    windows = lens - LENGTH + 1
    at = np.repeat(np.cumsum(lens) - lens - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    h = grams[at]
    for k in (GRAM, 2 * GRAM, LENGTH - GRAM):
        h *= _A
        h ^= h >> np.uint64(32)
        h ^= grams[at + k]
    return h


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist() if len(x) else []
    return list(zip(at, [*at[1:], len(x)]))


_HEAD = np.dtype([("key", "<u8"), ("hash", "<u8"), ("least", "<i8"), ("most", "<i8"), ("len", "<u4"), ("places", "<u4"), ("hot", "u1")])
_PLACE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("pos", "<u4")])
_SPAN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("end", "<u4")])
#: What rows of blobs hold: runs for a shard; places of a hot run. And what shards say: spans; the same places; least documents of a hot run's windows.
_DEALT = "shard int, kind int, n int, key long, hash long, data binary"
_FOUND = "kind int, grp int, key long, hash long, data binary"
RUNS, PLACES, LEAST = 0, 1, 2


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _dealt(rows: DataFrame, turn: int, passes: int, shards: int, hot: int) -> DataFrame:
    """Runs of windows of this turn, many in a row, and places of hot runs (_DEALT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()  # repeated rows of a task count once
        for b in slices(batches, "_text"):
            keep = []
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keep.append(row not in met)
                met.add(row)
            if not all(keep):
                b = b.filter(pa.array(keep))
            out = _slice_rows(b, turn, passes, shards, min(hot, max(FEW, b.num_rows // EIGHTH)))
            if out:
                yield _rows(out, _DEALT)

    return rows.mapInArrow(run, _DEALT)


def _slice_rows(b: pa.RecordBatch, turn: int, passes: int, shards: int, hot: int) -> list[tuple]:
    texts = b.column(2).to_pylist()
    raw = np.frombuffer(b"".join(texts), np.uint8)
    grams, keys = hashes_and_keys(raw)
    if not len(keys):
        return []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    # windows do not go past the end of their text
    good = np.ones(len(keys) + LENGTH, bool)
    for e in ends.tolist():
        good[max(0, e - LENGTH + 1) : e] = False
    good = good[: len(keys)]
    new = np.append(True, keys[1:] != keys[:-1]) | ~good | np.append(False, ~good[:-1])
    new[(ends - sizes)[ends - sizes < len(keys)]] = True
    starts = np.flatnonzero(new)
    lens = np.diff(np.append(starts, len(keys))) + LENGTH - 1
    pick = good[starts] & (keys[starts] % np.uint64(passes) == turn)
    starts, lens = starts[pick], lens[pick]
    if not len(starts):
        return []
    owner = np.searchsorted(ends, starts, side="right")
    docs, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
    key, digest = keys[starts], _run_hashes(grams, starts, lens)
    shard = (key // np.uint64(passes) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((digest, key, shard))
    starts, lens, owner, key, digest, shard = (x[order] for x in (starts, lens, owner, key, digest, shard))
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
    places = np.zeros(len(starts), _PLACE)
    places["doc"], places["tag"], places["pos"] = docs[owner], tags[owner], starts - (ends - sizes)[owner]
    head = np.zeros(len(first), _HEAD)
    count = np.diff(np.append(first, len(starts)))
    head["key"], head["hash"], head["len"], head["hot"] = key[first], digest[first], lens[first], count > hot
    head["least"], head["most"] = np.minimum.reduceat(places["doc"], first), np.maximum.reduceat(places["doc"], first)
    head["places"] = np.where(count > hot, 0, count)
    out = []
    for i in np.flatnonzero(count > hot).tolist():
        own = places[first[i] : first[i] + count[i]]
        to = hash((int(key[first[i]]), int(own["doc"][0]))) % shards
        out.append((to, PLACES, len(own), *(int(x.view(np.int64)) for x in (key[first[i]], digest[first[i]])), own.tobytes()))
    cold = np.repeat(count <= hot, count)
    edge = np.concatenate([[0], np.cumsum(cold)])
    kept = places[cold]
    for a, z in _cuts(shard[first]):
        x, y = first[a], first[z] if z < len(first) else len(starts)
        data = _gather(raw, starts[first[a:z]], lens[first[a:z]])
        out.append((int(shard[x]), RUNS, z - a, None, None, head[a:z].tobytes() + kept[edge[x] : edge[y]].tobytes() + data.tobytes()))
    return out


class Shard:
    """The runs of a shard, in scratch files."""

    def __init__(self, in_memory: int = IN_MEMORY, base: int = BASE):
        self.scratch, self.base = Scratch(in_memory), base
        self.files = {name: self.scratch.file() for name in ("head", "place", "raw")}

    def add(self, n: int, data: bytes) -> None:
        at = n * _HEAD.itemsize
        head = np.frombuffer(data, _HEAD, n)
        end = at + int(head["places"].sum()) * _PLACE.itemsize
        for name, part in (("head", data[:at]), ("place", data[at:end]), ("raw", data[end:])):
            self.files[name].write(part)

    def _read(self, name: str, dtype: np.dtype | type) -> np.ndarray:
        f = self.files[name]
        f.flush()
        size = f.tell()
        if not size:
            return np.zeros(0, dtype)
        f.seek(0)
        return np.frombuffer(f.read(), dtype) if size <= self.scratch.in_memory else np.memmap(f, dtype, "r")

    def _joined(self) -> None:
        """Distinct runs of keys that several documents have: self.run; for each head its run's number, or -1; self.text
        of those that may have windows of others. top: where a run begins there, or -1.
        """
        self.head, self.place, self.raw = self._read("head", _HEAD), self._read("place", _PLACE), self._read("raw", np.uint8)
        n = len(self.head)
        self.number, begin = self.scratch.array(n, np.int64), self.scratch.array(n, np.int64)
        self.place_at = self.scratch.array(n, np.int64)
        at = places = 0
        for a in range(0, n, BLOCK):
            h = self.head[a : a + BLOCK]
            ends, stops = np.cumsum(h["len"].astype(np.int64)), np.cumsum(h["places"].astype(np.int64))
            begin[a : a + BLOCK], self.place_at[a : a + BLOCK] = at + ends - h["len"], places + stops - h["places"]
            at, places = at + int(ends[-1]), places + int(stops[-1])
        self.files["run"], self.files["text"] = self.scratch.file(), self.scratch.file()
        parts, runs, top = -(-n // HEADS), 0, 0
        for part in range(parts):
            if parts == 1:
                own = np.arange(n)
            else:  # keys are apart: those of a part are looked at together
                own = np.concatenate([a + np.flatnonzero((self.head["key"][a : a + BLOCK] * _A >> np.uint64(40)) % np.uint64(parts) == part) for a in range(0, n, BLOCK)])
            h = np.asarray(self.head[own])
            order = np.lexsort((h["hash"], h["key"]))
            h, own = h[order], own[order]
            if not len(h):
                continue
            group = np.flatnonzero(np.append(True, h["key"][1:] != h["key"][:-1]))
            shared = np.minimum.reduceat(h["least"], group) != np.maximum.reduceat(h["most"], group)
            keep = np.repeat(shared, np.diff(np.append(group, len(h))))
            self.number[own[~keep]] = -1
            h, own = h[keep], own[keep]
            if not len(h):
                continue
            first = np.flatnonzero(np.append(True, (h["key"][1:] != h["key"][:-1]) | (h["hash"][1:] != h["hash"][:-1])))
            size = np.diff(np.append(first, len(h)))
            self.number[own] = runs + np.repeat(np.arange(len(first)), size)
            run = np.zeros(len(first), [*_HEAD.descr, ("top", "<i8")])
            for name in ("key", "hash", "len"):
                run[name] = h[name][first]
            for name, f in (("least", np.minimum), ("most", np.maximum), ("hot", np.maximum)):
                run[name] = f.reduceat(h[name], first)
            mixed = np.append(False, run["key"][1:] == run["key"][:-1])
            mixed |= np.append(mixed[1:], False)
            lens = run["len"].astype(np.int64)
            mixed = self._meeting(np.flatnonzero(mixed), begin[own[first]], lens)
            inside = np.where(mixed, lens + 1, 0)
            run["top"] = np.where(mixed, top + np.cumsum(inside) - inside, -1)
            self.files["run"].write(run.tobytes())
            self.run_type = run.dtype
            first, lens = first[mixed], lens[mixed]
            for a in range(0, len(first), BLOCK // 4):
                k = slice(a, a + BLOCK // 4)
                data = _gather(self.raw, begin[own[first[k]]], lens[k]).astype(np.uint16) + np.uint16(1)
                self.files["text"].write(np.insert(data, np.cumsum(lens[k]), 0).tobytes())
            runs, top = runs + len(run), top + int(inside.sum())
        self.run = self._read("run", self.run_type) if runs else None
        self.text = self._read("text", np.uint16)

    def _meeting(self, which: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Whether a run, one of which, may have a window of another one: equal windows have equal hashes. The more documents
        there are, the more keys are equal by chance, and the suffixes of those runs need no sorting.
        """
        out = np.zeros(len(lens), bool)
        windows = lens[which] - LENGTH + 1
        if not len(which) or int(windows.sum()) > WINDOWS:
            out[which] = True
            return out
        parts = (which[a : a + BLOCK // 4] for a in range(0, len(which), BLOCK // 4))
        h = np.concatenate([_window_hashes(_gather(self.raw, begin[k], lens[k]), lens[k]) for k in parts])
        order = np.argsort(h, kind="stable")
        h, run = h[order], np.repeat(which, windows)[order]
        met = np.flatnonzero((h[1:] == h[:-1]) & (run[1:] != run[:-1]))
        out[run[met]] = out[run[met + 1]] = True
        return out

    def _least(self) -> np.ndarray:
        """By place in the text: the least document of the window that begins there."""
        text = self.text
        if not len(text):
            return np.zeros(0, np.int64)
        sa, shared = suffix_order(text, self.scratch, self.base)
        value, by = self.scratch.array(len(text), np.int64), self.scratch.array(len(text), np.int64)
        owner = self.scratch.array(len(text), np.int32)
        for a in range(0, len(self.run), BLOCK):
            number = a + np.flatnonzero(self.run["top"][a : a + BLOCK] >= 0)
            some = self.run[number]
            if len(some):
                owner[some["top"][0] : some["top"][-1] + some["len"][-1] + 1] = np.repeat(number, some["len"].astype(np.int64) + 1)
        top, last_window, least_of = (np.ascontiguousarray(self.run[c]) for c in ("top", "len", "least"))
        last_window = top + last_window.astype(np.int64) - LENGTH
        carry = 0
        never = np.iinfo(np.int64).max
        for a in range(0, len(sa), BLOCK):
            at = np.asarray(sa[a : a + BLOCK])
            run = owner[at]
            v = np.where(at <= last_window[run], least_of[run], never)
            new = shared[a : a + BLOCK] < LENGTH
            starts = np.flatnonzero(new)
            starts = starts if len(starts) and starts[0] == 0 else np.append(0, starts)
            least = np.minimum.reduceat(v, starts)
            if not new[0]:
                least[0] = min(int(least[0]), carry)
            carry = int(least[-1])
            value[a : a + BLOCK] = np.repeat(least, np.diff(np.append(starts, len(at))))
        last = None  # what the group that goes on beyond the block has
        for a in range((len(sa) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            v, new = np.array(value[a : a + BLOCK]), shared[a : a + BLOCK] < LENGTH
            if last is not None:
                v[np.flatnonzero(new)[-1] if new.any() else 0 :] = last
            by[sa[a : a + BLOCK]] = v
            last = None if new[0] else int(v[0])
        return by

    def found(self, groups: int) -> Iterator[pa.RecordBatch]:
        """Spans of later documents, by group, and least documents of hot runs' windows (_FOUND)."""
        self._joined()
        if self.run is None:
            return
        by = self._least()
        for a in range(0, len(self.run), BLOCK):
            hot = self.run[a : a + BLOCK]
            hot = hot[hot["hot"] > 0]
            rows = [(LEAST, None, int(k.view(np.int64)), int(h.view(np.int64)), (by[t : t + n - LENGTH + 1] if t >= 0 else np.full(n - LENGTH + 1, x)).tobytes()) for k, h, t, n, x in zip(hot["key"], hot["hash"], hot["top"].tolist(), hot["len"].tolist(), hot["least"])]
            if rows:
                yield _rows(rows, _FOUND)
        for a in range(0, len(self.head), BLOCK // 4):
            number = np.asarray(self.number[a : a + BLOCK // 4])
            own = np.flatnonzero((number >= 0) & (self.head["places"][a : a + BLOCK // 4] > 0)) + a
            if not len(own):
                continue
            run, count = self.run[self.number[own]], self.head["places"][own].astype(np.int64)
            where = np.repeat(np.arange(len(own)), count)
            at = np.repeat(self.place_at[own], count) + np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
            for k in range(0, len(at), BLOCK // 4):
                own_run, places = run[where[k : k + BLOCK // 4]], self.place[at[k : k + BLOCK // 4]]
                mixed = own_run["top"] >= 0
                spans = _spans(places[mixed], by, own_run["top"][mixed], own_run["len"][mixed].astype(np.int64))
                alone = ~mixed & (own_run["least"] < places["doc"])
                rows = _grouped(np.concatenate([spans, _whole(places[alone], own_run["len"][alone])]), groups)
                if rows:
                    yield _rows([(RUNS, g, None, None, d) for g, d in rows], _FOUND)

    def close(self) -> None:
        self.scratch.close()


def _spans(places: np.ndarray, by: np.ndarray, tops: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Stretches of the places' windows whose string starts in an earlier document. by: least documents, from tops on."""
    windows = lens - LENGTH + 1
    ends = np.cumsum(windows)
    which = np.repeat(np.arange(len(places)), windows)
    k = np.arange(len(which)) - np.repeat(ends - windows, windows)
    hit = by[tops[which] + k] < places["doc"][which]
    edge = np.append(True, which[1:] != which[:-1])[: len(which)]
    begin = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
    end = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)))
    span = np.zeros(len(begin), _SPAN)
    span["doc"], span["tag"] = places["doc"][which[begin]], places["tag"][which[begin]]
    span["start"] = places["pos"][which[begin]] + k[begin]
    span["end"] = places["pos"][which[begin]] + k[end] + LENGTH
    return span


def _whole(places: np.ndarray, lens: np.ndarray) -> np.ndarray:
    span = np.zeros(len(places), _SPAN)
    span["doc"], span["tag"], span["start"], span["end"] = places["doc"], places["tag"], places["pos"], places["pos"] + lens
    return span


def _grouped(spans: np.ndarray, groups: int) -> list[tuple[int, bytes]]:
    grp = ((spans["doc"].astype(np.uint64) ^ spans["tag"].astype(np.uint64)) * _A >> np.uint64(33)).astype(np.int64) % groups
    order = np.argsort(grp, kind="stable")
    spans, grp = spans[order], grp[order]
    return [(int(grp[a]), spans[a:z].tobytes()) for a, z in _cuts(grp)]


def _found(dealt: DataFrame, shards: int, groups: int, in_memory: int, base: int) -> DataFrame:
    """What the shards say (_FOUND); places of hot runs pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        try:
            for b in batches:
                for s, kind, n, key, digest, data in zip(*(c.to_pylist() for c in b.columns)):
                    if kind == PLACES:
                        yield _rows([(PLACES, None, key, digest, data)], _FOUND)
                        continue
                    if s != held:
                        if shard is not None:
                            yield from shard.found(groups)
                            shard.close()
                        held, shard = s, Shard(in_memory, base)
                    shard.add(n, data)
            if shard is not None:
                yield from shard.found(groups)
        finally:
            if shard is not None:
                shard.close()

    return dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, _FOUND)


def _hot_spans(found: DataFrame, groups: int) -> DataFrame:
    """(grp, data): spans at the places of hot runs. A run that is found everywhere has a row of places a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, least in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, by = np.frombuffer(places, _PLACE), np.frombuffer(least, np.int64)
                for a in range(0, len(p), BLOCK // 4):
                    own = p[a : a + BLOCK // 4]
                    rows = _grouped(_spans(own, by, np.zeros(len(own), np.int64), np.full(len(own), len(by) + LENGTH - 1)), groups)
                    if rows:
                        yield _rows(rows, "grp int, data binary")

    places = found.where(F.col("kind") == PLACES).select("key", "hash", F.col("data").alias("places"))
    least = found.where(F.col("kind") == LEAST).select("key", "hash", F.col("data").alias("least"))
    return places.join(least, ["key", "hash"]).select("places", "least").mapInArrow(run, "grp int, data binary")


def _merged(spans: DataFrame) -> DataFrame:
    """(_id, _tag, spans): for each document the stretches to remove, ascending and apart."""

    def run(table: pa.Table) -> pa.Table:
        s = np.frombuffer(b"".join(table.column("data").to_pylist()), _SPAN)
        s = s[np.lexsort([s["start"], s["tag"], s["doc"]])]
        ids, tags, lists = [], [], []
        new = np.append(True, (s["doc"][1:] != s["doc"][:-1]) | (s["tag"][1:] != s["tag"][:-1])) if len(s) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        for a, z in _cuts(number):
            starts, ends = s["start"][a:z].astype(np.int64), np.maximum.accumulate(s["end"][a:z].astype(np.int64))
            first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
            ids.append(int(s["doc"][a]))
            tags.append(int(s["tag"][a]))
            lists.append(np.stack([starts[first], ends[np.append(first[1:], len(starts)) - 1]], 1).astype("<i8").tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(lists, pa.binary())], names=["_id", "_tag", "spans"])

    return spans.groupBy("grp").applyInArrow(run, "_id long, _tag long, spans binary")


def _removed(rows: DataFrame, with_text: bool) -> DataFrame:
    names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            out = []
            for i, raw, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                cut = np.frombuffer(spans or b"", "<i8").reshape(-1, 2)
                at, parts = 0, []
                for s, e in cut.tolist():
                    parts.append(raw[at:s])
                    at = e
                kept = b"".join([*parts, raw[at:]]) if len(cut) else raw
                row = (i, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(map(list, zip(*out)), types)], names)

    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return rows.mapInArrow(run, schema)


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    passes: int = PASSES,
    shard_text: int = SHARD_TEXT,
    hot: int = HOT,
    in_memory: int = IN_MEMORY,
    base: int = BASE,
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept binary if with_text) for each row of docs.

    A null text is empty. Rows without an id stay whole and take no part. Repeated rows, and other texts under one id,
    aren't earlier than each other. An empty table gives an empty result; other columns are not looked at. The other
    parameters decide how the work is cut, never what is found.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).select("_id", F.xxhash64("_text").alias("_tag"), "_text")
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = groups = int(total // shard_text) + 4
    top = shared_dir(spark)
    whole = rows.where("_id IS NOT NULL AND octet_length(_text) >= 50")
    found = None
    for turn in range(passes):
        part = written(_found(_dealt(whole, turn, passes, shards, hot), shards, groups, in_memory, base), f"{top}/{turn}")
        found = part if found is None else found.unionByName(part)
    spans = found.where(F.col("kind") == RUNS).select("grp", "data").unionByName(_hot_spans(found, groups))
    gone = written(_merged(spans), f"{top}/spans")
    discard(spark, *(f"{top}/{turn}" for turn in range(passes)))
    gone = gone.select(F.col("_id").alias("_doc"), F.col("_tag").alias("_of"), "spans")
    both = rows.join(gone, (F.col("_id") == F.col("_doc")) & (F.col("_tag") == F.col("_of")), "left")
    return _removed(both.select("_id", "_text", "spans"), with_text).withColumnRenamed("_id", id_col)
