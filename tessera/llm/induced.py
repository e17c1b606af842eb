"""External induced suffix sorting that carries common prefixes through disk-backed queues.

Suffixes that begin a rise after a fall (S*) are ordered first: their substrings up to the next such place are named in
order, and the string of names is sorted by the same induction, until it is small enough to be sorted in memory. From them
all other suffixes are induced: one pass goes up the symbols and one goes down, and a suffix that leaves the queue of its
first symbol puts the suffix before it into that one's queue. With each suffix a queue carries what it shares with the one
put there before it: one symbol more than the least that their sources, and all sources between, share.

Arrays that outgrow the memory limit are mapped files, queues write what outgrows it to a file, and both are read in
blocks, so memory is bounded by the limit and the text may be far larger. Files lie where Spark spills, and go with the task.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

#: Symbols that two suffixes share are counted up to here, and suffixes are ordered by at least as many.
CAP = 64
#: Bytes that the queues, and each array, of a shard may hold in memory.
IN_MEMORY = 32 << 20
#: Suffixes handled at once.
BLOCK = 1 << 16
#: Names that are sorted in memory; longer strings of names are induced.
BASE = 1 << 20


class Scratch:
    """Arrays in memory or, beyond the limit, in mapped files that are gone when it is closed."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory, self.files = in_memory, []

    def file(self):
        where = next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)
        f = tempfile.TemporaryFile(prefix="tessera-", dir=where)
        self.files.append(f)
        return f

    def array(self, n: int, dtype: type | np.dtype | str) -> np.ndarray:
        dtype = np.dtype(dtype)
        if n * dtype.itemsize <= self.in_memory:
            return np.zeros(n, dtype)
        return np.memmap(self.file(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        for f in self.files:
            f.close()


class Queues:
    """A first-in, first-out queue per symbol of (position, symbols shared with the one put there before), read by pop() in
    blocks, for symbols in the order in which they are read.

    Symbols are put together in ranges that hold a block at most, by edges; only the range that is read is apart by symbol.
    So there are as many lists as ranges, however many symbols there are, and a symbol with more than a block is a range of
    its own. What outgrows the limit goes to a file; what is read at once is a block.
    """

    ITEM = np.dtype([("symbol", "<i8"), ("at", "<i8"), ("shared", "u1")])

    def __init__(self, scratch: Scratch, edges: np.ndarray):
        self.edges = edges  # the first symbol of each range
        self.parts: dict[int, list[np.ndarray | tuple[int, int]]] = defaultdict(list)
        self.held, self.scratch, self.file = 0, scratch, None
        self.open, self.apart = -1, defaultdict(list)
        self.most = 0  # items held at once, for tests

    def put(self, symbol: np.ndarray, at: np.ndarray, shared: np.ndarray) -> None:
        """Items by symbol; those of one symbol in order."""
        item = np.empty(len(at), self.ITEM)
        item["symbol"], item["at"], item["shared"] = symbol, at, shared
        to = np.searchsorted(self.edges, item["symbol"], side="right") - 1
        for a, z in _cuts(to):
            if to[a] == self.open and not self._alone(self.open):
                self._split(item[a:z].copy())
            else:
                self._keep(int(to[a]), item[a:z])

    def _alone(self, part: int) -> bool:
        return part + 1 < len(self.edges) and self.edges[part + 1] == self.edges[part] + 1

    def _keep(self, part: int, item: np.ndarray) -> None:
        if self.held + item.nbytes > self.scratch.in_memory:
            self.file = self.file or self.scratch.file()
            where = self.file.seek(0, os.SEEK_END)
            self.file.write(item.tobytes())
            self.parts[part].append((where, len(item)))
        else:
            self.held += item.nbytes
            self.parts[part].append(item.copy())

    def _split(self, item: np.ndarray) -> None:
        for a, z in _cuts(item["symbol"]):
            self.apart[int(item["symbol"][a])].append(item[a:z])

    def _read(self, part: int) -> np.ndarray | None:
        """The next block of a range, nothing if it is empty."""
        got, size, kept = [], 0, self.parts.get(part, [])
        n = 0
        while n < len(kept) and size < BLOCK:
            p = kept[n]
            if isinstance(p, tuple):
                where, left = p
                take = min(left, BLOCK)
                self.file.seek(where)
                got.append(np.frombuffer(self.file.read(self.ITEM.itemsize * take), self.ITEM))
                if take < left:
                    kept[n] = (where + self.ITEM.itemsize * take, left - take)
                    break
            else:
                self.held -= p.nbytes
                got.append(p)
            size += len(got[-1])
            n += 1
        del kept[:n]
        if not got:
            self.parts.pop(part, None)
            return None
        out = got[0] if len(got) == 1 else np.concatenate(got)
        self.most = max(self.most, len(out))
        return out

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next items of a symbol, a few blocks at most; nothing if there are none now."""
        part = int(np.searchsorted(self.edges, symbol, side="right")) - 1
        if self._alone(part):
            block = self._read(part)
        else:
            if part != self.open:
                self.open, self.apart = part, defaultdict(list)
                whole = []
                while (b := self._read(part)) is not None:
                    whole.append(b)
                if whole:
                    item = np.concatenate(whole)
                    self.most = max(self.most, len(item))
                    self._split(item[np.argsort(item["symbol"], kind="stable")])
            got = self.apart.pop(symbol, None)
            block = np.concatenate(got) if got else None
        return None if block is None else (block["at"].astype(np.int64), block["shared"].copy())


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist() if len(x) else []
    return list(zip(at, [*at[1:], len(x)]))


def ranges(upto: np.ndarray) -> np.ndarray:
    """First symbols of ranges of symbols that occur a block's times at most; one that occurs more often is alone. upto: how
    often the symbols before each occur, all together.
    """
    edges, a, n = [0], 0, len(upto) - 1
    while a < n:
        a = min(n, max(a + 1, int(np.searchsorted(upto, upto[a] + BLOCK, side="right")) - 1))
        edges.append(a)
    return np.array(edges, np.int64)


class Pusher:
    """Puts the suffixes before a sequence of sources into queues, with the symbols that they share."""

    def __init__(self, text: np.ndarray, rising: np.ndarray, want: bool, queues: Queues, symbols: int):
        self.text, self.rising, self.want, self.queues = text, rising, want, queues
        self.clock = 0
        self.last = queues.scratch.array(symbols, np.int64)  # when a symbol's queue was last put something
        for a in range(0, symbols, BLOCK):
            self.last[a : a + BLOCK] = -1
        self.seen = np.full(CAP + 1, -1)  # when a source last shared so much with the one before

    def push(self, at: np.ndarray, shared: np.ndarray) -> None:
        """at: sources in order; shared: what each shares with the source before."""
        ok = np.flatnonzero(at > 0)
        before = at[ok] - 1
        fit = self.rising[before] == self.want
        ok, before = ok[fit], before[fit]
        symbol = np.asarray(self.text[before])
        order = np.argsort(symbol, kind="stable")
        ok, before, symbol = ok[order], before[order], symbol[order]
        if len(ok):
            first = np.append(True, symbol[1:] != symbol[:-1])
            heads = np.flatnonzero(first)
            # the least shared of the sources after the one before, up to and with its own
            low = np.append(0, ok[:-1] + 1)
            low[heads] = 0
            least = _range_min(shared, low, ok)
            since = self.last[symbol[heads]]
            earlier = self.seen[None, :] > since[:, None]
            least[heads] = np.minimum(least[heads], np.where(earlier.any(1), earlier.argmax(1), CAP))
            least = np.minimum(least + 1, CAP).astype(np.uint8)
            ends = np.append(heads[1:], len(ok)) - 1
            self.last[symbol[heads]] = self.clock + ok[ends]
            self.queues.put(symbol, before, least)
        self.seen[shared] = self.clock + np.arange(len(shared))
        self.clock += len(at)


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low : high + 1] of each pair, by minima over powers of two."""
    out = np.empty(len(low), np.int64)
    level = np.floor(np.log2(high - low + 1)).astype(np.int64)
    table, k = np.asarray(x), 0
    while True:
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] + 1 - (1 << k)])
        if k >= level.max(initial=0):
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int = CAP) -> np.ndarray:
    """How many symbols the suffixes at a and b share, up to cap."""
    n, out = len(text), np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    if text.dtype == np.uint16 and n > cap + 4:
        far = np.maximum(a, b) + cap + 4 > n
        near, live = np.flatnonzero(~far), np.flatnonzero(far)
        fours = np.ndarray((n - 3,), "<u8", text, 0, (2,))
        for k in range(0, cap, 4):
            x = fours[a[near] + k] ^ fours[b[near] + k]
            end = x != 0
            x = x[end]
            tail = ((x & np.uint64(0xFFFF)) == 0).astype(np.uint8) + ((x & np.uint64(0xFFFFFFFF)) == 0) + ((x & np.uint64(0xFFFFFFFFFFFF)) == 0)
            out[near[end]] = k + tail
            near = near[~end]
            if not len(near):
                break
        out[near] = cap
    for k in range(cap):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _rising(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether the next symbol that differs is greater; the last suffix counts as rising."""
    n = len(text)
    out = scratch.array(n, bool)
    out[n - 1] = True
    after, rises = int(text[n - 1]), True
    for z in range(n - 1, 0, -BLOCK):
        a = max(0, z - BLOCK)
        own = np.append(text[a:z], after).astype(np.int64)
        step = np.sign(own[1:] - own[:-1])
        # a step of 0 is as the next step that isn't
        at = np.where(step != 0, np.arange(len(step)), len(step))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[a:z] = np.append(step > 0, rises)[at]
        after, rises = int(own[0]), bool(out[a])
    return out


def _stars(rising: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Places that rise after a fall, ascending; the last place is one always."""
    n = len(rising)
    blocks = [(a, min(n, a + BLOCK)) for a in range(1, n, BLOCK)]
    found = lambda a, z: np.flatnonzero(rising[a:z] & ~rising[a - 1 : z - 1]) + a
    size = sum(len(found(a, z)) for a, z in blocks)
    extra = n == 1 or not (rising[n - 1] and not rising[n - 2])
    out, at = scratch.array(size + extra, np.int64), 0
    for a, z in blocks:
        own = found(a, z)
        out[at : at + len(own)] = own
        at += len(own)
    if extra:
        out[-1] = n - 1
    return out


def _names(text: np.ndarray, star: np.ndarray, symbols: int, scratch: Scratch, base: int) -> tuple[np.ndarray, int]:
    """A number for the substring from each S* place to the next one (both included), in the order of their suffixes.

    base of them are sorted in memory at most: more are dealt to files by their next symbols, around values of a sample,
    until each part is small, or all that is left in it is equal.
    """
    m = len(star)
    names = scratch.array(m, np.int64)
    if m <= base:
        return names, _name(text, star, np.arange(m), symbols, names, 0)
    blocks = (np.arange(a, min(m, a + BLOCK)) for a in range(0, m, BLOCK))
    return names, _name_many(text, star, blocks, m, 0, symbols, names, 0, scratch, base)


def _word(text: np.ndarray, star: np.ndarray, own: np.ndarray, k: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols from k on of the substrings of S* numbers own, as many as fit, as one number; and whether they end there."""
    n, m = len(text), len(star)
    bits = int(symbols + 2).bit_length()
    per = max(1, 63 // bits)
    begin, end = np.asarray(star[own]), np.asarray(star[np.minimum(own + 1, m - 1)]) + 1
    # after the end; of two, one of which begins the other, the longer falls there and comes first; nothing is before the last
    mark = np.where(own == m - 1, 0, symbols + 1)
    word = np.zeros(len(own), np.int64)
    for d in range(k, k + per):
        p = begin + d
        word = (word << bits) | np.where(p < end, text[np.minimum(p, n - 1)].astype(np.int64) + 1, mark)
    return word, begin + k + per > end


def _name_many(text, star, blocks: Iterable[np.ndarray], size: int, k: int, symbols: int, names: np.ndarray, count: int, scratch: Scratch, base: int) -> int:
    """Names from count on for S* numbers that come in blocks and share their first k symbols; returns the next free name."""
    waiting = [(blocks, size, k, False)]
    while waiting:  # parts in order; the next one is the last of the list
        blocks, size, k, equal = waiting.pop()
        if equal:
            for own in blocks:
                names[own] = count
            count += 1
            continue
        if size <= base:
            count = _name(text, star, np.concatenate(list(blocks)), symbols, names, count)
            continue
        blocks = _Replay(blocks, scratch)
        step = 64 * max(1, size // (4 * BLOCK))
        sample = np.sort(np.concatenate([_word(text, star, own[::step], k, symbols)[0] for own in blocks]))
        values = np.unique(sample[np.linspace(0, len(sample) - 1, min(len(sample), 256)).astype(np.int64)])
        parts = Queues(scratch, np.arange(2 * len(values) + 2))  # every part alone: read in blocks
        sizes, ended = np.zeros(2 * len(values) + 1, np.int64), np.zeros(2 * len(values) + 1, bool)
        for own in blocks:
            word, ends = _word(text, star, own, k, symbols)
            at = np.searchsorted(values, word)
            part = 2 * at + (values[np.minimum(at, len(values) - 1)] == word)
            order = np.argsort(part, kind="stable")
            parts.put(part[order], own[order], np.zeros(len(own), np.uint8))
            sizes += np.bincount(part, minlength=len(sizes))
            ended[part[ends]] = True  # of a part of equal words all end, or none does
        per = max(1, 63 // int(symbols + 2).bit_length())
        for part in np.flatnonzero(sizes)[::-1].tolist():
            same = part % 2 == 1
            waiting.append((_drained(parts, part), int(sizes[part]), k + per if same and not ended[part] else k, same and bool(ended[part])))
    return count


def _drained(queues: Queues, part: int) -> Iterator[np.ndarray]:
    while (b := queues.pop(part)) is not None:
        yield b[0]


class _Replay:
    """Blocks that can be gone through twice: as they come first they are kept, beyond the limit in a file."""

    def __init__(self, blocks: Iterable[np.ndarray], scratch: Scratch):
        self.kept: list[np.ndarray | tuple[int, int]] = []
        self.file, held = None, 0
        for b in blocks:
            b = np.ascontiguousarray(b, np.int64)
            held += b.nbytes
            if held <= scratch.in_memory:
                self.kept.append(b)
                continue
            self.file = self.file or scratch.file()
            self.kept.append((self.file.seek(0, os.SEEK_END), len(b)))
            self.file.write(b.tobytes())

    def __iter__(self) -> Iterator[np.ndarray]:
        for b in self.kept:
            if isinstance(b, tuple):
                self.file.seek(b[0])
                b = np.frombuffer(self.file.read(8 * b[1]), np.int64)
            yield b


def _name(text: np.ndarray, star: np.ndarray, own: np.ndarray, symbols: int, names: np.ndarray, count: int) -> int:
    """Names from count on for the S* numbers own; returns the next free name."""
    n, m = len(text), len(star)
    begin = np.asarray(star[own])
    end = np.asarray(star[np.minimum(own + 1, m - 1)]) + 1
    bits = int(symbols + 2).bit_length()
    per = max(1, 63 // bits)
    # after the end; of two, one of which begins the other, the longer falls there and comes first; nothing is before the last
    mark = np.where(own == m - 1, 0, symbols + 1)
    group, order, k = np.zeros(len(own), np.int64), np.arange(len(own)), 0
    live = order
    while len(live):
        word = np.zeros(len(live), np.int64)
        for d in range(k, k + per):
            p = begin[live] + d
            word = (word << bits) | np.where(p < end[live], text[np.minimum(p, n - 1)].astype(np.int64) + 1, mark[live])
        k += per
        by = np.lexsort((word, group[live])) if k > per else np.argsort(word)
        # those of a group stand together in order; sort them where they stand
        live, word = live[by], word[by]
        places = np.flatnonzero(np.isin(order, live)) if len(live) < len(order) else np.arange(len(order))
        order[places] = live
        g = group[live]
        new = np.append(True, (word[1:] != word[:-1]) | (g[1:] != g[:-1]))
        fresh = np.zeros(len(order), bool)
        fresh[places] = new
        old = group[order]
        fresh |= np.append(True, old[1:] != old[:-1])
        group[order] = np.cumsum(fresh) - 1
        size = np.bincount(group[order])
        # one that ends with the word goes on, as its group may hold longer ones: only the mark parts them
        live = live[(size[group[live]] > 1) & (begin[live] + k <= end[live])] if k <= n else live[:0]
    names[own] = count + group
    return count + int(group.max(initial=-1)) + 1


def _in_memory(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of names by their first depth names at least, by doubling."""
    rank = np.asarray(names)
    m, h = len(rank), 1
    order = np.argsort(rank)
    sorted_rank = rank[order]
    fresh = np.append(True, sorted_rank[1:] != sorted_rank[:-1])
    while True:
        starts = np.flatnonzero(fresh)
        number = np.empty(m, np.int64)
        number[order] = np.repeat(starts, np.diff(np.append(starts, m)))
        alone = fresh & np.append(fresh[1:], True)
        live = np.flatnonzero(~alone)
        if not len(live) or h >= depth:
            return order
        own = order[live]
        # a place's number and that of the place ahead, in one word
        both = number[own] << 32 | np.where(own + h < m, number[np.minimum(own + h, m - 1)] + 1, 0)
        by = np.argsort(both)
        order[live] = own[by]
        both = both[by]
        fresh[live] = np.append(True, both[1:] != both[:-1])
        h *= 2


def _counts(blocks: Iterable[np.ndarray], symbols: int, scratch: Scratch) -> np.ndarray:
    out = scratch.array(symbols, np.int64)
    for b in blocks:
        s, n = np.unique(b, return_counts=True)
        out[s] += n
    return out


def _upto(count: np.ndarray, scratch: Scratch) -> np.ndarray:
    out = scratch.array(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    return out


def _present(count: np.ndarray, down: bool = False) -> Iterator[int]:
    """Symbols that occur, in order."""
    blocks = range(0, len(count), BLOCK)
    for a in reversed(blocks) if down else blocks:
        own = (np.flatnonzero(count[a : a + BLOCK]) + a).tolist()
        yield from reversed(own) if down else own


def suffix_order(text: np.ndarray, scratch: Scratch | None = None, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of text (symbols 0, 1, ...; it ends in a single least one) by the CAP symbols from there on at least, and
    how many symbols each shares with the one before, up to CAP. Recursion ends at base names.
    """
    scratch = scratch or Scratch()
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    if n > 1 and text[-2] <= text[-1]:
        raise ValueError("the text has to end in a single least symbol")
    symbols = int(text.max()) + 1
    rising = _rising(text, scratch)
    star = _stars(rising, scratch)
    names, count = _names(text, star, symbols, scratch, base)
    if count == len(star):
        order = scratch.array(len(star), np.int64)
        for a in range(0, len(star), BLOCK):
            z = min(len(star), a + BLOCK)
            order[names[a:z]] = np.arange(a, z)
    elif len(star) <= base:
        order = _in_memory(names, CAP // 2)  # a name is two symbols at least
    else:
        order, _ = suffix_order(names, scratch, base)
    sa, shared = scratch.array(n, np.int64), scratch.array(n, np.uint8)
    # where the suffixes of each first symbol begin, those that fall before those that rise
    counts = lambda blocks: _counts(blocks, symbols, scratch)
    total = counts(np.asarray(text[a : a + BLOCK]) for a in range(0, n, BLOCK))
    falling = counts(np.asarray(text[a : a + BLOCK])[~rising[a : a + BLOCK]] for a in range(0, n, BLOCK))
    begin = _upto(total, scratch)
    star_begin = _upto(counts(np.asarray(text[star[a : a + BLOCK]]) for a in range(0, len(star), BLOCK)), scratch)

    def seeds(a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        at = star[order[a:z]]
        back = star[order[max(a - 1, 0) : z - 1]] if a else np.append(at[:1], star[order[: z - 1]])
        return at, shared_prefix(text, at, back)

    edges = ranges(begin)
    queues = Queues(scratch, edges)
    up = Pusher(text, rising, False, queues, symbols)
    for c in _present(total):
        at, last = int(begin[c]), None
        while (b := queues.pop(c)) is not None:
            p, s = b
            if at == begin[c]:
                s[0] = 0
            sa[at : at + len(p)], shared[at : at + len(p)] = p, s
            at, last = at + len(p), p[-1:]
            up.push(p, s)
        for a in range(int(star_begin[c]), int(star_begin[c + 1]), BLOCK):
            p, s = seeds(a, min(a + BLOCK, int(star_begin[c + 1])))
            if a == star_begin[c]:
                s[0] = 0 if last is None else shared_prefix(text, last, p[:1])[0]
            up.push(p, s)
    queues = Queues(scratch, edges)
    down = Pusher(text, rising, True, queues, symbols)
    for c in _present(total, down=True):
        top = int(begin[c + 1])
        at, link = top, 0  # link: what the next one down shares with the last one placed
        if c == text[n - 1]:  # nothing follows the last suffix to induce it
            queues.put(np.array([c]), np.array([n - 1]), np.zeros(1, np.uint8))
        while (b := queues.pop(c)) is not None:
            p, s = b
            if c == text[n - 1] and len(k := np.flatnonzero(p == n - 1)):  # no queue carries what the last suffix shares
                k = int(k[0])
                above = p[k - 1 : k] if k else np.asarray(sa[at : at + 1])
                s[k] = shared_prefix(text, p[k : k + 1], above)[0] if len(above) else 0
            if at == top:
                s[0] = 0
            sa[at - len(p) : at] = p[::-1]
            # each shares s with the one above it
            shared[at - len(p) + 1 : min(at + 1, top)] = s[::-1][: min(at + 1, top) - (at - len(p) + 1)]
            at -= len(p)
            down.push(p, s)
        low = int(begin[c] + falling[c])
        if at != low:
            raise RuntimeError("a suffix was not induced")
        if low < top:
            shared[low] = link = shared_prefix(text, sa[low : low + 1], sa[low - 1 : low])[0] if low > begin[c] else 0
        for z in range(low, int(begin[c]), -BLOCK):
            a = max(int(begin[c]), z - BLOCK)
            p = np.asarray(sa[a:z])[::-1]
            s = np.append(np.uint8(link), np.asarray(shared[a + 1 : z])[::-1]).astype(np.uint8)
            link = int(shared[a])
            down.push(p, s)
    return sa, shared
