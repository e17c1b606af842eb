"""Secret scans by one deterministic automaton for all rules.

Rules are compiled by Thompson's construction, subset construction and minimisation into transition rows. A first
automaton reads each text's bytes once, in one pass for all rules, and tells whether the text can hold any secret;
such texts are read by the second, whose accepting states name the rules that end at a byte, for the exact spans.
Both read each byte once; the spans of a rule take steps in proportion to the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import getitem

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


@dataclass(frozen=True)
class SecretRule:
    """pattern: its leftmost longest matches in turn. Matches with fewer than least bytes after head (a pattern that they
    begin with; counted from the start where it is empty) are dropped, but nothing else of the kind starts within them.
    floor: a short pattern that every kept match holds; the first pass looks for these.
    """

    kind: str
    pattern: str
    floor: str
    head: str = ""
    least: int = 0


_KEYWORDS = "(password|passwd|secret|token|api_?key)"
_either = lambda p: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in p)
_ASSIGN = _either(_KEYWORDS) + "[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=\\-]"

#: The base rules, in the order of their kinds.
BASE = (
    SecretRule("assign", f"{_ASSIGN}{_VALUE}+", f"{_ASSIGN}{_VALUE}{{12}}", head=_ASSIGN, least=12),
    SecretRule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14}", least=18),
    SecretRule("hex", "[0-9a-f]+", "[0-9a-f]{16}", least=16),
)
#: Further kinds, which only add spans.
MORE = (
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{2}", least=40),
    SecretRule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", "\\.eyJ", least=30),
    SecretRule("slack", "xox[abpr]-[A-Za-z0-9\\-]+", "xox[abpr]-", least=15),
    SecretRule("hub", "hf_[A-Za-z0-9]+", "hf_[A-Za-z0-9]{2}", least=33),
)
RULES = BASE + MORE
#: Steps to nowhere that may be taken again.
SHORT = 32


class _Nfa:
    """Thompson's construction for literals, escapes, classes, groups, |, ?, *, + and {m}."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.moves.append(None)
        return len(self.eps) - 1

    def compile(self, pattern: str) -> tuple[int, int]:
        self.p, self.at = pattern, 0
        out = self._either()
        if self.at != len(pattern):
            raise ValueError(f"{pattern!r} at {self.at}")
        return out

    def _either(self) -> tuple[int, int]:
        ends = [self._row()]
        while self.p[self.at : self.at + 1] == "|":
            self.at += 1
            ends.append(self._row())
        if len(ends) == 1:
            return ends[0]
        a, z = self.state(), self.state()
        for s, e in ends:
            self.eps[a].append(s)
            self.eps[e].append(z)
        return a, z

    def _row(self) -> tuple[int, int]:
        a = z = self.state()
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            begin = self.at
            s, e = self._one()
            stop = self.at
            c = self.p[self.at : self.at + 1]
            if c == "{":
                close = self.p.index("}", self.at)
                times, after = int(self.p[self.at + 1 : close]), close + 1
                for _ in range(times - 1):
                    self.at = begin
                    s2, e2 = self._one()
                    self.eps[e].append(s2)
                    e = e2
                    assert self.at == stop
                self.at = after
            elif c and c in "?*+":
                self.at += 1
                b, f = self.state(), self.state()
                self.eps[b].append(s)
                self.eps[e].append(f)
                if c in "?*":
                    self.eps[b].append(f)
                if c in "*+":
                    self.eps[e].append(s)
                s, e = b, f
            self.eps[z].append(s)
            z = e
        return a, z

    def _one(self) -> tuple[int, int]:
        c = self.p[self.at]
        if c == "(":
            self.at += 1
            out = self._either()
            self.at += 1
            return out
        chars = self._class() if c == "[" else frozenset([self._char()])
        a, z = self.state(), self.state()
        self.moves[a] = (chars, z)
        return a, z

    def _char(self) -> int:
        c = self.p[self.at]
        self.at += 1
        if c == "\\":
            c = self.p[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.p[self.at - 2 : self.at], 16)
        return ord(c)

    def _class(self) -> frozenset[int]:
        self.at += 1
        out: set[int] = set()
        while self.p[self.at] != "]":
            a = self._char()
            if self.p[self.at] == "-" and self.p[self.at + 1] != "]":
                self.at += 1
                out |= set(range(a, self._char() + 1))
            else:
                out.add(a)
        self.at += 1
        return frozenset(out)


class Automaton:
    """table[state, byte] -> state; accepts[state]: bits of the patterns that end there. anywhere: matches may start at any
    byte. sticky: an accepting state is never left. State 0 is the start; dead is the state without a way on, or -1.
    """

    def __init__(self, patterns: Sequence[str], anywhere: bool, sticky: bool = False):
        nfa = _Nfa()
        ends, starts = {}, []
        for i, p in enumerate(patterns):
            a, z = nfa.compile(p)
            starts.append(a)
            ends[z] = 1 << i

        def closure(states: set[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.moves[s] or s in ends)

        # bytes that no rule tells apart share a column until the end
        sets = list({m[0] for m in nfa.moves if m})
        _, like, column = np.unique(np.array([[c in x for x in sets] for c in range(256)]), axis=0, return_index=True, return_inverse=True)
        likes, column = like.tolist(), column.reshape(-1)
        classes = {x: [k for k, c in enumerate(likes) if c in x] for x in sets}
        first = closure(set(starts))
        number, todo, rows, accepts = {first: 0}, [first], [], []
        while todo:
            own = todo.pop(0)
            hit = sum({ends[s] for s in own if s in ends})
            accepts.append(hit)
            if sticky and hit:
                rows.append([number[own]] * len(likes))
                continue
            to: list[set[int]] = [set() for _ in likes]
            for s in own:
                if nfa.moves[s]:
                    for c in classes[nfa.moves[s][0]]:
                        to[c].add(nfa.moves[s][1])
            made: dict[frozenset[int], int] = {}
            row = []
            for c in range(len(likes)):
                key = frozenset(to[c])
                if key not in made:
                    full = closure(set(key) | (set(starts) if anywhere else set()))
                    if full not in number:
                        number[full] = len(number)
                        todo.append(full)
                    made[key] = number[full]
                row.append(made[key])
            rows.append(row)
        small, self.accepts = _minimal(np.array(rows, np.int32), np.array(accepts, np.int64))
        self.table = small[:, column]
        n = len(self.table)
        dead = [s for s in range(n) if not self.accepts[s] and (self.table[s] == s).all()]
        self.dead = dead[0] if dead else -1

    def rows(self) -> list[list]:
        """The table as lists of the lists that follow: stepping is one lookup."""
        out: list[list] = [[] for _ in range(len(self.table))]
        for s, r in enumerate(self.table.tolist()):
            out[s].extend(out[t] for t in r)
        return out


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's refinement: states are split by their class and the classes that follow until nothing changes."""
    _, part = np.unique(accepts, return_inverse=True)
    while True:
        _, new = np.unique(np.concatenate([part[:, None], part[table]], axis=1), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == part.max():
            break
        part = new
    firsts = np.unique(part, return_index=True)[1]
    order = np.argsort(firsts)  # the start's class comes first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[part[table[firsts[order]]]], accepts[firsts[order]]


@lru_cache(maxsize=4)
def scanner_of(rules: tuple[SecretRule, ...]) -> SecretScanner:
    """One for each Python worker and set of rules."""
    return SecretScanner(rules)


class SecretScanner:
    def __init__(self, rules: Sequence[SecretRule] = RULES):
        self.rules = list(rules)
        floor = Automaton([r.floor for r in rules], anywhere=True, sticky=True)
        self.floor = floor.rows()
        self.start = self.floor[0]
        self.hits = {id(self.floor[s]) for s in np.flatnonzero(floor.accepts).tolist()}
        every = Automaton([r.pattern for r in rules], anywhere=True)
        self.table, self.accepts = every.rows(), every.accepts.tolist()
        self.accept_of = {id(self.table[s]): a for s, a in enumerate(self.accepts) if a}
        self.own = [Automaton([r.pattern], anywhere=False) for r in rules]
        self.own_rows = [[r.tolist() for r in a.table] for a in self.own]
        self.heads = [Automaton([r.head], anywhere=False) if r.head else None for r in rules]

    def any(self, raw: bytes) -> bool:
        """One pass over the bytes, for all rules at once."""
        return id(reduce(getitem, raw, self.start)) in self.hits

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, sorted; none overlap within a rule."""
        last: dict[int, int] = {}
        seen, row, accept_of = 0, self.table[0], self.accept_of
        for at, byte in enumerate(raw):
            row = row[byte]
            a = accept_of.get(id(row))
            if a:
                seen |= a
                last[a] = at
        out = []
        for i, r in enumerate(self.rules):
            if seen >> i & 1:
                upto = max(at for a, at in last.items() if a >> i & 1) + 1
                out += [(s, e, i) for s, e in self._matches(i, raw, upto) if self._long_enough(i, raw, s, e)]
        return sorted(out)

    def _matches(self, i: int, raw: bytes, upto: int) -> Iterator[tuple[int, int]]:
        """Leftmost longest matches in turn; none ends beyond upto. A state at a place from which no match ends is remembered,
        so no later start goes the same way again: steps grow with the text, not with its square.
        """
        auto, rows = self.own[i], self.own_rows[i]
        accepts, dead, first = auto.accepts.tolist(), auto.dead, rows[0]
        hopeless: dict[int, bytearray] = {}
        at, size = 0, len(raw)
        while at < upto:
            s = first[raw[at]]
            if s == dead:
                at += 1
                continue
            k = at + 1
            end, way, since = (k, [], k + 1) if accepts[s] else (-1, [s], k)  # way: states from place since on, no match yet
            while k < size:
                s = rows[s][raw[k]]
                if s == dead:
                    break
                k += 1
                if accepts[s]:
                    end, since = k, k + 1
                    way.clear()
                elif s in hopeless and hopeless[s][k]:
                    break
                else:
                    way.append(s)
            if len(way) > SHORT:
                for place, s in enumerate(way, since):
                    if s not in hopeless:
                        hopeless[s] = bytearray(size + 1)
                    hopeless[s][place] = 1
            if end > 0:
                yield at, end
                at = end
            else:
                at += 1

    def _long_enough(self, i: int, raw: bytes, start: int, end: int) -> bool:
        r, head = self.rules[i], self.heads[i]
        if head is None:
            return end - start >= r.least
        s, value = 0, start  # the head's longest match stands before the value
        table, accepts = head.table, head.accepts
        for k in range(start, end):
            s = table[s, raw[k]]
            if s == head.dead:
                break
            if accepts[s]:
                value = k + 1
        return end - value >= r.least

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """Spans of a text in code points."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not self.any(raw):
            return []
        found = self.spans(raw)
        if len(raw) == len(text):
            return found
        before = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points that began up to each byte
        at = lambda k: int(before[k - 1]) if k else 0
        return [(at(s), at(e), i) for s, e, i in found]


def scanned(docs: DataFrame, rules: Sequence[SecretRule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, redacted): spans as kind:start:end joined by commas, by
    start, then in the order of the rules; redacted: the text with each span as [kind], or null where there is none.
    A null text counts as empty; repeated rows, and rows without an id, stay. Other columns are not looked at; an empty
    table gives an empty result.
    """
    rules = tuple(rules)
    base = len(BASE)
    if rules[:base] != BASE:
        raise ValueError("the base rules come first")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        names = [r.kind for r in rules]
        for b in slices(batches, "_text"):
            texts = b.column(1).to_pylist()
            found = [scanner.scan(t) for t in texts]
            said = lambda spans: ",".join(f"{names[i]}:{s}:{e}" for s, e, i in sorted(spans, key=lambda x: (x[0], x[2])))
            counts = [pa.array([sum(i == k for _, _, i in f) for f in found], pa.int64()) for k in range(base)]
            digest = [hashlib.sha256(said([x for x in f if x[2] < base]).encode()).hexdigest() for f in found]
            clean = [redacted(t, f, names) if f else None for t, f in zip(texts, found)]
            yield pa.record_batch([b.column(0), *counts, pa.array(digest, pa.string()), pa.array(map(said, found), pa.string()), pa.array(clean, pa.string())], ["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    schema = "_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def redacted(text: str, spans: Sequence[tuple[int, int, int]], names: Sequence[str]) -> str:
    """Overlapping spans become one, named by the first."""
    out, at = [], 0
    for s, e, i in sorted(spans, key=lambda x: (x[0], x[2])):
        if s >= at:
            out += [text[at:s], f"[{names[i]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text", rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """docs, row for row and with its columns, with secrets in text_col replaced. A null text stays null."""
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kinds = scanner_of(tuple(rules)), [r.kind for r in rules]
        for b in slices(batches, text_col):
            k = b.schema.get_field_index(text_col)
            texts = [t if t is None or not (f := scanner.scan(t)) else redacted(t, f, kinds) for t in b.column(k).to_pylist()]
            yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema).select(*names)
