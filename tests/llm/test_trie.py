"""The prefix trie against a version that keeps every sequence in memory."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    kids = collections.defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved, out = {}, {}, set()
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in kids[s])
        ends = ",".join(str(c) for c in members[s] if len(full[c]) == len(s))
        out.add((members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(kids[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def conversations(seed=3):
    rng = random.Random(seed)
    say = lambda: rng.choice([None, "", "one two", "x", "three  four\nfive", "é" * 40])
    rows = []
    for c in [*range(0, 130), 400, 407, 419, 1005]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 5])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), say()))
    long = [(7, t, "user", "again and again") for t in range(60)]
    copies = [(c, t, "user", f"copy {t}") for c in range(2000, 2300) for t in range(5)]
    hot = [(c, 0, "user", "hello there") for c in range(3000, 3400)] + [(c, 1, "user", f"n {c % 3}") for c in range(3000, 3400)]
    rows += long + copies + hot + [(None, 1, "user", "nobody"), (5, 1, "user", "twice"), (5, 1, "user", "twice"), (9, 2, "user", "word " * 20_000)]
    rng.shuffle(rows)
    return rows


def got(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_trie_equals_brute_force(spark):
    rows = conversations()
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(40, 1, "user", "alone")], [(41, 0, "user", "no base"), (None, 0, "a", "b")], [(20, None, None, None), (21, None, None, None), (22, 5, "u", "x y")], [(c, t, "u", "same") for c in (100, 101) for t in range(12)]])
def test_trie_of_few_rows(spark, rows):
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_trie_ignores_other_columns(spark):
    rows = conversations(5)[:300]
    df = spark.createDataFrame([(*r, r[0], 1, "z", "k") for r in rows], SCHEMA + ", node long, depth int, key string, salt string")
    assert got(trie.prefix_trie(df)) == brute(rows)


def test_ends_of_a_hot_node_are_spread(spark, monkeypatch):
    n = 5000
    ends = spark.range(n).selectExpr("0L AS depth", "0L AS node", "id * 3 AS conv_id").repartition(9)
    want = hashlib.sha256(",".join(str(3 * i) for i in range(n)).encode()).hexdigest()
    assert [tuple(r) for r in trie.end_digests(ends).collect()] == [(0, 0, want)]
