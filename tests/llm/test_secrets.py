"""All kinds of secrets against regular expressions, very long texts, and rows that repeat."""

import random
import re
import time

from tessera.llm import secrets

SCHEMA = "doc_id long, text string"


def brute(text):
    out = []
    for r in secrets.RULES:
        for m in re.finditer(r.pattern, text, re.ASCII):
            value = m.start()
            if r.head:
                value = re.match(r.head, text[m.start() :]).end() + m.start()
            if m.end() - value >= r.least:
                out.append((r.kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], [r.kind for r in secrets.RULES].index(x[0])))


def texts(n=300):
    rng = random.Random(5)
    tail = lambda a, k: "".join(rng.choices(a, k=rng.randint(1, k)))
    word, hexa = "abcXYZ019_-", "0123456789abcdef"
    parts = [lambda: "eyJ" + tail(word, 20), lambda: ".eyJ" + tail(word, 12), lambda: "." + tail(word, 20), lambda: "ghp_" + tail(word[:9], 60), lambda: "hf_" + tail("aB3", 50), lambda: "xoxb-" + tail("a1-", 20), lambda: "-----BEGIN ", lambda: "RSA PRIVATE KEY-----", lambda: tail(hexa, 30), lambda: "AKIA" + tail("AZ09", 25), lambda: rng.choice(["password", "API_key", "toKen"]) + rng.choice([": ", "=", '" : "']) + tail(word, 25), lambda: " ", lambda: "\n", lambda: "é", lambda: "eyJ"]
    return ["".join(rng.choice(parts)() for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_spans_of_all_kinds():
    scanner, kinds = secrets.scanner_of(secrets.RULES), [r.kind for r in secrets.RULES]
    seen = set()
    for t in texts():
        got = sorted(((kinds[i], s, e) for s, e, i in scanner.scan(t)), key=lambda x: (x[1], kinds.index(x[0])))
        assert got == brute(t), t
        seen |= {k for k, _, _ in got}
    assert seen == set(kinds)


def test_steps_grow_with_the_text():
    scanner = secrets.scanner_of(secrets.RULES)
    took = []
    for n in (60_000, 240_000):
        t = "eyJ" * n + ".eyJ no token=0123456789ab " + "-----BEGIN " * (n // 4)
        began = time.process_time()
        spans = scanner.scan(t)
        took.append(time.process_time() - began)
        assert [(t[s:e], i) for s, e, i in spans] == [("token=0123456789ab", 0)]
    assert took[1] < 10 * took[0] + 0.5, took


def test_rows_repeat_and_clash(spark):
    rows = [(1, "token=abcdefghijkl"), (1, "token=abcdefghijkl"), (None, "token=abcdefghijkl"), (2, None), (3, ""), (4, "x" * 300_000 + " AKIA" + "A" * 14)]
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA + ", spans string, n_hex int").repartition(2)
    got = secrets.scanned(df)
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access, r.spans) for r in got.collect()) == [(0, 1, 0, "assign:0:18"), (1, 1, 0, "assign:0:18"), (1, 1, 0, "assign:0:18"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 0, 1, "access:300001:300019")]
    assert secrets.scanned(df.limit(0)).count() == 0
