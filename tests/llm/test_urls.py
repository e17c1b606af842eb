"""URL rules and character models against plain versions."""

import collections
import math
import random

import pytest
import xxhash

from tessera.llm import entries, urls

SF = "/root/testdata/sf0.01"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(c.lower() if c.isascii() else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


class Plain:
    """Counts of contexts in a dictionary, probabilities by recursion."""

    def __init__(self, texts):
        self.after = collections.defaultdict(collections.Counter)
        for t in texts:
            b = t.encode() + b"\n"
            for i in range(len(b)):
                for k in range(min(i, urls.ORDER) + 1):
                    self.after[b[i - k : i]][b[i]] += 1
        self.least = max(urls.LEAST, sum(self.after[b""].values()) / urls.CONTEXTS)

    def chance(self, ctx, byte):
        shorter = self.chance(ctx[1:], byte) if ctx else 1 / 256
        seen = self.after.get(ctx)
        if not seen or ctx and sum(seen.values()) < self.least:
            return shorter
        return (seen[byte] + len(seen) * shorter) / (sum(seen.values()) + len(seen))

    def log(self, t):
        b = t.encode() + b"\n"
        return [math.log(self.chance(b[max(0, i - urls.ORDER) : i], b[i])) for i in range(len(b))]


def pages():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeinorst", k=rng.randint(2, 8)))
    out = [None, "", "nothing", "://", "http://", "HTTP://A.EXAMPLE.ORG/es/1", "http://x.org", "http://x.org?/a", "ftp://org/", "http://example.org/en/12#/es/", "http://notexample.org/es/", "http://example.org.net/es/", "http://b.com/fr/x://y.org/", "http://É.ORG/É", "http://x.com:80/fr/", "a\nb://q.com/de/\nx", "http://long.net/" + "seg/" * 5000]
    out += [f"https://{word()}.{rng.choice(['example.org', 'a.org', 'b.com', 'c.net'])}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randint(1, 3000)}{rng.choice(['', '?q=' + word(), '.html', '#t'])}" for _ in range(900)]
    return [(i, u) for i, u in enumerate(out + out[:30])]


def test_rules_and_scores(spark, monkeypatch):
    rows = pages()
    df = spark.createDataFrame([(*r, "z", 1.0, 2) for r in rows], "page_id long, url string, Host string, score double, url_score int").repartition(5)
    got = {r.page_id: r for r in urls.filtered(df).collect()}
    assert len(got) == len(rows) and urls.filtered(df).columns == ["page_id", "url", "url_score", "host", "path", "score", "p_allow", "rule", "verdict"]
    known = collections.defaultdict(list)
    for i, u in rows:
        host, path = parts(u)
        rule, verdict = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == verdict
            h = xxhash.xxh64_intdigest(u.encode(), seed=42)
            if (h - (1 << 64) if h >> 63 else h) % urls.HELD_OUT:
                known[verdict].append(u)
        else:
            assert got[i].verdict == ("allow" if got[i].p_allow >= 0.5 else "block")
    good, bad = Plain(known["allow"]), Plain(known["block"])
    for i, u in [*rows[:16], *rows[17:120]]:
        a, b = good.log(u or ""), bad.log(u or "")
        assert got[i].score == pytest.approx((sum(a) - sum(b)) / len(a), abs=2e-6)
    monkeypatch.setattr(urls, "SLICE_BYTES", 800)  # long URLs in pieces, more slices
    assert {r.page_id: (r.score, r.verdict) for r in urls.filtered(df).collect()} == {i: (r.score, r.verdict) for i, r in got.items()}


def test_score_tells_held_out_urls_apart(spark):
    df = entries.op12_url_filters(spark, SF)
    rows = df.collect()
    ruled_rows = [r for r in rows if r.rule]
    right = sum((r.p_allow >= 0.5) == (r.verdict == "allow") for r in ruled_rows)
    assert len(rows) == 250 and right > 0.85 * len(ruled_rows)
    other = [r for r in rows if not r.rule]
    assert {r.verdict for r in other} == {"allow", "block"}


def test_calibration():
    assert urls.calibrate([]) == (1.0, 0.0) == urls.calibrate([(1.0, 5, 0)])
    a, b = urls.calibrate([(-1.0, 10, 90), (0.0, 50, 50), (1.0, 90, 10)])
    assert a > 1 and b == pytest.approx(0, abs=1e-6)
    a, b = urls.calibrate([(2.0, 1, 1000), (3.0, 9, 0)])  # sides weigh the same
    assert a * 2.2 + b < 0 < a * 2.8 + b


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://a.org/"), (2, "http://a.net/")], [(1, "http://a.net/x"), (None, "http://a.net/x")]])
def test_few_rows(spark, rows):
    got = urls.filtered(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and all(r.verdict == "allow" for r in got)


@pytest.mark.parametrize("hot", [1, 50, 1 << 40])
def test_rare_contexts_count(spark, monkeypatch, hot):
    monkeypatch.setattr(urls, "HOT", hot)  # windows are joined, both, or looked up
    common = [f"http://{a}.{s}/{p}/{i}" for i in range(400) for a, s, p in (("aaa", "org", "x"), ("aaa", "com", "de"))]
    rare = [f"http://zqzq{i}.org/" for i in range(8)]  # 8 of some 17,000 bytes are after zqzq
    asked = ["http://zqzq.net/", "http://aaa.net/", "http://other.net/é"]
    got = {r.url: r for r in urls.filtered(spark.createDataFrame([(u,) for u in common + rare + asked], "url string").repartition(3)).collect()}
    taught = lambda u: (h - (1 << 64) if (h := xxhash.xxh64_intdigest(u.encode(), seed=42)) >> 63 else h) % urls.HELD_OUT
    good, bad = Plain([u for u in common + rare if ".org/" in u and taught(u)]), Plain([u for u in common if ".com/" in u and taught(u)])
    good.least = bad.least = 1
    for u in asked:
        a, b = good.log(u), bad.log(u)
        assert got[u].score == pytest.approx((sum(a) - sum(b)) / len(a), abs=2e-6)
