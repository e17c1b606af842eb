"""URL filters: host and path rules, and for URLs that no rule fits two character language models.

The models are smoothed variable-order Markov models over the bytes of URLs that rules allow and of URLs that rules block.
Every context of up to ORDER bytes counts, however rare, so models grow with the input: they are tables, and what a byte
says after the bytes before it (a window) is joined from them, order by order. All rows with a rule are counted, but for
one of HELD_OUT, which calibrate the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, discard, fresh, slices, table_path, written

ORDER = 5
#: Contexts of an order, and bytes a context must hold to count: no limit.
CONTEXTS, LEAST = math.inf, 1
#: A window that holds one of so many parts of all bytes is looked up in its task instead of being joined.
HOT = 4096
#: A window's log ratio is added up as a whole number of these parts, so sums don't depend on their order.
UNIT = 1 << 32
HELD_OUT = 5
#: Held-out scores are counted by steps of 1 / STEPS, from -RANGE to RANGE.
STEPS, RANGE = 500, 8.0
#: Weight of the ridge that keeps the calibration finite where scores part the two sides.
RIDGE = 1e-3

#: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the host or a domain above it and whose path begins the path."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _windows(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, window, order bytes before it in its URL, ORDER at most) for each byte, a slice of the bytes at a time. A window
    is a byte and the ORDER bytes before it, nine bits each, the byte itself lowest; zero where there is none. A line end
    closes each URL.
    """
    texts = [x.encode() + b"\n" for x in col.to_pylist()]
    sizes = np.array([len(x) for x in texts], np.int64)
    data, begin = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    step = max(1, SLICE_BYTES // 8)
    for at in range(0, len(data), step):
        before, end = min(at, ORDER), min(len(data), at + step)
        d, row = data[at - before : end].astype(np.int64) + 1, np.searchsorted(begin, np.arange(at, end), side="right") - 1
        place = np.arange(at, end) - begin[row]
        code = d[before:].copy()
        for j in range(1, ORDER + 1):
            has = place >= j
            code[has] += d[np.flatnonzero(has) + before - j] << (9 * j)
        yield row, code, np.minimum(place, ORDER)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, good, bad, n): windows and how often they are in URLs that teach the allowed, the blocked, and in all."""
    for batch in slices(batches, "url"):
        weights = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("good", "bad", "n")]
        for row, code, _ in _windows(batch.column(batch.schema.get_field_index("url"))):
            kinds, at = np.unique(code, return_inverse=True)
            sums = [np.zeros(len(kinds), np.int64) for _ in weights]
            for total, w in zip(sums, weights):
                np.add.at(total, at, w[row])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, sums)], names=["code", "good", "bad", "n"])


def _looked_up(batches: Iterator[pa.RecordBatch], codes: np.ndarray, ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, code, ratio): a row for each byte whose window is to be joined, and one for each URL's others, put together."""
    for batch in slices(batches, "url"):
        ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
        for row, code, _ in _windows(batch.column(batch.schema.get_field_index("url"))):
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hot = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            rows = np.unique(row)
            total = np.zeros(len(rows), np.int64)
            if hot.any():
                np.add.at(total, np.searchsorted(rows, row[hot]), ratios[at[hot]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[~hot]]), pa.array(code[~hot]), pa.array(np.zeros((~hot).sum(), np.int64))], names=["id", "code", "ratio"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(-1 - ids[rows]), pa.array(total)], names=["id", "code", "ratio"])


def ratios(windows: DataFrame) -> DataFrame:
    """(code, n, ratio) of windows (code, good, bad, n): the log of the byte's chance among the allowed over that among the
    blocked, in UNITs. Witten-Bell: each order is mixed with the one below, lastly 1 / 256. The chances of one order's
    strings are joined from those with a byte less, so at most 256 rows share a key.
    """
    sides = ("good", "bad")
    chances = None
    for order in range(ORDER + 1):
        low = F.lit((1 << (9 * (order + 1))) - 1)
        here = windows.groupBy(F.col("code").bitwiseAND(low).alias("c")).agg(*[F.sum(s).alias(s) for s in sides]).withColumn("ctx", F.shiftright("c", 9))
        # a context that a URL's beginning cuts short is none: the order below stands for it
        whole = (F.col("ctx") >= (1 << (9 * (order - 1)))) if order else F.lit(True)
        held = here.where(whole).groupBy("ctx").agg(*[F.sum(s).alias(f"{s}_total") for s in sides], *[F.count_if(F.col(s) > 0).alias(f"{s}_kinds") for s in sides])
        here = here.join(held, "ctx", "left")
        if chances is None:
            here = here.withColumns({f"{s}_p": F.lit(1 / 256) for s in sides})
        else:
            here = here.withColumn("short", F.col("c").bitwiseAND(F.lit((1 << (9 * order)) - 1))).join(chances, "short")
        mixed = {s: F.when(F.col(f"{s}_total") > 0, (F.col(s) + F.col(f"{s}_kinds") * F.col(f"{s}_p")) / (F.col(f"{s}_total") + F.col(f"{s}_kinds"))).otherwise(F.col(f"{s}_p")) for s in sides}
        chances = here.select(F.col("c").alias("short"), *[p.alias(f"{s}_p") for s, p in mixed.items()])
    ratio = F.round((F.log("good_p") - F.log("bad_p")) * UNIT).cast("long").alias("ratio")
    return windows.select("code", "n").join(chances.select(F.col("short").alias("code"), ratio), "code")


def scores(urls: DataFrame) -> DataFrame:
    """(id, score) of urls (id, url, n rows, of which good and bad teach): the mean over the URL's bytes (and its end) of the
    log of the two chances' ratio; more than 0: likelier allowed. 0 for all if one side has no rows to teach it.
    """
    taught = urls.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if not taught.good or not taught.bad:
        return urls.select("id", F.lit(0.0).alias("score"))
    spark = urls.sparkSession
    counted = written(urls.select("url", "good", "bad", "n").mapInArrow(_counted, "code long, good long, bad long, n long").groupBy("code").agg(*[F.sum(c).alias(c) for c in ("good", "bad", "n")]))
    table = written(ratios(counted))
    everything = table.agg(F.sum("n").alias("n")).first().n
    often = F.col("n") >= everything / HOT
    hot = table.where(often).select("code", "ratio").orderBy("code").toPandas()  # HOT rows at most
    codes, values = hot.code.to_numpy(np.int64), hot.ratio.to_numpy(np.int64)
    bytes_ = urls.select("id", "url").mapInArrow(lambda batches: _looked_up(batches, codes, values), "id long, code long, ratio long")
    joined = bytes_.join(table.where(~often).select("code", F.col("ratio").alias("rare")), "code", "left")
    sums = joined.groupBy("id").agg(F.sum(F.coalesce("rare", "ratio")).alias("total"))
    out = written(sums.join(urls.select("id", (F.octet_length("url") + 1).alias("size")), "id").select("id", F.round(F.col("total") / UNIT / F.col("size"), 6).alias("score")))
    discard(spark, table_path(counted), table_path(table))
    return out


def calibrate(bins: Sequence[tuple[float, int, int]]) -> tuple[float, float]:
    """(a, b) of the logistic 1 / (1 + exp(-(a * score + b))) from (score, allowed, blocked) counts. Both sides weigh the
    same, however many URLs each has. Without URLs of both sides, (1, 0).
    """
    x = np.array([r[0] for r in bins], float)
    good, bad = (np.array([r[i] for r in bins], float) for i in (1, 2))
    if not len(x) or not good.sum() or not bad.sum():
        return 1.0, 0.0
    good, bad = good / good.sum(), bad / bad.sum()
    z, w = np.stack([x, np.ones_like(x)]), np.array([1.0, 0.0])
    prior, ridge = np.array([1.0, 0.0]), RIDGE * np.eye(2)
    loss = lambda w: (good * np.logaddexp(0, -w @ z) + bad * np.logaddexp(0, w @ z)).sum() + (w - prior) @ ridge @ (w - prior) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -500, 500)))
        slope = z @ ((good + bad) * p - good) + ridge @ (w - prior)
        step, size = np.linalg.solve((z * ((good + bad) * p * (1 - p))) @ z.T + ridge, slope), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def filtered(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), score and p_allow. A URL that no rule fits is allowed if its
    calibrated chance is 0.5 or more. Null and empty URLs are scored as empty ones. URLs that rules settle teach the models
    and keep their rule's verdict; if rules settle none of one side, scores are 0 and the rest is allowed. Columns of these
    names are replaced, others stay; repeated rows are judged alike; an empty table gives an empty result.
    """
    made = ("host", "path", "rule", "verdict", "score", "p_allow")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    teaches = lambda says: F.when((F.col("verdict") == says) & ~F.col("held"), F.col("n")).otherwise(0)
    every = pages.groupBy(F.coalesce(F.col(url_col), F.lit("")).alias("url")).agg(F.count("*").alias("n"))
    every = every.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).select("url", "n", verdict.alias("verdict"), held.alias("held"))
    every = written(every.withColumns({"good": teaches("allow"), "bad": teaches("block"), "id": F.monotonically_increasing_id()}))
    found = every.join(scores(every), "id")
    step = F.round(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), "score")) * STEPS) / STEPS
    counts = [F.sum(F.when(F.col("verdict") == says, F.col("n")).otherwise(0)).alias(name) for says, name in (("allow", "good"), ("block", "bad"))]
    bins = found.where("held AND verdict IS NOT NULL").groupBy(step.alias("s")).agg(*counts)
    a, b = calibrate([(r.s, r.good, r.bad) for r in bins.orderBy("s").collect()])
    name, key = fresh(pages, "url_score"), fresh(pages, "url_key")
    rows = pages.join(found.select(F.col("url").alias(key), F.col("score").alias(name)), F.coalesce(F.col(url_col), F.lit("")) == F.col(key), "left")
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made or c == url_col]
    p = 1 / (1 + F.exp(-(F.lit(a) * F.col(f"`{name}`") + F.lit(b))))
    rows = rows.select(*keep, host.alias("host"), path.alias("path"), F.col(f"`{name}`").alias("score"), p.alias("p_allow"))
    return rows.select("*", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")).alias("verdict"))
