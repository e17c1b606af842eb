"""Quality rules as a short-circuit cascade of native column expressions."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows on which cost and selectivity are estimated, about.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """fails: true where a document is rejected."""

    name: str
    fails: Column


def words(text: Column) -> Column:
    """The runs [^ \\t-\\r]+ of a text."""
    return F.array_remove(F.split(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)), " ", -1), "")


def hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def windows(hashed: Column, window: int = WINDOW) -> Column:
    """A 64-bit key for each window of so many words, from the words' 64-bit hashes (a column that is there already)."""
    n = F.size(hashed)
    some = F.transform(F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashed, i, window)))
    return F.when(n >= window, some).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it, and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated(keys: Column) -> Column:
    """Positions, ascending, of the keys that are there twice or more."""
    pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    same = lambda s: F.filter(s, lambda x, j: F.get(s, j - 1)["k"].eqNullSafe(x["k"]) | F.get(s, j + 1)["k"].eqNullSafe(x["k"]))
    return let(pairs, lambda s: F.array_sort(F.transform(same(s), lambda x: x["i"])))


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more in the text, the first included. Windows are
    compared by the 64-bit hash of their words' hashes; a text without a repeated hash costs no more than the hashing.
    """
    most = lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered(repeated(keys), window)).otherwise(F.lit(0).cast("bigint"))
    return let(let(hashes(ws), lambda h: windows(h, window)), most)


def covered(positions: Column, window: int = WINDOW) -> Column:
    """Words that windows at these ascending positions cover."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["total"] + window - F.greatest(F.lit(0), acc["end"] - i)).cast("bigint").alias("total"), (i + window).alias("end"))
    return F.aggregate(positions, start, step, lambda acc: acc["total"])


def _measures(ws: Column, ls: Column, text: Column) -> dict[str, Column]:
    """Each measure by name, from the words, the lines that hold one, and the text."""
    return {
        "n_words": F.size(ws).cast("bigint"),
        "word_chars": F.char_length(F.array_join(ws, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint"),
        "n_lines": F.size(ls).cast("bigint"),
        "n_repeat_words": repeat_words(ws),
    }


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def _apart(docs: DataFrame, text_col: str) -> DataFrame:
    """(row: the columns of docs, text, words, barrier): nothing of docs can clash with what is worked out."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the barrier is not deterministic, so filters stay above and words are worked out once
    return df.select("row", "text", words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("barrier"))


def base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def rules(m: dict[str, Column], text: Column) -> list[Rule]:
    """m: measures. Rejected: much punctuation of markup, tables or shouting; odd word lengths; text that is mostly repeated lines."""
    n = m["n_words"]
    letters = F.char_length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    capitals = F.regexp_count(text, F.lit("\\p{Lu}"))
    return [
        Rule("few_words", n < 20),
        Rule("repeated_windows", 100 * m["n_repeat_words"] > 30 * n),
        Rule("symbols", 100 * m["n_symbols"] > 10 * n),
        Rule("word_length", (m["word_chars"] < 2 * n) | (m["word_chars"] > 14 * n)),
        Rule("repeated_lines", (m["n_dup_lines"] * 2 > m["n_lines"]) & (m["n_dup_lines"] >= 4)),
        Rule("capitals", 100 * capitals > 25 * letters),
        Rule("exclamations", 100 * F.regexp_count(text, F.lit("!!")) > 10 * n),
        Rule("stutter", 100 * F.regexp_count(text, F.lit("(?<!\\S)(\\S+)\\s+(?=\\1(?!\\S))")) > 20 * n),
        Rule("few_letters", 100 * letters < 50 * m["word_chars"]),
    ]


def _sampled(docs: DataFrame, text_col: str, rows: int) -> DataFrame:
    """About so many texts, taken by a hash from the whole table, with their words, dealt evenly."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    share = int((1 << 20) * min(1.0, rows / max(docs.count(), 1))) + 1
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)
    return some.repartition(docs.sparkSession.sparkContext.defaultParallelism).select("text", words(F.col("text")).alias("words"))


def ordered(docs: DataFrame, text_col: str = "text", given: Callable[[dict[str, Column], Column], list[Rule]] = rules, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejection per cost, highest first. On a hash sample each is counted and timed with all that it
    needs (the lesser of two runs, less that of a run without a rule). Only the order depends on it, never a verdict.
    """
    text = F.col("text")
    every = given(_measures(F.col("words"), _lines(text), text), text)
    sample = _sampled(docs, text_col, rows).cache()
    try:
        n = sample.count()
        if not n:
            return [r.name for r in every]

        def run(c: Column) -> tuple[int, float]:
            best = float("inf")
            for _ in range(2):
                began = time.perf_counter()
                hit = sample.agg(F.count(F.when(c, 1))).first()[0]
                best = min(best, time.perf_counter() - began)
            return hit, best

        run(F.col("words").isNull())  # code is compiled
        empty = run(F.col("words").isNull())[1]
        score = {}
        for r in every:
            hit, took = run(r.fails)
            score[r.name] = hit / n / max(took - empty, empty / 100)
    finally:
        sample.unpersist()
    return sorted(score, key=lambda name: (-score[name], name))


def cascade(order: Sequence[Rule]) -> Column:
    """True where no rule rejects. CASE evaluates its branches in order and stops at the first that holds, so what a later
    rule measures is not worked out for a text that an earlier one rejects.
    """
    out = F.lit(True)
    for r in reversed(order):
        out = F.when(F.coalesce(r.fails, F.lit(False)), F.lit(False)).otherwise(out)
    return out


def _by(order: Sequence[str], every: Sequence[Rule]) -> list[Rule]:
    named = {r.name: r for r in every}
    return [named[name] for name in order]


def assessed(docs: DataFrame, text_col: str = "text", given: Callable[[dict[str, Column], Column], list[Rule]] = rules, order: Sequence[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept (no rule rejects).

    Row for row; repeated rows stay; a null or empty text has no words and fails. Columns of docs of these names are
    replaced, all others stay. An empty table gives an empty result.
    """
    docs = spread(docs)
    order = ordered(docs, text_col, given) if order is None else order
    text = F.col("text")
    made = _measures(F.col("words"), _lines(text), text)
    df = _apart(docs, text_col).select("row", "text", "barrier", *[c.alias(f"m_{name}") for name, c in made.items()])
    m = {name: F.col(f"m_{name}") for name in made}
    out = {name: m[name] for name in made if name != "n_lines"} | {"base_failed": base_failed(m), "kept": cascade(_by(order, given(m, text)))}
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in out], *[c.alias(name) for name, c in out.items()])


def kept_documents(docs: DataFrame, text_col: str = "text", given: Callable[[dict[str, Column], Column], list[Rule]] = rules, order: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs as they are. Measures are worked out within the
    cascade, where a rule asks for them. Repeated rows stay; null, empty and short texts go.
    """
    docs = spread(docs)
    order = ordered(docs, text_col, given) if order is None else order
    text = F.col("text")
    kept = cascade(_by(order, given(_measures(F.col("words"), _lines(text), text), text)))
    return _apart(docs, text_col).where(kept & (F.col("barrier") >= 0)).select(*[F.col("row")[c].alias(c) for c in docs.columns])
