"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_]+(?:[-'][\\p{L}\\p{N}_]+)*"
#: Common English words that retrieval leaves out.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


#: Runs of white space, Unicode's and the information separators; the same in Java's and in RE2's patterns.
SPACE = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def norm_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def word_grams(ts: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces; none where there are fewer. ts: a column that is there already."""
    starts = F.when(F.size(ts) >= n, F.sequence(F.lit(1), F.size(ts) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ts, i, n), " "))


def gram_keys(ts: Column, n: int) -> Column:
    """A 128-bit key (two longs) of each run of n tokens, from the tokens' own hashes; none where there are fewer."""
    hashed = F.get(F.transform(F.array(ts), lambda w: F.struct(F.transform(w, lambda t: F.xxhash64(t)).alias("a"), F.transform(w, lambda t: F.xxhash64(F.lit(n), t)).alias("b"))), F.lit(0))
    starts = lambda h: F.when(F.size(h["a"]) >= n, F.sequence(F.lit(1), F.size(h["a"]) - (n - 1))).otherwise(F.array().cast("array<int>"))
    key = lambda h, i: F.struct(F.xxhash64(F.slice(h["a"], i, n)).alias("a"), F.xxhash64(F.slice(h["b"], i, n)).alias("b"))
    return F.get(F.transform(F.array(hashed), lambda h: F.transform(starts(h), lambda i: key(h, i))), F.lit(0))


def chunks(c: Column, size: int = 350, overlap: int = 50, least: int = 20) -> Column:
    """A text of up to size words as it is, however short; a longer one as windows of size words, overlapping, of which later
    ones of fewer than least words are left out.
    """
    ws = F.split(norm_space(c), " ")
    starts = F.when(F.size(ws) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(size - overlap)))
    every = F.transform(F.array(ws), lambda w: F.transform(F.filter(starts, lambda i: (i == 0) | (F.size(w) - i >= least)), lambda i: F.slice(w, i + 1, size)))[0]
    return F.transform(every, lambda w: F.array_join(w, " "))
