"""Invented names: pronounceable words made in parallel from a seed, and those among names that pass all rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..sources.tables import spread, written
from .questions import min_levenshtein, phrase_hits

# What the slots of a pattern take. C, V: consonants and vowels; K: last consonants; O, J: pairs at the beginning and within.
SLOTS = {
    "C": ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z"),
    "V": ("a", "e", "i", "o", "u"),
    "K": ("x", "l", "r", "k", "n", "m", "s", "t", "d", "p"),
    "O": ("br", "dr", "tr", "gr", "kr", "pl", "bl", "st", "sp"),
    "J": ("nd", "nt", "rv", "lv", "st", "sp"),
}
# Patterns with a pair at the beginning, with one within, without.
PATTERNS = (
    ("OVCVK", "OVCVCVK", "OVCVCV", "OVCVCVCVK", "OVCVCVCV"),
    ("CVJVK", "CVJVCVK", "CVJVCV", "CVJVCVCVK"),
    ("CVCVCVK", "CVCVCV", "CVCVCVCVK", "CVCVCVCV"),
)
SEED, ATTEMPTS = 42, 8


def _pick(options: Column, *what: Column) -> Column:
    """The one of options that the digest of what points to."""
    h = F.conv(F.substr(F.md5(F.concat_ws(":", *[w.cast("string") for w in what])), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.get(options, (h % F.size(options)).cast("int"))


def _array(values) -> Column:
    return F.array(*[_array(v) if isinstance(v, tuple) else F.lit(v) for v in values])


def tokens(key: Column, seed: int = SEED, attempts: int = ATTEMPTS) -> Column:
    """A capitalised invented word for each key: the first of so many tries that is pronounceable, null if none is. It depends
    on seed and key alone, so it is the same in any partition, and one row's tries cost the others nothing.
    """
    slots = F.create_map(*[x for k, v in SLOTS.items() for x in (F.lit(k), _array(v))])

    def word(attempt: Column) -> Column:
        kind = _pick(_array(PATTERNS), F.lit(seed), key, attempt, F.lit("kind"))
        pattern = _pick(kind, F.lit(seed), key, attempt, F.lit("pattern"))
        places = F.filter(F.split(pattern, ""), lambda s: s != "")
        return F.array_join(F.transform(places, lambda s, i: _pick(F.get(F.array(slots[s]), F.lit(0)), F.lit(seed), key, attempt, i)), "")

    first = lambda a, b: F.get(F.filter(F.transform(F.sequence(F.lit(a), F.lit(b)), word), names.pronounceable), F.lit(0))
    later = [first(1, attempts - 1)] if attempts > 1 else []  # made only where the first try fails
    return F.initcap(F.coalesce(first(0, 0), *later))


def accepted(valid: DataFrame, order: str, token: str) -> DataFrame:
    """The rows that a walk in order accepts: none that begins with the four letters of one accepted before, and two at most
    with the same first three. All that can stop a row shares its first three letters, and of those with the same four the
    first is the only one to be accepted; so it is the first of each four letters, and the first two of these by three. No
    group of names is gathered: both steps are partial aggregates. Orders differ.
    """
    four = valid.groupBy(F.substr(F.col(token), F.lit(1), F.lit(3)).alias("p3"), F.substr(F.col(token), F.lit(1), F.lit(4)).alias("p4")).agg(F.min(order).alias("o"))
    first = four.groupBy("p3").agg(F.min("o").alias("a"))
    second = four.join(first, "p3").where("o > a").groupBy("p3").agg(F.min("o").alias("b"))
    keep = first.select(F.col("a").alias(order)).unionByName(second.select(F.col("b").alias(order)))
    return valid.join(keep, order, "left_semi")


def judged(named: DataFrame, drugs: DataFrame, vocabulary: DataFrame, docs: DataFrame, rejected: tuple[str, ...] = (), order: str = "order") -> DataFrame:
    """named (order, name, kind) with token, a column for each rule, valid (all rules), and accepted (valid, and in order
    the first with its beginning). kind: drug or disease. drugs and vocabulary: word; docs: doc_id, text; rejected: names in
    lower case that are never valid. Null names are not valid.
    """
    n, token = F.col("name"), names.distinctive_token(F.col("name"))
    rows = written(named.select(order, "name", "kind", token.alias("token")))  # read for each rule, made once
    rows = rows.withColumn("pronounceable", F.coalesce(names.pronounceable(F.col("token")), F.lit(False)))
    drug = F.col("kind") == "drug"
    rows = rows.withColumn("no_stem", ~(drug & names.has_stem(n)) & ~F.when(drug, names.has_stem(F.col("token"))).otherwise(names.has_stem(F.col("token"), drug=False)))
    rows = rows.withColumn("not_rejected", ~F.lower(F.trim(n)).isin(*rejected, "") & ~F.col("token").isin(*rejected, ""))
    far = lambda words, name: min_levenshtein(rows.select("token"), words).select("token", (F.col("distance") >= 3).alias(name))
    rows = rows.join(far(drugs, "far_from_drugs"), "token", "left").join(far(vocabulary, "far_from_words"), "token", "left")
    hits = phrase_hits(rows.select(F.col("name").alias("phrase")).where("phrase IS NOT NULL"), docs).where("hits > 0").select("phrase", F.lit(True).alias("hit"))
    rows = rows.join(hits, F.trim(n) == F.col("phrase"), "left").withColumn("not_in_corpus", F.col("hit").isNull()).drop("hit", "phrase")
    rules = ("pronounceable", "no_stem", "not_rejected", "far_from_drugs", "far_from_words", "not_in_corpus")
    valid = F.lit(True)
    for r in rules:
        valid = valid & F.coalesce(F.col(r), F.lit(False))
    rows = written(rows.withColumn("valid", valid))
    chosen = accepted(rows.where("valid").select(order, "token"), order, "token").select(order, F.lit(True).alias("accepted"))
    return rows.join(chosen, order, "left").select(order, "name", "kind", "token", *rules, "valid", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def random_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A word for every part."""
    return spread(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")).select("p_partkey", tokens(F.col("p_partkey")).alias("token"))


def fabricated_names(spark: SparkSession, sf: str) -> DataFrame:
    """The invented words of all parts as names of drugs and diseases, judged against words of parts, passages and documents."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    key = F.col("p_partkey")
    named = random_tokens(spark, sf).select(key.alias("order"), F.when(key % 2 == 0, F.col("token")).otherwise(F.concat("token", F.lit(" syndrome"))).alias("name"), F.when(key % 2 == 0, "drug").otherwise("disease").alias("kind"))
    drugs = read("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    words = read("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    return judged(named, drugs, words, read("documents")).drop("kind")


def _list(values) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, tuple) else f"'{v}'" for v in values) + "]"


_H = lambda what: f"CAST(('0x' || substr(md5({SEED} || ':' || p_partkey || ':' || a || ':' || {what}), 1, 8)) AS BIGINT)"
_CONS = "[b-df-hj-np-tv-xz]"
_SAYABLE = f"""regexp_matches({{t}}, '^[a-z]{{{{6,10}}}}$') AND len(regexp_extract_all({{t}}, '[aeiouy]+')) BETWEEN 2 AND 4 AND NOT regexp_matches({{t}}, '{_CONS}{{{{3}}}}')
  AND len(list_filter(regexp_extract_all({{t}}, '{_CONS}+'), lambda r: length(r) = 2)) <= 1 AND len(list_filter(regexp_extract_all({{t}}, '{_CONS}+'), lambda r: length(r) = 2 AND r NOT IN {names.CLUSTERS})) = 0"""
_SLOT = " ".join(f"WHEN '{k}' THEN ({_list(v)})[{{h}} % {len(v)} + 1]" for k, v in SLOTS.items())
_TOKENS = f"""
SELECT p_partkey, upper(t[1]) || substr(t, 2) AS token FROM (
  SELECT p_partkey, first(t ORDER BY a) FILTER ({_SAYABLE.format(t='t')}) AS t FROM (
    SELECT p_partkey, a, array_to_string(list_transform(range(0, length(pattern)), lambda i: CASE pattern[i + 1] {_SLOT.format(h=_H('i'))} END), '') AS t FROM (
      SELECT p_partkey, a, kind[{_H("'pattern'")} % len(kind) + 1] AS pattern FROM (
        SELECT p_partkey, a, ({_list(PATTERNS)})[{_H("'kind'")} % {len(PATTERNS)} + 1] AS kind FROM part CROSS JOIN range({ATTEMPTS}) AS r(a)) AS k) AS p) AS w
  GROUP BY p_partkey) AS x"""
_FAR = lambda words: f"coalesce((SELECT min(levenshtein(token, word)) FROM {words} AS v) >= 3, true)"
_ENDS = lambda drug: f"{'|'.join(names.STEMS)}|({'|'.join(names.SUFFIX_STEMS)}{'|ine' if drug else ''})$"
_JUDGED = f"""
WITH t AS ({_TOKENS}),
n AS (SELECT p_partkey AS "order", CASE WHEN p_partkey % 2 = 0 THEN token ELSE token || ' syndrome' END AS name, p_partkey % 2 = 0 AS drug, lower(token) AS token FROM t),
dv AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), bv AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM benchmark),
td AS (SELECT token, min(levenshtein(token, word)) AS d FROM (SELECT DISTINCT token FROM n) CROSS JOIN dv GROUP BY token),
tb AS (SELECT token, min(levenshtein(token, word)) AS d FROM (SELECT DISTINCT token FROM n) CROSS JOIN bv GROUP BY token),
cw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
r AS (SELECT "order", name, token, {_SAYABLE.format(t='token')} AS pronounceable,
  NOT CASE WHEN drug THEN regexp_matches(lower(name), '{_ENDS(True)}') ELSE regexp_matches(token, '{_ENDS(False)}') END AS no_stem, true AS not_rejected,
  td.d >= 3 AS far_from_drugs, tb.d >= 3 AS far_from_words,
  (token NOT IN (SELECT word FROM cw)) OR (NOT drug AND NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || token || ' syndrome($|[^\\p{{L}}\\p{{N}}_])'))) AS not_in_corpus
  FROM n JOIN td USING (token) JOIN tb USING (token)),
v AS (SELECT *, pronounceable AND no_stem AND not_rejected AND far_from_drugs AND far_from_words AND not_in_corpus AS valid FROM r),
f AS (SELECT min("order") AS "order", token[1:3] AS p3 FROM v WHERE valid GROUP BY token[1:3], token[1:4]),
k AS (SELECT "order" FROM f QUALIFY row_number() OVER (PARTITION BY p3 ORDER BY "order") <= 2)
SELECT *, "order" IN (SELECT "order" FROM k) AS accepted FROM v"""

QUERIES = {"random_tokens": (random_tokens, _TOKENS), "fabricated_names": (fabricated_names, _JUDGED)}
