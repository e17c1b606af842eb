"""Queries over raw model outputs, and the audits and gates that read texts, vectors and files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses as R
from ..functions import text as T
from ..functions.prompts import IDK
from ..plans.core import VIEWS, Plan, collect, view
from ..sources.tables import spread

view("outputs", """
SELECT conv_id, turn, role, CASE (conv_id * 3 + turn) % 12
  WHEN 0 THEN concat('<think>', t, '</think>', chr(10), 'Answer: B. see [1] and [3]')
  WHEN 1 THEN concat('The answer is C because ', t) WHEN 2 THEN concat('**D. ', t) WHEN 3 THEN t
  WHEN 4 THEN concat('<think>If the answer is A ', t) WHEN 5 THEN concat('Answer: none of the options. ', t)
  WHEN 6 THEN concat(t, ' Answer: maybe [2, 4][9]') WHEN 7 THEN '(b)'
  WHEN 8 THEN concat('<think>', t, '</think> x </think>Evidence: [2] [1], [2] and Evidence: [30] [1]')
  WHEN 9 THEN concat('I do not have enough information to answer this question. ', t)
  WHEN 10 THEN concat('Evidence: 3, 9 and 2', chr(10), t) ELSE concat('Answer: Insufficient, it cannot be determined ', t) END AS said
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM {conversations}) AS c""")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Plan("", "SELECT * FROM {outputs}")(spark, sf_dir)


def _said(name: str, column):
    """A query: column of each output."""
    return lambda s, sf: _outputs(s, sf).select("conv_id", "turn", column(F.col("said")).alias(name))


def _options():
    return F.create_map(*[F.lit(x) for x in ("A", "yes", "B", "no", "C", "maybe", "D", IDK)])


def _text(c):
    return F.coalesce(F.array_join(c, ","), F.lit("none"))


def spontaneous_refusal(spark, sf):
    o = _outputs(spark, sf).withColumn("refused", R.spontaneous_refusal(F.col("said")))
    return o.groupBy((F.col("conv_id") % 2 == 0).alias("should_abstain")).agg(F.count("*").alias("n"), F.count_if("refused").alias("refusals"))


def option_match(spark, sf):
    words = F.split("text", " ")
    some = F.array_join(F.slice(words, 3, 3), " ")
    option = F.when(F.col("doc_id") % 3 == 0, some).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("zz "), some)).otherwise("nothing of it")
    exact, rest = R.option_match(F.col("text"), option)
    return _read(spark, sf, "documents").select("doc_id", exact.alias("exact"), rest.alias("first_word_removed"), (exact | rest).alias("either"))


def answer_in_topk(spark, sf):
    q = Plan("", "SELECT * FROM {questions}")(spark, sf)
    passages = F.array(F.concat(F.lit("of "), F.col("options")["B"], F.lit(".")), F.upper(F.col("options")["D"]))
    return q.select("qid", F.coalesce(R.answer_in(passages, F.col("options")[F.col("answer")], F.col("dataset")).cast("string"), F.lit("unknown")).alias("found"))


def format_p(spark, sf):
    p = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, F.lit(0.0)).otherwise((1 + F.col("event_id") % 7) / F.lit(8.0) / F.pow(F.lit(10.0), F.col("event_id") % 9))
    return _read(spark, sf, "events").select("event_id", R.format_p(p).alias("p"))


def norm_text(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.md5(R.norm_text(F.col("text"))).alias("key"))


def word_13grams(spark, sf):
    grams = T.word_grams(F.col("ws"), 13)
    return _read(spark, sf, "benchmark").select("item_id", R.gram_words(F.col("text")).alias("ws")).select("item_id", F.size(F.array_distinct(grams)).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(F.array_distinct(grams)), "|")).alias("digest"))


def audit_ngram(train: DataFrame, test: DataFrame, n: int = 13) -> DataFrame:
    """(field, items, contaminated, ok) for question and options: test items that share a gram with a training text.

    train: text; test: item_id, question, options. Keys of the test's grams are few; the training side is filtered by them
    where it is read and no text is shuffled.
    """
    fields = test.select("item_id", F.explode(F.create_map(F.lit("question"), F.col("question"), F.lit("options"), F.col("options"))).alias("field", "text"))
    grams = lambda df, *key: df.select(*key, F.explode(T.gram_keys(R.gram_words(F.col("text")), n)).alias("g"))
    own = grams(fields, "item_id", "field")
    met = grams(train).join(own.select("g").distinct(), "g", "left_semi").distinct()
    hit = own.join(met, "g", "left_semi").groupBy("field").agg(F.countDistinct("item_id").alias("hits"))
    every = fields.groupBy("field").agg(F.countDistinct("item_id").alias("items")).join(hit, "field", "left")
    hits = F.coalesce("hits", F.lit(0)).cast("long")
    return every.select("field", "items", hits.alias("contaminated"), (hits == 0).alias("ok"))


def audit_ngram_query(spark, sf):
    options = F.array_join(F.slice(F.split("text", " "), 1, 15), " ")
    return audit_ngram(spread(_read(spark, sf, "documents").select("text")), _read(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), options.alias("options")))


def gate_index(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, sample: int = 5, k: int = 10) -> DataFrame:
    """(gate, ok) of an index. docs: doc_id; chunks: doc_id, chunk_id; vectors: vec_id, embedding. A sample of vectors is
    searched among all: some must find themselves. The sample is the feature, as in a self-check.
    """
    c = chunks.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"), F.countDistinct("doc_id").alias("with_chunk"))
    d = docs.agg(F.countDistinct("doc_id").alias("docs"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.agg(F.count("*").alias("vectors"), F.count_if(bad).alias("bad"))
    few = F.broadcast(vectors.orderBy("vec_id").limit(sample).select(F.col("vec_id").alias("q"), F.col("embedding").alias("e")))
    dot = F.aggregate(F.zip_with("e", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    own = vectors.join(few, F.col("vec_id") == F.col("q")).select("q", F.col("e"), dot.alias("own"))
    better = vectors.crossJoin(F.broadcast(own)).groupBy("q").agg(F.count_if(dot > F.col("own")).alias("above"))  # sample rows at most
    hits = better.agg(F.count_if(F.col("above") < k).alias("hits"))
    one = c.crossJoin(d).crossJoin(v).crossJoin(hits)  # a row each
    gates = {"chunks_cover_documents": "with_chunk >= docs", "chunk_ids_unique": "ids = n", "vectors_finite": "bad = 0", "vectors_find_themselves": "hits >= 1 OR vectors = 0"}
    return one.select(F.explode(F.create_map(*[x for name, sql in gates.items() for x in (F.lit(name), F.expr(sql))])).alias("gate", "ok"))


def gate_index_query(spark, sf):
    d = _read(spark, sf, "documents").where("text IS NOT NULL AND text <> ''")
    chunks = d.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("j", "chunk")).select("doc_id", F.concat_ws("-", "doc_id", "j").alias("chunk_id"))
    return gate_index(d, chunks, _read(spark, sf, "embeddings"))


def refuse_shards(paths: list[str]) -> list[str]:
    """The paths, none of which may be a shard's."""
    for p in paths:
        if "_shard" in os.path.basename(p.rstrip("/")):
            raise ValueError(f"shard files are never read: {p}")
    return paths


def text_anomalies(spark, sf):
    d = _read(spark, sf, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    return d.groupBy("source").agg(
        F.count_if(F.trim(F.regexp_replace("t", "\\s+", " ")) == "").alias("empty"),
        F.count_if(F.col("t").rlike("[ \\t]{2,}|\\r\\n|[\\u00a0\\u200b\\u200e\\ufeff]")).alias("irregular_space"),
        F.sum(F.char_length(F.regexp_replace("t", "[\\x00-\\x7f]+", ""))).alias("non_ascii"),
        F.sum(F.regexp_count("t", F.lit("�")).cast("long")).alias("replaced"),
    )


def numeric_noise(spark, sf):
    ts = _read(spark, sf, "documents").select("source", T.tokens(F.col("text")).alias("ts"))
    share = F.size(F.filter("ts", R.is_numeric_token)) / F.nullif(F.size("ts"), F.lit(0))
    return ts.groupBy("source").agg(F.count_if(share > 0.4).alias("noisy"))


def question_type(spark, sf):
    return _read(spark, sf, "conversations").groupBy(R.question_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


_O = f"({VIEWS['outputs'][1].replace('{conversations}', 'conversations')}) AS o"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_T = _STRIP.format("said")
_NO_THOUGHT = _STRIP.format("regexp_replace(said, '(?is)<think>.*?</think>', '', 'g')")
_NO_TAGS = _STRIP.format(f"regexp_replace({_NO_THOUGHT}, '(?i)</?think>', '', 'g')")
_L = "upper(regexp_extract({t}, '{p}', 1))".replace("{t}", _T)
_AFTER, _BARE = _L.replace("{p}", "(?i)answer(?:\\s+is)?\\W*([A-Za-z])\\b"), _L.replace("{p}", "^\\W*([A-Za-z])(?:[.):]|\\s*$|\\n)")
_NAMES = " ".join(f"WHEN regexp_matches(lower({_T}), 'answer\\W*{text.lower()}\\b') THEN '{k}'" for k, text in (("A", "yes"), ("B", "no"), ("C", "maybe"), ("ABSTAIN", IDK.replace(".", "[.]"))))
_D = "CASE WHEN {x} IN ('A', 'B', 'C') THEN {x} WHEN {x} = 'D' THEN 'ABSTAIN' END"
_ANSWER = f"coalesce({_D.replace('{x}', _AFTER)}, CASE {_NAMES} END, {_D.replace('{x}', _BARE)}, CASE WHEN contains(lower(said), '{IDK.lower()}') THEN 'ABSTAIN' END)"
_INTS = "list_transform(regexp_extract_all({0}, '\\b[0-9]+\\b'), lambda x: CAST(x AS BIGINT))"
_IN = _INTS.format("array_to_string(regexp_extract_all(said, '\\[([^\\]]+)\\]', 1), ' ; ')")
_LINE = _INTS.format("regexp_extract(said, '(?is)evidence\\s*:\\s*([^\\n]*)', 1)")
_BLOCK = "list_extract(regexp_extract_all(list_extract(string_split(said, '</think>'), -1), '(?i)Evidence\\s*:\\s*((?:\\[\\s*\\d+\\s*\\][\\s,;and]*)+)', 1), -1)"
_AFTER_ANSWER = "CASE WHEN regexp_matches(said, '(?i)Answer\\s*:') THEN regexp_extract(said, '(?is)Answer\\s*:\\s*(.*)', 1) ELSE said END"
_WORD = R.GRAM_WORD.replace("'", "''")
_WORDS = f"regexp_extract_all(lower(text), '{_WORD}')"
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+(?:[-''][\\p{L}\\p{N}_]+)*')"
_SOME = "array_to_string(string_split(text, ' ')[3:5], ' ')"
_FROM = f"SELECT conv_id, turn, {{0}} FROM {_O}"
_ANY = "regexp_matches(trim(coalesce(text, '')), '{}')"
_KIND = " ".join(f"WHEN {_ANY.format(p)} THEN '{k}'" for k, p in R.KINDS.items())
_N_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'))"
_P = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0e0 ELSE (1 + event_id % 7) / 8e0 / power(10e0, event_id % 9) END"

QUERIES = {
    "parse_answer": (_said("answer", lambda c: R.parse_answer(c, _options(), "D")), _FROM.format(f"{_ANSWER} AS answer")),
    "last_answer": (_said("answer", R.last_answer), _FROM.format("list_extract(list_filter(list_transform(regexp_extract_all(said, '(?i)answer\\W*([A-Za-z])\\b', 1), lambda x: upper(x)), lambda x: x IN ('A', 'B', 'C', 'D', 'E')), -1) AS answer")),
    "close_think": (_said("closed", lambda c: F.md5(R.close_think(c))), _FROM.format("md5(CASE WHEN len(regexp_extract_all(said, '(?i)<think>')) > len(regexp_extract_all(said, '(?i)</think>')) THEN said || chr(10) || '</think>' ELSE said END) AS closed")),
    "strip_think": (_said("rest", lambda c: F.md5(R.strip_think(c))), _FROM.format(f"md5({_NO_TAGS}) AS rest")),
    "final_segment": (_said("segment", lambda c: F.md5(R.final_segment(c))), _FROM.format("md5(CASE WHEN regexp_matches(said, '(?i)</think>') THEN list_extract(string_split_regex(said, '(?i)</think>'), -1) WHEN regexp_matches(said, '(?i)<think>') THEN '' ELSE said END) AS segment")),
    "parse_citations": (_said("cites", lambda c: _text(R.parse_citations(c, 5))), _FROM.format(f"array_to_string(list_sort(list_distinct(list_filter(CASE WHEN len({_IN}) > 0 THEN {_IN} ELSE {_LINE} END, lambda x: x BETWEEN 1 AND 5))), ',') AS cites")),
    "final_cites": (_said("cites", lambda c: _text(R.final_cites(c))), _FROM.format(f"coalesce(array_to_string(list_sort(list_distinct({_INTS.format(_BLOCK)})), ','), 'none') AS cites")),
    "verbal_abstention": (_said("abstains", R.verbal_abstention), _FROM.format(f"regexp_matches({_AFTER_ANSWER}, '(?i)^\\s*[*_`\"''#\\s]*(none|insufficient|not\\s+enough|cannot)\\b') AS abstains")),
    "spontaneous_refusal": (spontaneous_refusal, f"SELECT conv_id % 2 = 0 AS should_abstain, count(*) AS n, count(*) FILTER (lower(said) LIKE '%none of the%' OR lower(said) LIKE '%cannot be determined%' OR lower(said) LIKE '%not enough information%') AS refusals FROM {_O} GROUP BY 1"),
    "option_match": (
        option_match,
        f"SELECT doc_id, e AS exact, r AS first_word_removed, e OR r AS either FROM (SELECT doc_id, doc_id % 3 = 0 AND trim({_SOME}, ' ' || chr(9) || chr(10)) <> '' AS e, doc_id % 3 < 2 AND length(rest) >= 3 AND contains(lower(text), rest) OR doc_id % 3 = 2 AND contains(lower(text), 'of it') AS r FROM (SELECT doc_id, text, lower(regexp_replace(CASE WHEN doc_id % 3 = 1 THEN {_STRIP.format(_SOME)} ELSE regexp_replace({_STRIP.format(_SOME)}, '^\\S+\\s*', '') END, '\\s+', ' ', 'g')) AS rest FROM documents) AS d) AS x",
    ),
    "answer_in_topk": (answer_in_topk, Plan("", "", "SELECT qid, coalesce(CAST(CASE WHEN dataset = 'medqa' AND length(options[answer]) >= 4 THEN contains(lower('of ' || options['B'] || '.'), lower(options[answer])) OR contains(lower(options['D']), lower(options[answer])) END AS VARCHAR), 'unknown') AS found FROM {questions}").oracle()),
    "loop_suspect": (_said("loops", R.loop_suspect), None),
    "format_p": (format_p, f"SELECT event_id, CASE WHEN p IS NULL THEN 'n/a' WHEN p < 1e-300 THEN '< 1e-300' WHEN p < 0.001 THEN printf('%.2e', p) ELSE printf('%.5f', p) END AS p FROM (SELECT event_id, {_P} AS p FROM events) AS e"),
    "norm_text": (norm_text, "SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+'), lambda w: w <> ''), ' ')) AS key FROM documents"),
    "word_13grams": (word_13grams, f"SELECT item_id, count(DISTINCT g) AS n, md5(coalesce(string_agg(DISTINCT g, '|' ORDER BY g), '')) AS digest FROM (SELECT item_id, CASE WHEN i <= len(ws) - 12 THEN array_to_string(ws[i : i + 12], ' ') END AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark))) GROUP BY item_id"),
    "audit_ngram": (
        audit_ngram_query,
        f"WITH side AS (SELECT 'train' AS field, doc_id AS id, {_WORDS} AS ws FROM documents UNION ALL SELECT 'question', item_id, {_WORDS} FROM benchmark UNION ALL SELECT 'options', item_id, {_WORDS} FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:15], ' ') AS text FROM benchmark) AS b), g AS (SELECT DISTINCT field, id, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT field, id, ws, unnest(range(1, len(ws) - 11)) AS i FROM side)) SELECT s.field, count(DISTINCT s.id) AS items, count(DISTINCT h.id) AS contaminated, count(DISTINCT h.id) = 0 AS ok FROM side s LEFT JOIN (SELECT DISTINCT a.field, a.id FROM g a JOIN g b ON a.g = b.g AND b.field = 'train' AND a.field <> 'train') AS h ON s.field = h.field AND s.id = h.id WHERE s.field <> 'train' GROUP BY s.field",
    ),
    "gate_index": (
        gate_index_query,
        f"""
WITH d AS (SELECT doc_id, len(string_split(trim(regexp_replace(text, '{T.SPACE}', ' ', 'g')), ' ')) AS n FROM documents WHERE text <> ''),
c AS (SELECT doc_id, n, unnest(range(0, n, 300)) AS i FROM d), kept AS (SELECT doc_id, i FROM c WHERE i = 0 OR n > 350 AND n - i >= 20),
few AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 5),
a AS (SELECT f.vec_id, count(*) FILTER (list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) > list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[]))) AS above FROM few f CROSS JOIN embeddings e GROUP BY f.vec_id)
SELECT unnest(['chunks_cover_documents', 'chunk_ids_unique', 'vectors_finite', 'vectors_find_themselves']) AS gate, unnest([
  (SELECT count(DISTINCT doc_id) FROM kept) >= (SELECT count(DISTINCT doc_id) FROM d), (SELECT count(*) = count(DISTINCT concat(doc_id, '-', i)) FROM kept),
  (SELECT count(*) = 0 FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0), (SELECT count(*) FILTER (above < 10) >= 1 FROM a)]) AS ok""",
    ),
    "text_anomalies": (text_anomalies, "SELECT source, count(CASE WHEN trim(regexp_replace(t, '\\s+', ' ', 'g')) = '' THEN 1 END) AS empty, count(CASE WHEN regexp_matches(t, '[ \\t]{2,}|\\r\\n|[\\x{a0}\\x{200b}\\x{200e}\\x{feff}]') THEN 1 END) AS irregular_space, CAST(sum(length(regexp_replace(t, '[\\x00-\\x7f]+', '', 'g'))) AS BIGINT) AS non_ascii, CAST(sum(len(regexp_extract_all(t, '\\x{fffd}'))) AS BIGINT) AS replaced FROM (SELECT source, coalesce(text, '') AS t FROM documents) AS d GROUP BY source"),
    "numeric_noise": (numeric_noise, f"SELECT source, count(CASE WHEN len(list_filter(ts, lambda x: regexp_matches(x, '^[0-9]+([.,][0-9]+)*(%|[a-zA-Z]+)?$'))) > 0.4e0 * len(ts) THEN 1 END) AS noisy FROM (SELECT source, {_TOK} AS ts FROM documents) AS d GROUP BY source"),
    "question_type": (question_type, f"SELECT CASE WHEN {_N_WORDS} = 0 THEN 'unclear' WHEN {_ANY.format('(?i)' + R.GREETING)} AND NOT {_ANY.format('|'.join(R.KINDS.values()))} THEN 'greeting' WHEN {_N_WORDS} <= 2 THEN 'unclear' {_KIND} ELSE 'general_info' END AS kind, count(*) AS n FROM conversations GROUP BY 1"),
} | collect(
    Plan(
        "tune_tau_idk",
        """
WITH seen AS (
  SELECT model, confidence AS tau, sum(CASE WHEN should_abstain THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN should_abstain THEN 0 ELSE 1 END) AS neg
  FROM {runs} WHERE split = 'validation' GROUP BY model, confidence
), below AS (
  SELECT model, tau, sum(pos) OVER (PARTITION BY model ORDER BY tau) - pos AS tp, sum(neg) OVER (PARTITION BY model ORDER BY tau) - neg AS fp,
    sum(pos) OVER (PARTITION BY model) AS every FROM seen
), f AS (SELECT model, tau, 2e0 * tp / (tp + fp + every) AS f1 FROM below)
SELECT model, tau, coalesce(f1, 0e0) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY coalesce(f1, 0e0) DESC, tau) AS k FROM f) AS x WHERE k = 1""",
    ),
)
