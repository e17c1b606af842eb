"""Cleaning, chunking, retrieval, audits and parsing over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.core import Plan, collect
from ..sources.tables import spread
from .similar import dense_topk, document_pairs, jaccard_pairs

K1, B = 1.5, 0.75


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.md5(T.norm_space(F.col("text"))).alias("space"), F.md5(T.norm_key(F.col("text"))).alias("key"))


def dedup_corpus(spark, sf):
    """The least id of each normalised text; the digest, not the text, is shuffled."""
    return _read(spark, sf, "documents").groupBy(F.md5(T.norm_key(F.col("text"))).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def chunk_docs(spark, sf):
    d = spread(_read(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("j", "chunk")).select("doc_id", "j", F.md5("chunk").alias("chunk_md5"))


def tokenize(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("tokens_md5"))


def vocabulary(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)
    return _read(spark, sf, "documents").select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, doc_id, score, rank). docs: doc_id, text; queries: item_id, text. Postings hold only the queries' terms: the
    terms of all documents are filtered by them before they are counted, and counted before they are shuffled.
    """
    stop = F.array(*map(F.lit, T.STOPWORDS))
    q = queries.select("item_id", F.explode(F.array_distinct(F.array_except(T.tokens(F.col("text")), stop))).alias("term"))
    d = docs.select("doc_id", T.tokens(F.col("text")).alias("ts"))
    sizes = d.select("doc_id", F.size("ts").alias("len"))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    terms = d.select("doc_id", F.size("ts").alias("len"), F.explode("ts").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = terms.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(stats)).select("doc_id", "term", part.alias("w"))  # stats is one row
    scores = weighed.join(q, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_topk(spark, sf):
    return bm25(spread(_read(spark, sf, "documents").select("doc_id", "text")), _read(spark, sf, "benchmark"))


def ngram13_overlap(spark, sf):
    """Shared 13-grams of documents and benchmark passages: 128-bit keys of grams are joined, and no gram is written out."""
    def grams(df, key):
        return df.select(key, F.explode(T.gram_keys(T.tokens(F.col("text")), 13)).alias("g"))

    d, b = grams(spread(_read(spark, sf, "documents").select("doc_id", "text")), "doc_id"), grams(_read(spark, sf, "benchmark"), "item_id").distinct()
    return d.join(b, "g").groupBy("doc_id", "item_id").agg(F.count_distinct("g").alias("shared"))


def stream_runs(spark, sf):
    """New events, appended once by id: a stream over a folder, through to its end."""
    from ..streaming.runs import ingest

    return ingest(spark, f"{sf}/events.parquet")


_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+(?:[-''][\\p{L}\\p{N}_]+)*')"
_SPACE_DUCK = f"trim(regexp_replace(text, '{T.SPACE}', ' ', 'g'))"
_KEY_DUCK = "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"

QUERIES = {
    "norm_space": (norm, f"SELECT doc_id, md5({_SPACE_DUCK}) AS space, md5({_KEY_DUCK}) AS key FROM documents"),
    "dedup_corpus": (dedup_corpus, f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5({_KEY_DUCK})"),
    "chunk_docs": (
        chunk_docs,
        f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS j, md5(array_to_string(ws[i + 1 : i + 350], ' ')) AS chunk_md5
FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 300)) AS i FROM (SELECT doc_id, string_split({_SPACE_DUCK}, ' ') AS ws FROM documents))
WHERE i = 0 OR len(ws) > 350 AND len(ws) - i >= 20""",
    ),
    "tokenize": (tokenize, f"SELECT doc_id, CAST(len({_TOK}) AS INT) AS n_tokens, md5(array_to_string({_TOK}, ' ')) AS tokens_md5 FROM documents"),
    "vocabulary": (vocabulary, "SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents) GROUP BY word"),
    "bm25_topk": (bm25_topk, f"WITH d AS (SELECT doc_id, {_TOK} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM d), q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) WHERE NOT list_contains({_STOP}, term)), tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sc AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * l / a))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY item_id, doc_id) SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc QUALIFY rank <= 10"),
    "dense_topk": (dense_topk, "SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) QUALIFY rank <= 10"),
    "ngram13_overlap": (ngram13_overlap, f"WITH g AS (SELECT 0 AS side, doc_id AS id, {_TOK} AS ts FROM documents UNION ALL SELECT 1, item_id, {_TOK} FROM benchmark), r AS (SELECT DISTINCT side, id, array_to_string(ts[i : i + 12], ' ') AS g FROM (SELECT side, id, ts, unnest(range(1, len(ts) - 11)) AS i FROM g)) SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared FROM r a JOIN r b ON a.side = 0 AND b.side = 1 AND a.g = b.g GROUP BY a.id, b.id"),
    "jaccard_pairs": (jaccard_pairs, f"WITH b AS (SELECT item_id, lower({_SPACE_DUCK}) AS t FROM benchmark), g AS (SELECT DISTINCT item_id, substr(t, i, 5) AS g FROM (SELECT item_id, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) AS i FROM b)), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS s FROM g x JOIN g y ON x.g = y.g AND x.item_id <= y.item_id GROUP BY 1, 2) SELECT a, b, round(s / (na.n + nb.n - s), 9) AS jaccard FROM p JOIN n na ON na.item_id = a JOIN n nb ON nb.item_id = b WHERE round(s / (na.n + nb.n - s), 9) >= 0.8"),
    "document_pairs": (
        document_pairs,
        """
WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) AS ws FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM d),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS total, count(*) AS s FROM t x JOIN t y ON x.w = y.w AND x.doc_id < y.doc_id AND x.n * 0.9 <= y.n AND y.n * 0.9 <= x.n GROUP BY ALL)
SELECT a, b, round(s * 1e0 / (total - s), 9) AS jaccard FROM p WHERE s * 1e0 / (total - s) >= 0.9e0 - 1e-12""",
    ),
    "stream_runs": (stream_runs, "SELECT DISTINCT event_id, user_id, event_type, value FROM events"),
} | collect(
    Plan("scan_parquet", "SELECT doc_id, source, n_chars FROM {documents}"),
    Plan("scan_head", "SELECT doc_id, source FROM {documents} ORDER BY doc_id LIMIT 100"),
    Plan("sha256_text", "SELECT doc_id, sha2(text, 256) AS digest FROM {documents}", "SELECT doc_id, sha256(text) AS digest FROM {documents}"),
    Plan("min_words", "SELECT doc_id FROM {documents} WHERE size(split(trim(text), '[ \\\\t\\\\n]+')) >= 20", "SELECT doc_id FROM {documents} WHERE len(string_split_regex(trim(text), '[ \\t\\n]+')) >= 20"),
    Plan("dedup_questions", "SELECT key, min(item_id) AS item_id, count(*) - 1 AS dropped FROM (SELECT item_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '')) AS key FROM {benchmark}) AS x GROUP BY key", "SELECT key, min(item_id) AS item_id, count(*) - 1 AS dropped FROM (SELECT item_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key FROM {benchmark}) AS x GROUP BY key"),
    Plan("secret_scan", f"SELECT doc_id FROM {{documents}} WHERE text RLIKE 'hf_{'[A-Za-z0-9]' * 30}'", f"SELECT doc_id FROM {{documents}} WHERE regexp_matches(text, 'hf_{'[A-Za-z0-9]' * 30}')"),
)
