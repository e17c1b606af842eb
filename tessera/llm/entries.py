"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_column, classifier, edit_embedding, lines, packing, quality, secrets, simhash, suffix_dedup, tokenfiles, trie, urls, vafile
from .common import written
from .tokens import tokenizer_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that earlier documents hold are removed; see suffix_dedup.deduplicated for nulls, repeated rows
    and empty tables.
    """
    return suffix_dedup.deduplicated(_docs(spark, sf_dir), with_text=False)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict for all documents; see quality.assessed."""
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.assessed(_docs(spark, sf_dir)).select(*cols)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the class (component_id) that banding and verification
    find for each; nulls, repeated rows and empty tables as edit_embedding.edited_fingerprints says.
    """
    return edit_embedding.with_components(written(edit_embedding.edited_fingerprints(_docs(spark, sf_dir))), "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; see packing.pack_documents."""
    return packing.pack_documents(_docs(spark, sf_dir), tokenizer_path(BYTE_BPE), end_id=1)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that later copies of three-line windows cover are removed; see lines.deduplicated."""
    df = lines.deduplicated(_docs(spark, sf_dir))
    return df.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents; see secrets.scanned."""
    return secrets.scanned(_docs(spark, sf_dir)).drop("redacted")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, written as files and read back; see tokenfiles.tokens_round_trip."""
    return tokenfiles.tokens_round_trip(_docs(spark, sf_dir), tokenizer_path(WORD_BPE), end_id=2)


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and their decoded texts; see bpe_column.digests."""
    return bpe_column.digests(_docs(spark, sf_dir), tokenizer_path(WORD_BPE))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by two co-trained views; see classifier.classified."""
    return classifier.classified(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; see simhash.near_duplicates."""
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per node of the prefix trie of all rebuilt conversations; see trie.prefix_trie for nulls, ties and empty tables."""
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page by rules and by character models; see urls.filtered for nulls, repeated rows and empty tables."""
    return urls.filtered(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives for each of five positives of every anchor; see vafile.vectors and vafile.hard_negatives for nulls, ties,
    repeated rows and empty tables.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vafile.hard_negatives(vafile.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label), F.col("id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_suffix_array_dedup, op2_quality_rules, op3_document_fingerprints, op4_packing, op5_line_dedup, op6_secret_scan, op7_token_files, op8_bpe_encode_decode, op9_quality_classifier, op10_simhash_near_dedup, op11_conversation_prefix_trie, op12_url_filters, op13_hard_negatives)
    }


_OP5 = """
WITH line AS (
  SELECT doc_id, md5(coalesce(text, '')) AS t, u.i - 1 AS i, u.x AS x
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i) u
), full_line AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS k FROM line WHERE trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), win AS (
  SELECT a.doc_id, a.k, a.x || chr(10) || b.x || chr(10) || c.x AS key, [a.i, b.i, c.i] AS places
  FROM full_line a JOIN full_line b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN full_line c ON a.doc_id = c.doc_id AND c.k = a.k + 2
), later AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, k) AS n FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(places) AS i FROM later WHERE n > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, md5(coalesce(text, '')) AS kept_md5 FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": _OP5}
