"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _text, key, at): a row per run of three lines that hold a word, blank lines left out. key: MD5 of the lines
    joined by line ends; at: their positions among all lines. Texts with fewer such lines have none.
    """
    numbered = F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    full = F.filter(numbered, lambda s: F.btrim(s["x"], F.lit(SPACE)) != "")
    key = lambda a, b, c: F.unhex(F.md5(F.concat_ws("\n", a["x"], b["x"], c["x"])))
    at = lambda a, b, c: F.array(a["i"], b["i"], c["i"])
    run = lambda t: lambda a, k: F.struct(t["hash"].alias("t"), key(a, F.get(t["ls"], k + 1), F.get(t["ls"], k + 2)).alias("key"), at(a, F.get(t["ls"], k + 1), F.get(t["ls"], k + 2)).alias("at"))
    starts = lambda t: F.slice(t["ls"], 1, F.greatest(F.size(t["ls"]) - (WINDOW - 1), F.lit(0)))
    # lines and the text's hash are made once a text, and what is exploded carries neither text nor lines
    text = F.struct(full.alias("ls"), F.xxhash64(text_col).alias("hash"))
    runs = F.get(F.transform(F.array(text), lambda t: F.transform(starts(t), run(t))), F.lit(0))
    df = docs.where(F.col(id_col).isNotNull()).select(id_col, F.explode(runs).alias("_run"))
    return df.select(id_col, F.col("_run.t").alias("_text"), "_run.key", "_run.at")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _text, removed): positions of lines that a repeated window covers anywhere but at its first place, by id,
    then position. Only windows that repeat are joined back; hot windows are counted by partial aggregates first.
    """
    w = windows(docs, id_col, text_col)
    place = F.struct(F.col(id_col).alias("id"), F.col("_text").alias("t"), F.col("at").alias("at"))
    twice = w.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("key", "first")
    later = w.join(twice, "key").where(place != F.col("first"))
    return later.groupBy(id_col, "_text").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("removed"))


def _with_removed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, Column]]:
    """Rows (row: the columns of docs, removed), and from them kept_text, n_lines and n_removed."""
    gone = removals(docs, id_col, text_col).select(F.col(id_col).alias("i"), F.col("_text").alias("t"), "removed")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("hash"))
    df = df.join(gone, (F.col("row")[id_col] == F.col("i")) & (F.col("hash") == F.col("t")), "left").select("row", "removed")
    text = F.col("row")[text_col]
    ls = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), text).otherwise(_joined(ls, kept))
    return df, {"kept_text": text, "n_lines": F.size(ls).cast("long"), "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long")}


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text, n_lines and n_removed. A null text counts as empty, and its kept_text is null; rows without an
    id stay whole and take no part; repeated rows lose the same lines; columns of these names are replaced, others stay.
    An empty table gives an empty result.
    """
    df, made = _with_removed(docs, id_col, text_col)
    keep = [F.col("row")[c].alias(c) for c in docs.columns if c in (id_col, text_col) or c not in made]
    return df.select(*keep, *[c.alias(name) for name, c in made.items()])


def _joined(ls: Column, kept: Column) -> Column:
    """The lines at the positions kept; the array of lines is made once a text."""
    return F.get(F.transform(F.array(ls), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")), F.lit(0))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the kept text in text_col (and its length in length_col, if there is one); documents that lose lines and
    are left without a word go. The columns of docs stay.
    """
    df, made = _with_removed(docs, id_col, text_col)
    df = df.select("row", "removed", made["kept_text"].alias("kept_text"))
    df = df.where(F.col("removed").isNull() | (F.btrim("kept_text", F.lit(SPACE)) != ""))
    out = []
    for c in docs.columns:
        was = F.col("row")[c]
        if c == text_col:
            out.append(F.col("kept_text").cast(docs.schema[c].dataType).alias(c))
        elif c == length_col:
            out.append(F.when(F.col("removed").isNotNull(), F.char_length("kept_text")).otherwise(was).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(was.alias(c))
    return df.select(*out)
