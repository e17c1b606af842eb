"""Configs, path and model resolution, CSV, Markdown and LaTeX tables, and archives. All paths go through Spark's file systems."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a printed table may have: it is made on the driver.
TABLE_ROWS = 10_000


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, replaced as a whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content))
    out.close()


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON config. JSON needs no further library."""
    text = read_text(spark, path)
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML configs need the yaml library; a .json config does not") from e
    return yaml.safe_load(text) or {}


def first_path(spark: SparkSession, *paths: str) -> str | None:
    """The first of paths that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def model_rows(spark: SparkSession, sources: Sequence[Sequence[str]], schema: str, names: Sequence[str]) -> DataFrame:
    """JSON Lines of a model: sources are tried in order, and all files of the first source with any file are put together. Rows
    of a model that isn't one of names (its aliases) are an error when they are read; a missing model counts as the model.
    """
    from .jsonl import read_jsonl

    found = next((there for s in sources if (there := [p for p in s if exists(spark, p)])), None)
    if found is None:
        raise FileNotFoundError(f"none of {[p for s in sources for p in s]}")
    rows = read_jsonl(spark, found, schema)
    other = F.col("model").isNotNull() & ~F.col("model").isin(*names)
    said = F.concat(F.lit(f"model not in {list(names)}: "), F.col("model"))
    return rows.withColumn("model", F.when(other, F.raise_error(said).cast("string")).otherwise(F.coalesce("model", F.lit(names[0]))))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes are doubled, so that what is written is read back."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("nullValue", "\\N").csv(path)


def small_table(df: DataFrame, most: int = TABLE_ROWS) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows as text. A longer result than a table can show is refused, not cut."""
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows for a printed table")
    return df.columns, [list(r) for r in rows]


def markdown(header: Sequence[str], rows: Sequence[Sequence[str | None]]) -> str:
    """Columns padded to their widest cell; nulls as -."""
    cells = [[("-" if x is None else x).replace("|", "\\|").replace("\n", " ") for x in r] for r in rows]
    wide = [max(map(len, col)) for col in zip(header, *cells)]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, wide)) + " |"
    return "\n".join([line(header), line(["-" * w for w in wide]), *map(line, cells)]) + "\n"


_TEX = str.maketrans({c: "\\" + c for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})


def latex(header: Sequence[str], rows: Sequence[Sequence[str | None]], caption: str = "", label: str = "") -> str:
    line = lambda r: " & ".join("--" if x is None else x.translate(_TEX) for x in r) + r" \\"
    body = [r"\begin{table}[t]", r"\centering", r"\begin{tabular}{" + "l" + "r" * (len(header) - 1) + "}", r"\hline", line(header), r"\hline", *map(line, rows), r"\hline", r"\end{tabular}"]
    body += [rf"\caption{{{caption.translate(_TEX)}}}"] if caption else []
    body += [rf"\label{{{label}}}"] if label else []
    return "\n".join([*body, r"\end{table}"]) + "\n"


def write_table(df: DataFrame, path: str, caption: str = "") -> None:
    """path.md, path.tex and path.csv (one file) of a small result."""
    header, rows = small_table(df)
    quoted = lambda x: "" if x is None else '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x
    text = "\r\n".join(",".join(map(quoted, r)) for r in [header, *rows]) + "\r\n"
    for end, content in (("md", markdown(header, rows)), ("tex", latex(header, rows, caption)), ("csv", text)):
        write_bytes(df.sparkSession, f"{path}.{end}", content.encode())


def file_list(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """(path, bytes, place) of files that any pattern finds: by the first pattern that finds one, then by path, each once."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", F.col("length").alias("bytes"), F.lit(i).alias("place")) for i, p in enumerate(patterns) if _any(spark, p)]
    if not parts:
        return spark.createDataFrame([], "path string, bytes long, place int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("path").agg(F.first("bytes").alias("bytes"), F.min("place").alias("place")).orderBy("place", "path")


def _any(spark: SparkSession, pattern: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def archive(spark: SparkSession, patterns: Sequence[str], out: str, parts: int = 8) -> DataFrame:
    """Tar files part-00000.tar, ... below out of the files that patterns find, each file once, written by tasks; a task holds
    one file at a time. Returns (path, bytes, part).
    """
    files = file_list(spark, patterns)
    if files.isEmpty():
        return files.select("path", "bytes", F.lit(None).cast("int").alias("part"))
    listed = files.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
    content = spark.read.format("binaryFile").load([r.path for r in files.select("path").collect()]).select("path", "content")
    rows = listed.join(content, "path").repartition(parts, "part").sortWithinPartitions("part", "place", "path")

    def tars(batches: Iterator) -> Iterator:
        import pandas as pd

        buffer = at = tar = None
        for pdf in batches:
            for r in pdf.itertuples():
                if r.part != at:
                    if tar is not None:
                        tar.close()
                        yield pd.DataFrame({"part": [at], "chunk": [buffer.getvalue()]})
                    buffer, at = io.BytesIO(), r.part
                    tar = tarfile.open(fileobj=buffer, mode="w")
                info = tarfile.TarInfo(r.path.split(":", 1)[-1].lstrip("/"))
                info.size = len(r.content)
                tar.addfile(info, io.BytesIO(r.content))
        if tar is not None:
            tar.close()
            yield pd.DataFrame({"part": [at], "chunk": [buffer.getvalue()]})

    for r in rows.select("part", "place", "path", "content").mapInPandas(tars, "part int, chunk binary").toLocalIterator():
        write_bytes(spark, f"{out}/part-{r.part:05d}.tar", r.chunk)
    return listed.select("path", "bytes", "part")
