"""Scanning folders of source files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 1 << 20
EXCLUDED = (".git", "node_modules", "__pycache__", "venv", "dist", "build")


def scan_corpus(spark: SparkSession, path: str, extensions: tuple[str, ...], exclude: tuple[str, ...] = EXCLUDED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, content) of files with these endings, without excluded and hidden folders, large and binary files."""
    # The listing drops other names, so their content is never read; letters match in either case.
    ends = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{{{ends}}}").load(path)
    inside = F.regexp_replace("path", rf"^.*?\Q{path.removeprefix('file://').rstrip('/')}\E", "")
    parts = "|".join(rf"\Q{e}\E" for e in exclude)
    kept = rows.filter(~inside.rlike(rf"/(?:{parts})/|/\.[^/]") & (F.col("length") <= most_bytes))
    return kept.filter(~F.hex(F.substring("content", 1, 1024)).rlike("^(?:..)*?00")).select("path", "length", "content")


def scan_corpus_stats(files: DataFrame) -> DataFrame:
    """Files by ending."""
    return files.groupBy(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1).alias("ending")).agg(F.count("*").alias("files"))


def read_text_with_fallback(files: DataFrame) -> DataFrame:
    """(path, text, encoding, error): UTF-8, else Windows-1252 (decoded in Python, as Spark has no such charset), else an error row."""

    @F.pandas_udf("string")
    def western(content: pd.Series) -> pd.Series:
        def read(raw: bytes | None) -> str | None:
            try:
                return raw.decode("cp1252") if raw is not None else None
            except UnicodeDecodeError:
                return None

        return content.map(read)

    fine: Column = F.is_valid_utf8(F.col("content").cast("string"))
    other = western(F.when(~fine, F.col("content")))
    out = files.select("path", F.when(fine, F.col("content").cast("string")).otherwise(other).alias("text"), fine.alias("fine"))
    encoding = F.when(F.col("fine"), "utf-8").when(F.col("text").isNotNull(), "cp1252")
    return out.select("path", "text", encoding.alias("encoding"), F.when(F.col("text").isNull(), "undecodable").alias("error"))
