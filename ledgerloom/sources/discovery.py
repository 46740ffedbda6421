"""Input discovery, content identity and column profile."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import InputNotFound, InvalidInput
from ledgerloom.functions.text import is_blank


def caseless_glob(pattern: str) -> str:
    """A glob that matches ``pattern`` without regard to ASCII case."""
    if not pattern.strip() or pattern != pattern.strip():
        raise InvalidInput("input pattern must be trimmed and not blank")
    if any(c in pattern for c in "/\\:[]{}") or ".." in pattern or any(ord(c) < 32 for c in pattern):
        raise InvalidInput(f"input pattern must be a plain file name glob: {pattern!r}")
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in pattern)


def discover(spark: SparkSession, folder: str, pattern: str, exactly_one: bool = True) -> DataFrame:
    """Files ``(path, length)`` in ``folder`` whose name matches ``pattern``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", caseless_glob(pattern))
    try:
        files = reader.load(folder).select("path", "length")
        found = files.take(2)
    except AnalysisException as error:
        raise InputNotFound(f"{folder}: {pattern}") from error
    if not found:
        raise InputNotFound(f"{folder}: {pattern}")
    if exactly_one and len(found) > 1:
        raise InvalidInput(f"more than one file matches {pattern!r} in {folder}")
    return files


def content_identity(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, size, sha256)`` of whole files; one task hashes one file (at most 2 GiB each)."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")
    )


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(position, column_name, null_count, row_count)`` for each column, from one pass.

    A blank is NULL or whitespace-only text.
    """
    columns = columns or df.columns

    def blank(name):
        c = F.col(f"`{name}`")
        return is_blank(c) if isinstance(df.schema[name].dataType, T.StringType) else c.isNull()

    counts = [F.count_if(blank(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *counts)
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(f"c{i}").alias("null_count"))
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*entries)), "row_count")
