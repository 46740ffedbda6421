"""Column rules, Python helpers and tables that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import stage

# Words are runs of anything but these six bytes; bytes.split() cuts at the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Characters a task handles at a time, so that its memory follows the longest text only.
SLICE_CHARS = 4_000_000
# Bytes of an Arrow batch between Spark and a Python worker.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(row_id: Column | str, folds: int) -> Column:
    """Fold 0..folds-1 of a row from its id alone; a null id is in fold 0."""
    col = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def word_count(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# Archive of the package by application; Spark's file server reads it as long as the driver lives.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory()
    archive = Path(folder.name, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    # rows hold whole texts, so batches are bounded by bytes; a setting of the user's own stays
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    _shipped[context.applicationId] = folder


def _returning(function: Callable) -> Callable:
    """``function`` on the batches of a task, handing freed memory back when the task ends.

    Python workers live on from task to task and beside each other. What the allocators keep of one task's
    peak would otherwise count against the executor while the next operator runs.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def map_frames(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInPandas`` with the package shipped."""
    ship(df.sparkSession)
    return df.mapInPandas(_returning(function), schema)


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with the package shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(_returning(function), schema)


def text_slices(
    batches: Iterator[pd.DataFrame], text: str = "text", most: int = SLICE_CHARS
) -> Iterator[pd.DataFrame]:
    """Cut batches of rows into runs of about ``most`` characters; a longer text ends its run.

    Null texts become empty ones.
    """
    for frame in batches:
        frame = frame.assign(**{text: frame[text].fillna("")})
        ends = frame[text].str.len().cumsum().to_numpy() // most
        for _, part in frame.groupby(ends, sort=False):
            yield part


def with_row(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Written copy of ``docs`` with a column that numbers its rows, and that column's name.

    The written copy fixes the numbers: rows that repeat an id stay apart in every later join.
    """
    column = "_row"
    while column in docs.columns:
        column += "_"
    return stage(docs.withColumn(column, F.monotonically_increasing_id()), name), column
