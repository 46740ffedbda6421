"""Row numbering: one order-preserving BIGINT per ledger row.

Ledger rows only mean something in file order, so every source adds

* ``_src_id``  a number per input file (fills never cross files), and
* ``_row_id``  a number that rises with (file, position) over the whole input.

Numbers are built from small per-chunk row counts, never by a window over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage

SRC_ID = "_src_id"
ROW_ID = "_row_id"
FILE, PART, ROW = "_file", "_part", "_row"
CHUNK_ROWS = 1 << 20


def chunk_table(positions: DataFrame) -> DataFrame:
    """Per (file, part, chunk of rows): first position and first ``_row_id``.

    One row per million ledger rows. The offsets run over chunks inside a file and
    over files, so the widest window holds one row per file.
    """
    chunk = F.floor(F.col(ROW) / CHUNK_ROWS).alias("_chunk")
    chunks = positions.groupBy(FILE, PART, chunk).agg(
        F.min(ROW).alias("_first"), (F.max(ROW) - F.min(ROW) + 1).alias("_n")
    )
    files = chunks.groupBy(FILE).agg(F.sum("_n").alias("_file_n"))
    before = Window.orderBy(FILE)
    files = files.select(
        FILE,
        F.row_number().over(before).cast("bigint").alias(SRC_ID),
        (F.sum("_file_n").over(before) - F.col("_file_n")).alias("_file_base"),
    )
    inside = Window.partitionBy(FILE).orderBy(PART, "_chunk")
    chunks = chunks.withColumn("_base", F.sum("_n").over(inside) - F.col("_n"))
    return chunks.join(files, FILE).select(
        FILE, PART, "_chunk", SRC_ID, "_first", (F.col("_base") + F.col("_file_base")).alias("_base")
    )


def attach(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join the chunk table to the rows and turn positions into ``_row_id``.

    The join key includes the chunk, so even one huge file spreads over many keys.
    """
    keyed = rows.withColumn("_chunk", F.floor(F.col(ROW) / CHUNK_ROWS))
    joined = keyed.join(chunks, [FILE, PART, "_chunk"])
    return joined.withColumn(ROW_ID, F.col("_base") + F.col(ROW) - F.col("_first")).drop(
        FILE, PART, ROW, "_chunk", "_base", "_first"
    )


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Scan a parquet ledger (file or folder) in file order with ``_src_id`` and ``_row_id``."""
    scan = spark.read.parquet(path)
    position = [
        F.col("_metadata.file_path").alias(FILE),
        F.lit(0).cast("bigint").alias(PART),
        F.col("_metadata.row_index").alias(ROW),
    ]
    wanted = [F.col(f"`{c}`") for c in (columns or scan.columns)]
    # written first, so that Spark knows its size and broadcasts it: the ledger itself stays in place
    chunks = stage(chunk_table(scan.select(*position)), "chunks")
    return attach(scan.select(*wanted, *position), chunks)
