"""Publication of the three output tables and the run record."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import contract as C
from ledgerloom.functions.text import clean
from ledgerloom.errors import InvalidInput, OutputExists

RUN_RECORD = "run_record"
ISSUE_LOG = "issue_log"
INPUT_LIST = "inputs"
NON_NUMERIC = "non_numeric_cells"


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException:
        return False


def typed(df: DataFrame, kind: str = "decimal(38,18)") -> DataFrame:
    """Number columns of the layouts as decimals.

    A text cell in such a column cannot be stored as a number. It is kept as text in the
    map ``non_numeric_cells`` (column name -> text), so nothing is lost.
    """
    texts = [
        c for c in df.columns
        if isinstance(df.schema[c].dataType, T.StringType)
        and c not in C.TEXT_COLUMNS
        and c in (*C.DETAIL_LAYOUT, *C.QTY_LAYOUT)
    ]
    if not texts:
        return df
    number = {c: clean(F.col(f"`{c}`")).try_cast(kind) for c in texts}
    odd = F.array(
        *[
            F.when(F.col(f"`{c}`").isNotNull() & number[c].isNull(), F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("text")))
            for c in texts
        ]
    )
    cells = F.map_from_entries(F.filter(odd, lambda e: e.isNotNull()))
    return df.select(
        *[(number[c] if c in number else F.col(f"`{c}`")).alias(c) for c in df.columns], cells.alias(NON_NUMERIC)
    )


def check_free(spark: SparkSession, target: str, names) -> None:
    """Raise OutputExists if any of the outputs is there already."""
    for name in names:
        path = f"{target.rstrip('/')}/{name}"
        if exists(spark, path):
            raise OutputExists(path)


def promote(spark: SparkSession, staged: str, target: str, names) -> None:
    """Move finished outputs from folder ``staged`` into ``target``, in order, then drop the folder.

    Outputs are written aside first, so a run that fails leaves nothing in its target and can be
    repeated. Moves are renames of whole folders on the target's own file system.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    check_free(spark, target, names)
    for name in names:
        if not system.rename(path(staged, name), path(target, name)):
            raise OutputExists(f"{target.rstrip('/')}/{name}")
    system.delete(path(staged), True)


def publish(tables: dict[str, DataFrame], target: str, fmt: str = "parquet") -> dict[str, str]:
    """Write exactly the three output tables in their fixed order, never over existing ones.

    Each table appears through Spark's job commit; a table that exists stops the run
    before anything is written.
    """
    if tuple(tables) != C.OUTPUT_TABLES:
        raise InvalidInput(f"expected the tables {C.OUTPUT_TABLES} in this order, got {tuple(tables)}")
    paths = {name: f"{target.rstrip('/')}/{name}" for name in tables}
    spark = next(iter(tables.values())).sparkSession
    for path in paths.values():
        if exists(spark, path):
            raise OutputExists(path)
    for name, df in tables.items():
        flat = df
        if fmt == "csv" and NON_NUMERIC in df.columns:
            flat = df.withColumn(NON_NUMERIC, F.to_json(NON_NUMERIC))
        writer = flat.write.mode("errorifexists").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(paths[name])
    return paths


def publish_log(rows: DataFrame, target: str, name: str) -> str:
    """Write an audit table as JSON. The run record comes last and so marks a finished run."""
    path = f"{target.rstrip('/')}/{name}"
    if exists(rows.sparkSession, path):
        raise OutputExists(path)
    rows.write.mode("errorifexists").json(path)
    return path
