"""Delimited ledger exports: metadata rows, a two-row header, then untyped rows.

Each file may carry its own header layout. Header rows are found by file, names are
flattened and aliased, and every row is projected by position onto the union of the
names. Cells stay text; blanks become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.errors import InvalidInput
from ledgerloom.functions.text import blank_to_null, clean
from ledgerloom.session import stage
from ledgerloom.sources.rows import FILE, PART, ROW, ROW_ID, SRC_ID, attach, chunk_table

# Repeated header rows are rare; beyond this many the pairing join is not broadcast.
MAX_BROADCAST_ANCHORS = 100_000


def split_cells(line: Column, delimiter: str = ",") -> Column:
    """Cells of one delimited line. Quoted cells may hold the delimiter and doubled quotes."""
    d = "\\" + delimiter if not delimiter.isalnum() and delimiter != "\t" else delimiter
    line = F.when(line.startswith("﻿"), F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    # every cell is matched together with the delimiter in front of it
    pieces = F.regexp_extract_all(
        F.concat(F.lit(delimiter), line), F.lit(f'{d}("(?:[^"]|"")*"|[^{d}]*)'), F.lit(1)
    )
    unquoted = F.transform(
        pieces,
        lambda c: F.when(
            c.startswith('"'),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )
    return (
        F.when(quotes == 0, F.split(line, d, -1))
        .when(quotes % 2 == 0, unquoted)
        .otherwise(F.raise_error(F.lit("quoted line breaks are not supported in ledger files")))
    )


def header_token(c: Column) -> Column:
    """One header cell without blanks; placeholders of empty headers become ''."""
    t = F.regexp_replace(clean(F.coalesce(c, F.lit(""))), "[ \n]", "")
    empty = F.lower(t).startswith("unnamed") | t.isin(*C.EMPTY_HEADER_TOKENS)
    return F.when(empty, F.lit("")).otherwise(t)


def flatten_header(top: Column, second: Column) -> Column:
    """ARRAY of column names from the two header rows."""

    def name(i: Column) -> Column:
        a, b = header_token(F.get(top, i)), header_token(F.get(second, i))
        merged = F.when((a != "") & (b != "") & (a != b), F.concat(a, b)).when(b != "", b).otherwise(a)
        return F.when(merged == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(merged)

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(top), F.size(second)) - 1), name)


def apply_aliases(names: Column) -> Column:
    """Rename the first alias column (and its namesakes) where the canonical name is absent."""
    targets = ((C.CHILD_MATERIAL, C.CHILD_MATERIAL_ALIASES), (C.COST_ITEM, C.COST_ITEM_ALIASES))
    found = []
    for canonical, aliases in targets:
        pattern = "|".join(aliases)
        first = F.get(F.filter(names, lambda n: n.rlike(pattern)), F.lit(0))  # noqa: B023
        found.append((canonical, F.when(~F.array_contains(names, canonical), first)))
    # a column that fits both targets goes to the later one, as both map by name
    (material, m), (item, i) = found
    return F.transform(names, lambda n: F.when(n == i, F.lit(item)).when(n == m, F.lit(material)).otherwise(n))


def read_lines(spark: SparkSession, path: str, delimiter: str = ",", glob: str | None = None) -> DataFrame:
    """Staged raw cells ``(_file, _part, _row, _anchor, cells)`` of all files under ``path``."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # The id is taken directly on the scan, where its lower 33 bits count rows of the
    # task in file order. Staging freezes it before any later plan can differ.
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(PART),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(ROW),
        split_cells(F.col("value"), delimiter).alias("cells"),
    )
    anchor = F.array_contains(F.transform("cells", clean), C.HEADER_ANCHOR)
    return stage(lines.withColumn("_anchor", anchor), "lines")


def find_headers(numbered: DataFrame) -> DataFrame:
    """First header pair of each file: ``(_src_id, _header_row, names)``."""
    anchors = numbered.where("_anchor").select(
        SRC_ID, F.col(ROW_ID).alias("_header_row"), (F.col(ROW_ID) + 1).alias(ROW_ID), F.col("cells").alias("top")
    )
    if anchors.count() <= MAX_BROADCAST_ANCHORS:
        anchors = F.broadcast(anchors)
    pairs = numbered.select(SRC_ID, ROW_ID, F.col("cells").alias("second")).join(anchors, [SRC_ID, ROW_ID])
    tokens = F.transform(F.concat("top", "second"), clean)
    hinted = pairs.where(F.arrays_overlap(tokens, F.array(*[F.lit(h) for h in C.HEADER_HINTS])))
    first = hinted.groupBy(SRC_ID).agg(
        F.min("_header_row").alias("_header_row"),
        F.min_by(F.struct("top", "second"), "_header_row").alias("pair"),
    )
    names = flatten_header(F.col("pair.top"), F.col("pair.second"))
    return first.select(SRC_ID, "_header_row", apply_aliases(names).alias("names"))


def read_ledger(spark: SparkSession, path: str, delimiter: str = ",", glob: str | None = None) -> DataFrame:
    """Ledger rows of all delimited files as text columns plus ``_src_id`` and ``_row_id``."""
    lines = read_lines(spark, path, delimiter, glob)
    chunks = stage(chunk_table(lines.select(FILE, PART, ROW)), "chunks")
    headers = stage(find_headers(attach(lines, chunks)), "headers")
    missing = chunks.join(headers, SRC_ID, "left_anti").select(FILE).distinct().take(5)
    if missing:
        raise InvalidInput("no two-row ledger header in " + ", ".join(r[0] for r in missing))

    # Column names are schema-sized; positions stay per file. The last column of a name wins.
    named = headers.select(F.posexplode("names").alias("at", "name"))
    listed = named.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()
    columns = [r["name"] for r in listed]

    def position(name: str) -> Column:
        back = F.array_position(F.reverse("names"), name)
        return F.when(back > 0, (F.size("names") - back).cast("int"))

    layout = headers.select(SRC_ID, "_header_row", F.array(*[position(n) for n in columns]).alias("_at"))
    rows = attach(lines, chunks.join(layout, SRC_ID)).where(F.col(ROW_ID) > F.col("_header_row") + 1)
    cells = [
        blank_cell(F.get("cells", F.get("_at", F.lit(i)))).alias(name) for i, name in enumerate(columns)
    ]
    return rows.select(*cells, SRC_ID, ROW_ID)


def blank_cell(c: Column) -> Column:
    """NULL for empty or whitespace-only cells; other text keeps its whitespace."""
    return F.when(blank_to_null(c).isNotNull(), c)
