"""Cleaning of raw ledger rows: names, total rows, fills, month labels and month filter."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import contract as C
from ledgerloom.errors import InvalidInput
from ledgerloom.functions.text import cell_text, clean, is_blank, period_key
from ledgerloom.operators.fill import BLOCK, BLOCK_ROWS, Guard, ordered_fill
from ledgerloom.rules import MonthRange

VENDOR_GUARD = Guard(C.COST_CENTER, C.GUARDED_COST_CENTER, C.VENDOR_COLUMNS)


def canonical_names(df: DataFrame) -> DataFrame:
    """Resolve repeated and alias column names of a typed table by its schema alone.

    The first column matching an alias (and its namesakes) takes the canonical name when
    that is absent, then the last physical column of each name is kept.
    """
    names = list(df.columns)
    targets = {}
    for canonical, aliases in (
        (C.CHILD_MATERIAL, C.CHILD_MATERIAL_ALIASES),
        (C.COST_ITEM, C.COST_ITEM_ALIASES),
    ):
        match = next((n for n in names if any(a in n for a in aliases)), None)
        if canonical not in names and match is not None:
            targets[match] = canonical
    names = [targets.get(n, n) for n in names]
    if len(set(names)) == len(names):
        return df.toDF(*names)
    places = df.toDF(*[f"_{i}" for i in range(len(names))])
    last = {n: i for i, n in enumerate(names)}
    return places.select(*[F.col(f"_{last[n]}").alias(n) for n in dict.fromkeys(names)])


def drop_total_rows(df: DataFrame, columns: tuple[str, ...] = C.TOTAL_COLUMNS, mark: str = C.TOTAL_MARK) -> DataFrame:
    """Remove rows where a text column contains ``mark``; numbers never match."""
    texts = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    marked = [F.coalesce(F.col(f"`{c}`").contains(mark), F.lit(False)) for c in texts]
    return df.where(~reduce(or_, marked)) if marked else df


def blank_cells_to_null(df: DataFrame) -> DataFrame:
    """Empty and whitespace-only text cells as NULL; other text keeps its whitespace."""
    return df.select(
        *[
            F.when(~is_blank(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def put_column(df: DataFrame, name: str, value: Column, after: str | None = None) -> DataFrame:
    """Replace ``name`` where it stands, or insert it after ``after`` (else at the end)."""
    if name in df.columns:
        return df.withColumn(name, value)
    cols = [F.col(f"`{c}`") for c in df.columns]
    at = df.columns.index(after) + 1 if after in df.columns else len(cols)
    return df.select(*cols[:at], value.alias(name), *cols[at:])


def with_month(df: DataFrame, period: str = C.PERIOD, month: str = C.MONTH) -> DataFrame:
    """Derive the month label right after the period column; no period, no change."""
    if period not in df.columns:
        return df
    # stepwise, so that each intermediate text is computed once per row
    steps = df.withColumn("_text", clean(cell_text(df, period)))
    steps = steps.withColumn("_digits", F.regexp_replace("_text", "[^0-9]+", ""))
    steps = steps.withColumn("_no", F.substring("_digits", 5, 2).try_cast("int"))
    named = F.col("_text").contains("年") & F.col("_text").contains("期")
    valid = (F.length("_digits") >= 5) & F.col("_no").between(1, 12)
    text = F.concat(F.substring("_digits", 1, 4), F.lit("年"), F.lpad(F.col("_no").cast("string"), 2, "0"), F.lit("期"))
    label = F.when(named & valid, text).otherwise(F.nullif(F.col("_text"), F.lit("")))
    return put_column(steps, month, label, after=period).drop("_text", "_digits", "_no")


def in_months(df: DataFrame, months: MonthRange | None, columns: tuple[str, ...] = (C.MONTH, C.PERIOD)) -> DataFrame:
    """Keep rows whose first valid period key among ``columns`` lies in the range."""
    if not months:
        return df
    keys = [period_key(cell_text(df, c)) for c in columns if c in df.columns]
    if not keys:
        return df.where(F.lit(False))
    key = F.coalesce(*keys)
    keep = key.isNotNull()
    if months.start:
        keep = keep & (key >= months.start)
    if months.end:
        keep = keep & (key <= months.end)
    return df.where(keep)


def project(df: DataFrame, layout: tuple[str, ...]) -> DataFrame:
    """The columns of ``layout`` that exist, in layout order."""
    return df.select(*[F.col(f"`{c}`") for c in layout if c in df.columns])


def require(df: DataFrame, columns: tuple[str, ...], dataset: str) -> DataFrame:
    """Raise one InvalidInput that lists every missing column in sorted order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise InvalidInput(f"{dataset}缺少必要字段: {', '.join(missing)}")
    return df


def clean_rows(ledger: DataFrame, blank_text: bool = True) -> DataFrame:
    """Rows as the fill takes them: under canonical names, without total rows, blank cells NULL."""
    rows = drop_total_rows(canonical_names(ledger))
    return blank_cells_to_null(rows) if blank_text else rows


def normalize(
    ledger: DataFrame,
    months: MonthRange | None = None,
    block_rows: int = BLOCK_ROWS,
    blank_text: bool = True,
) -> DataFrame:
    """Clean raw rows. The order is fixed: totals, fill, month label, month filter.

    The month filter stands above the fill, so it never changes a filled value. Text cells
    holding only whitespace become NULL; ``blank_text=False`` says there are none, as in
    the rows of :func:`ledgerloom.sources.text.read_ledger`.
    """
    rows = clean_rows(ledger, blank_text)
    fills = {c: c for c in C.FILL_COLUMNS if c in rows.columns}
    if C.COST_ITEM in rows.columns:
        fills[C.FILLED_COST_ITEM] = C.COST_ITEM
    else:
        rows = put_column(rows, C.FILLED_COST_ITEM, F.lit(None).cast("string"))
    guards = (VENDOR_GUARD,) if C.COST_CENTER in fills else ()
    filled = ordered_fill(rows, fills, guards, block_rows=block_rows, blank_text=False) if fills else rows.drop(BLOCK)
    return in_months(with_month(filled), months)
