"""The routed ledger in runs: cells that rows share by the fill are cleaned, joined and stored once for all of them.

Identity columns stand on few rows and are filled into those below. A run is a row with such a cell and the rows up to the
next one, within a block of the fill and at most RUN_ROWS row numbers. Its identity, month and key are columns of one row;
what its rows have of their own are arrays side by side. :func:`unpack` gives the rows back.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.functions.text import cell_text, clean, is_blank
from ledgerloom.operators import facts
from ledgerloom.operators.fill import BLOCK, BLOCK_ROWS, effective, fill_blocks, inherited
from ledgerloom.operators.normalize import VENDOR_GUARD, clean_rows, in_months, require, with_month
from ledgerloom.operators.split import DETAIL, OTHER, QTY, ROUTE, tag
from ledgerloom.rules import MonthRange, RuleSet
from ledgerloom.session import stage
from ledgerloom.sources.rows import ROW_ID, SRC_ID

# a batch of the parquet reader holds 4,096 runs, so they are kept short
RUN_ROWS = 64
# of a run: its first row with identity cells, how many rows it has, whether it has an order and whether the guard holds
RUN, LENGTH, HAS_ORDER, SHUT = "_run", "_length", "_has_order", "_shut"
# of a block: the cost item from earlier blocks and its bucket
ITEM, ITEM_BUCKET = "_item", "_item_bucket"
# of a row: the cost item as far as its block tells, whether it is the row's own, and the route but for the order
FILLED, OWN, TAG = "_filled", "_own", "_tag"
# identity cells of a row that has any
HEAD = "_head"
OPEN = "open"


def identity(ledger: DataFrame) -> list[str]:
    return [c for c in C.FILL_COLUMNS if c in ledger.columns]


def pack(ledger: DataFrame, rules: RuleSet, months: MonthRange | None = None, blank_text: bool = True) -> DataFrame:
    """Runs of the cleaned, filled, labelled, month-filtered, routed and prepared ledger. It must have a period column."""
    rows = clean_rows(ledger, blank_text)
    for which, needed in ((C.DETAIL_DATASET, C.REQUIRED_DETAIL), (C.QTY_DATASET, C.REQUIRED_QTY)):
        require(rows, needed, which)
    shared, keys = identity(rows), [SRC_ID, BLOCK]
    if BLOCK not in rows.columns:
        rows = rows.withColumn(BLOCK, F.floor(F.col(ROW_ID) / BLOCK_ROWS))
    fills = {c: c for c in shared}
    guards = effective((VENDOR_GUARD,), fills)

    # rows with identity cells are few and written once: what blocks inherit is found among them
    seeds = stage(rows.where(starts(shared)).select(*keys, ROW_ID, *[f"`{c}`" for c in shared]), "seeds", codec="zstd")
    carries = inherited(rows, ROW_ID, (SRC_ID,), fills | {C.COST_ITEM: C.COST_ITEM}, guards, seeds)

    own = _own_columns(rows, keys, shared, rules)
    cells = [c for c in own.columns if c not in {*keys, RUN, HEAD}]
    body = F.struct(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cells)])
    group = [*keys, RUN, "_part"]
    # made before the sort: an aggregate would build the struct cell by cell
    whole = own.select(*keys, RUN, F.floor(F.col(ROW_ID) / RUN_ROWS).alias("_part"), HEAD, ROW_ID, body.alias("_row"))
    # one row of a run at most has identity cells
    packed = whole.sortWithinPartitions(*group, ROW_ID).groupBy(*group).agg(
        F.first(HEAD, ignorenulls=True).alias(HEAD),
        F.min(ROW_ID).alias("_first"),
        F.collect_list("_row").alias("_rows"),
    )
    packed = packed.select(
        *keys,
        RUN,
        "_first",
        F.size("_rows").alias(LENGTH),
        *[F.col(f"{HEAD}._h{i}").alias(c) for i, c in enumerate(shared)],
        *[F.col(f"_rows._c{i}").alias(c) for i, c in enumerate(cells)],
    )
    # the fill goes from run to run, as it does from row to row
    filled, names, heads = fill_blocks(packed, carries, "_first", (SRC_ID,), fills, guards)
    filled = filled.select(
        SRC_ID,
        RUN,
        LENGTH,
        *[F.col(name).alias(c) for c, name in names.items()],
        *[f"`{c}`" for c in cells],
        F.col(heads[C.COST_ITEM]).alias(ITEM),
        (F.col("_shut0") if guards else F.lit(False)).alias(SHUT),
    )
    filled = facts.with_key(in_months(with_month(filled), months))
    filled = filled.withColumn(HAS_ORDER, ~is_blank(cell_text(filled, C.ORDER_NO)))
    return filled.withColumn(ITEM_BUCKET, facts.cost_bucket(cell_text(filled, ITEM), rules.standalone_buckets()))


def _own_columns(rows: DataFrame, keys: list[str], shared: list[str], rules: RuleSet) -> DataFrame:
    """Rows with their run, and what is known of them without the order number: item, tag, bucket, numbers, validity."""
    item = F.col(f"`{C.COST_ITEM}`")
    head = F.struct(*[F.col(f"`{c}`").alias(f"_h{i}") for i, c in enumerate(shared)])
    trimmed = rows.withColumn("_text", clean(cell_text(rows, C.COST_ITEM)))
    tagged = trimmed.withColumns({TAG: tag(trimmed, F.lit(OPEN), F.col("_text")), HEAD: F.when(starts(shared), head)})
    tagged = tagged.drop(*shared)
    order = Window.partitionBy(*keys).orderBy(ROW_ID).rowsBetween(Window.unboundedPreceding, 0)
    seen = tagged.withColumns(
        {
            RUN: F.last(F.when(F.col(HEAD).isNotNull(), F.col(ROW_ID)), ignorenulls=True).over(order),
            FILLED: F.last(item, ignorenulls=True).over(order),
        }
    )
    seen = seen.withColumn(OWN, item.isNotNull())
    seen = seen.withColumn("_text", F.when(F.col(OWN), F.col("_text")).otherwise(clean(cell_text(seen, FILLED))))
    bucket = facts.cost_bucket(F.col("_text"), rules.standalone_buckets(), trimmed=True)
    bucketed = seen.withColumn(facts.BUCKET, F.when(F.col(TAG) == DETAIL, bucket)).drop("_text", C.COST_ITEM)
    numbers = facts.with_numbers(bucketed)
    valid = numbers.withColumn(facts.VALIDITY, F.when(F.col(TAG) == OPEN, facts.validity(numbers)))
    return facts.without_plain_numbers(valid)


def starts(shared: list[str]) -> Column:
    """Whether a row has an identity cell of its own."""
    return reduce(or_, [F.col(f"`{c}`").isNotNull() for c in shared])


def unpack(packed: DataFrame) -> DataFrame:
    """The rows of the runs, but for the numbers that a cast makes again. Columns that are not asked for are not read."""
    shared = [c for c in packed.columns if packed.schema[c].dataType.typeName() != "array"]
    cells = [c for c in packed.columns if c not in shared]
    rows = packed.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col(LENGTH) - 1)))
    rows = rows.select(*[f"`{c}`" for c in shared], *[F.get(F.col(f"`{c}`"), F.col("_at")).alias(c) for c in cells])
    blank = F.when(F.col(HAS_ORDER), QTY).otherwise(OTHER)
    rows = rows.withColumn(ROUTE, F.when(F.col(TAG) == OPEN, blank).otherwise(F.col(TAG)))
    rows = rows.withColumn(C.FILLED_COST_ITEM, F.coalesce(FILLED, ITEM))
    detail, qty = F.col(ROUTE) == DETAIL, F.col(ROUTE) == QTY
    rows = rows.withColumns(
        {
            C.COST_ITEM: F.when(detail, F.col(f"`{C.FILLED_COST_ITEM}`")).when(F.col(OWN), F.col(FILLED)),
            facts.BUCKET: F.when(
                detail, F.when(F.col(FILLED).isNull(), F.col(ITEM_BUCKET)).otherwise(F.col(facts.BUCKET))
            ),
            facts.VALIDITY: F.when(qty, F.col(facts.VALIDITY)),
            # where the guard holds, only the row that brings a value has it
            **{
                c: F.when(~F.col(SHUT) | F.col(ROW_ID).eqNullSafe(F.col(RUN)), F.col(f"`{c}`"))
                for c in C.VENDOR_COLUMNS
                if c in shared
            },
        }
    )
    return rows.drop(RUN, LENGTH, HAS_ORDER, SHUT, ITEM, ITEM_BUCKET, FILLED, OWN, TAG)
