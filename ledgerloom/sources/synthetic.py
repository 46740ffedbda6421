"""Synthetic ledger: many quantity rows and a constant set of detail rows for the first order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.rules import RuleSet
from ledgerloom.sources.rows import ROW_ID, SRC_ID

LARGE_ROWS = 140_000
# fixed values: (cost item, unit cost, amount)
DETAIL_COSTS = (
    ("直接材料", 10, 100),
    ("直接人工", 2, 20),
    ("制造费用-人工", 3, 30),
    ("委外加工费", 1, 10),
    ("软件费用", 1, 10),
)
UNIT_COST = "本期完工单位成本"


def synthetic_ledger(spark: SparkSession, rules: RuleSet, quantity_rows: int = LARGE_ROWS) -> DataFrame:
    """Ledger rows in file order: ``quantity_rows`` orders, then the details of order 1."""
    allowed = (C.DIRECT_MATERIAL, C.DIRECT_LABOR, *C.OVERHEAD_ITEMS.values(), *rules.standalone_items)
    costs = [c for c in DETAIL_COSTS if c[0] in allowed]
    total = sum(c[2] for c in costs)
    tag = rules.name.upper()
    n = F.col("id")
    at = n - quantity_rows  # >= 0 on detail rows

    def pick(index):
        return F.element_at(F.array(*[F.lit(c[index]) for c in costs]), (at + 1).cast("int"))

    detail = at >= 0
    order = F.when(detail, 1).otherwise(n + 1)
    return spark.range(quantity_rows + len(costs)).select(
        F.lit("2026年1期").alias(C.PERIOD),
        F.lit("Synthetic Center").alias(C.COST_CENTER),
        F.lit(f"SYN-{tag}-PRODUCT").alias(C.PRODUCT_CODE),
        F.lit("Synthetic Product Outside Whitelist").alias(C.PRODUCT_NAME),
        F.lit("SYN-MODEL").alias(C.SPEC),
        F.format_string(f"SYN-{tag}-%06d", order).alias(C.ORDER_NO),
        F.lit(1).alias(C.ORDER_LINE),
        F.lit("PCS").alias(C.UNIT),
        F.when(detail, pick(0)).alias(C.COST_ITEM),
        F.when(~detail, 10).cast("decimal(18,6)").alias(C.DONE_QTY),
        F.when(detail, pick(1)).otherwise(total // 10).cast("decimal(28,10)").alias(UNIT_COST),
        F.when(detail, pick(2)).otherwise(total).cast("decimal(28,10)").alias(C.DONE_AMOUNT),
        F.lit(1).cast("bigint").alias(SRC_ID),
        n.alias(ROW_ID),
    )
