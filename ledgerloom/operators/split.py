"""Routing of cleaned ledger rows into quantity rows, cost-detail rows and the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.functions.text import cell_text, clean, is_blank

ROUTE = "_route"
QTY, DETAIL, OTHER = "qty", "detail", "other"


def tag(ledger: DataFrame, unnamed: Column, item: Column | None = None) -> Column:
    """Route of a row by its own material and (trimmed) cost item; ``unnamed`` stands for rows that have neither."""
    material = ~is_blank(cell_text(ledger, C.CHILD_MATERIAL))
    item = clean(cell_text(ledger, C.COST_ITEM)) if item is None else item
    return (
        F.when(material, DETAIL).when(item == "", unnamed).when(item != C.DIRECT_MATERIAL, DETAIL).otherwise(OTHER)
    )


def route(ledger: DataFrame) -> DataFrame:
    """Tag every row with its route and give detail rows the filled cost item, in one pass."""
    has_order = ~is_blank(cell_text(ledger, C.ORDER_NO)) if C.ORDER_NO in ledger.columns else F.lit(True)
    tagged = ledger.withColumn(ROUTE, tag(ledger, F.when(has_order, QTY).otherwise(OTHER)))
    if C.COST_ITEM in ledger.columns and C.FILLED_COST_ITEM in ledger.columns:
        item_now = F.when(F.col(ROUTE) == DETAIL, F.col(C.FILLED_COST_ITEM)).otherwise(F.col(C.COST_ITEM))
        tagged = tagged.withColumn(C.COST_ITEM, item_now)
    return tagged


def part(routed: DataFrame, which: str) -> DataFrame:
    """Rows of one route; ``OTHER`` is the reject table."""
    return routed.where(F.col(ROUTE) == which).drop(ROUTE)
