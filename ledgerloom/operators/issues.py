"""The issue log: one row per audit finding, in a defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.functions.text import cell_text, is_blank, plain_number
from ledgerloom.functions.numbers import ROUNDED, TOO_WIDE
from ledgerloom.operators.facts import AMOUNT, AMOUNT_MISFIT, BASE_BUCKETS, BUCKET, KEY, QTY_MISFIT, TOTAL, VALIDITY
from ledgerloom.rules import RuleSet
from ledgerloom.sources.rows import ROW_ID

FIELDS = ("row_id", "issue_type", "field_name", "original_value", "reason", "action", "retryable")
# findings are ordered by phase, then by ledger row, then by sequence inside the row
ORDER = ("phase", "source_row", "seq")


def _finding(cond: Column, issue: str, value: Column, phase: int, seq: int = 0, field=None, reason=None) -> Column:
    name, text, action = C.ISSUES[issue]
    return F.when(
        cond,
        F.struct(
            F.col(KEY).alias("row_id"),
            F.lit(issue).alias("issue_type"),
            F.lit(field or name).alias("field_name"),
            value.alias("original_value"),
            F.lit(reason or text).alias("reason"),
            F.lit(action).alias("action"),
            F.lit(False).alias("retryable"),
            F.lit(phase).alias("phase"),
            F.col(ROW_ID).alias("source_row"),
            F.lit(seq).alias("seq"),
        ),
    )


def _explode(df: DataFrame, findings: list[Column]) -> DataFrame:
    return df.select(F.inline(F.filter(F.array(*findings), lambda f: f.isNotNull())))


def detail_issues(prepared_detail: DataFrame) -> DataFrame:
    """Unmapped cost items and missing amounts. A blank unmapped item is no finding."""
    item, amount = cell_text(prepared_detail, C.COST_ITEM), cell_text(prepared_detail, C.DONE_AMOUNT)
    unmapped = F.col(BUCKET).isNull() & ~is_blank(item)
    wide = F.col(AMOUNT_MISFIT).eqNullSafe(TOO_WIDE)
    missing = F.col(BUCKET).isNotNull() & F.col(AMOUNT).isNull() & ~wide
    return _explode(
        prepared_detail.where(unmapped | missing | F.col(AMOUNT_MISFIT).isNotNull()),
        [
            _finding(unmapped, "UNMAPPED_COST_ITEM", item, 0),
            _finding(missing, "MISSING_AMOUNT", amount, 0),
            *_misfits(C.DONE_AMOUNT, AMOUNT_MISFIT, amount, 0),
        ],
    )


def _misfits(field: str, misfit: str, value: Column, seq: int) -> list[Column]:
    return [
        _finding(F.col(misfit).eqNullSafe(kind), issue, value, 0, seq, field=field)
        for kind, issue in ((TOO_WIDE, "NUMBER_OUT_OF_RANGE"), (ROUNDED, "NUMBER_ROUNDED"))
    ]


def qty_issues(prepared_qty: DataFrame) -> DataFrame:
    """Quantities and totals of quantity rows that the decimals can't hold as they are."""
    cells = {C.DONE_QTY: QTY_MISFIT, C.DONE_AMOUNT: AMOUNT_MISFIT}
    findings = [
        finding
        for seq, (field, misfit) in enumerate(cells.items())
        for finding in _misfits(field, misfit, cell_text(prepared_qty, field), seq)
    ]
    return _explode(prepared_qty.where(F.coalesce(*cells.values()).isNotNull()), findings)


def fact_issues(facts: DataFrame, rules: RuleSet) -> DataFrame:
    """Duplicates, failed reconciliations and non-positive unit costs from one pass."""
    total_text = C.ISSUES["TOTAL_COST_MISMATCH"][1]
    findings = [
        _finding(F.col("key_rows") > 1, "DUPLICATE_WORK_ORDER_KEY", F.col("key_rows").cast("string"), 1),
        _finding(
            ~F.col("moh_matches"),
            "MOH_BREAKDOWN_MISMATCH",
            F.format_string(C.MOH_VALUE_FORMAT, plain_number(F.col("moh_components")), plain_number(F.col("moh"))),
            2,
            0,
        ),
        _finding(
            ~F.col("total_matches"),
            "TOTAL_COST_MISMATCH",
            F.format_string(C.TOTAL_VALUE_FORMAT, plain_number(F.col("derived_total")), plain_number(F.col(TOTAL))),
            2,
            1,
            reason=rules.total_expression + total_text,
        ),
    ]
    sums = (*BASE_BUCKETS, *rules.standalone_buckets(), "moh_components", "derived_total")
    for seq, name in enumerate(sums, start=2):
        findings.append(_finding(F.col(name).isNull(), "SUM_OUT_OF_RANGE", F.lit(None).cast("string"), 2, seq, field=name))
    for seq, (metric, (label, _, _)) in enumerate(C.METRICS.items()):
        unit = F.col(f"unit_{metric}")
        findings.append(
            _finding(
                F.col("is_first") & (unit <= 0), "NON_POSITIVE_UNIT_COST", plain_number(unit), 3, seq, field=label
            )
        )
    return _explode(facts, findings)


def issue_log(prepared: DataFrame, facts: DataFrame, rules: RuleSet) -> DataFrame:
    """All findings; sort by :data:`ORDER` at the sink where the order matters.

    ``prepared`` holds the detail rows and, if it has their validity, the quantity rows.
    """
    if VALIDITY not in prepared.columns:
        return detail_issues(prepared).unionByName(fact_issues(facts, rules))
    is_qty = F.col(VALIDITY).isNotNull()
    found = detail_issues(prepared.where(~is_qty)).unionByName(qty_issues(prepared.where(is_qty)))
    return found.unionByName(fact_issues(facts, rules))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issue_count"))
