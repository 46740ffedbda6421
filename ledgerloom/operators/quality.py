"""Quality metrics, run counts and the run record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.functions.text import cell_text
from ledgerloom.operators.anomaly import production_scope
from ledgerloom.operators.facts import AMOUNT_REST, BAD_QTY, NO_TOTAL, OUT_OF_RANGE, TOTAL, VALIDITY, positive
from ledgerloom.operators.split import DETAIL, QTY, ROUTE


def ledger_counts(prepared: DataFrame) -> DataFrame:
    """One row: detail, quantity and reject counts of the prepared ledger."""
    return prepared.agg(
        F.count_if(F.col(ROUTE) == DETAIL).alias("detail_rows"),
        F.count_if(F.col(ROUTE) == QTY).alias("qty_input_rows"),
        F.count_if(F.col(VALIDITY) == BAD_QTY).alias("invalid_qty_rows"),
        F.count_if(F.col(VALIDITY) == NO_TOTAL).alias("missing_total_rows"),
        F.count_if(F.col(VALIDITY) == OUT_OF_RANGE).alias("out_of_range_rows"),
    )


def fact_counts(facts: DataFrame) -> DataFrame:
    """One row: output rows, work orders, duplicates and analyzable work orders.

    Work orders are the first occurrences, so no distinct count is needed. Coverage tests
    the completed total, not the unit cost.
    """
    done, total = positive(facts), positive(facts, TOTAL, AMOUNT_REST)
    known = production_scope(cell_text(facts, C.DOC_TYPE)) != C.SCOPE_UNKNOWN
    return facts.agg(
        F.count(F.lit(1)).alias("qty_output_rows"),
        F.count_if("is_first").alias("work_orders"),
        F.count_if(F.col("key_rows") > 1).alias("duplicate_rows"),
        F.count_if(~done).alias("non_positive_rows"),
        F.count_if(F.col("is_first") & done & total & known).alias("analyzable"),
    )


def quality_metrics(counts: DataFrame, months_filtered: bool = False) -> DataFrame:
    """Ten report rows ``(position, category, metric, value, description)`` from one row of counts.

    Rates are not applicable when a month filter left no row at all.
    """
    empty = F.lit(months_filtered) & (F.col("ledger_rows") == 0)

    def percent(rate):
        return F.concat(F.call_function("format_number", rate * 100, F.lit("0.00")), F.lit("%"))

    coverage = F.when(F.col("work_orders") > 0, F.col("analyzable") / F.col("work_orders")).otherwise(F.lit(0.0))
    plain = (
        "detail_rows", "qty_input_rows", "qty_output_rows", "invalid_qty_rows", "missing_total_rows",
        "work_orders", None, "duplicate_rows", "non_positive_rows", None,
    )
    rates = {6: F.lit(0.0), 9: coverage}
    entries = []
    for i, (category, metric, text) in enumerate(C.QUALITY_METRICS):
        value, description = F.lit(None), F.lit(text)
        if i in rates:
            value = F.when(empty, C.NOT_APPLICABLE).otherwise(percent(rates[i]))
            description = F.when(empty, C.EMPTY_FILTER_TEXT).otherwise(text)
        else:
            value = F.col(plain[i]).cast("string")
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(category).alias("category"),
                F.lit(metric).alias("metric"),
                value.alias("value"),
                description.alias("description"),
            )
        )
    return counts.select(F.inline(F.array(*entries)))


def run_record(
    rule_set: str,
    months: tuple[str | None, str | None],
    counts: DataFrame,
    quality: DataFrame,
    issue_counts: DataFrame,
    inputs: DataFrame | None = None,
    outputs: dict[str, str] | None = None,
    status: str = "succeeded",
) -> DataFrame:
    """One audit row: status, rule set, filter, inputs, outputs, counts, metrics and issues.

    Only report-sized tables (ten metrics, at most six issue types) are gathered. Inputs,
    of which there may be many, are summed up: number, bytes, the SHA-256 of a single file,
    and a fingerprint over all of them that does not depend on their order.
    """
    metrics = quality.agg(
        F.array_sort(F.collect_list(F.struct("position", "category", "metric", "value", "description"))).alias(
            "quality_metrics"
        )
    )
    issues = issue_counts.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue_type", "issue_count")))).alias(
            "issue_type_counts"
        ),
        F.coalesce(F.sum("issue_count"), F.lit(0)).alias("issue_total"),
    )
    out = counts.select(F.struct(*counts.columns).alias("counts"), F.lit(1).alias("_k"))
    for part in (metrics, issues):
        out = out.join(part.withColumn("_k", F.lit(1)), "_k")
    if inputs is not None:
        files = inputs.agg(
            F.struct(
                F.count(F.lit(1)).alias("files"),
                F.sum("size").alias("bytes"),
                F.when(F.count(F.lit(1)) == 1, F.max("sha256")).alias("sha256"),
                F.bit_xor(F.xxhash64("path", "sha256")).alias("fingerprint"),
            ).alias("inputs")
        )
        out = out.join(files.withColumn("_k", F.lit(1)), "_k")
    targets = F.create_map(*[F.lit(x) for kv in (outputs or {}).items() for x in kv]) if outputs else F.lit(None)
    return out.drop("_k").select(
        F.lit(status).alias("status"),
        F.lit(rule_set).alias("rule_set"),
        F.lit(months[0]).cast("string").alias("month_start"),
        F.lit(months[1]).cast("string").alias("month_end"),
        targets.cast("map<string,string>").alias("outputs"),
        "*",
    )
