"""Unit-cost anomaly analysis of work orders per product and production scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.functions.text import cell_text, clean
from ledgerloom.operators import robust
from ledgerloom.operators.facts import DONE, TOTAL, positive
from ledgerloom.rules import MAX_BROADCAST_PRODUCTS, RuleSet
from ledgerloom.session import stage
from ledgerloom.sources.rows import ROW_ID

RANK = "product_rank"
POOL = ["pool_code", "pool_name", "scope"]
METRICS = tuple(C.METRICS)


def keep_listed(work_orders: DataFrame, rules: RuleSet) -> DataFrame:
    """Inner join with the product whitelist on the exact (code, name) pair.

    An empty whitelist keeps everything. ``product_rank`` is the position in the list.
    """
    rows = work_orders.withColumns(
        {"pool_code": cell_text(work_orders, C.PRODUCT_CODE), "pool_name": cell_text(work_orders, C.PRODUCT_NAME)}
    )
    if not rules.products:
        return rows.withColumn(RANK, F.lit(0))
    listed = _ranked(work_orders, rules)
    if len(rules.products) <= MAX_BROADCAST_PRODUCTS:
        listed = F.broadcast(listed)
    return rows.join(listed, ["pool_code", "pool_name"])


def _ranked(df: DataFrame, rules: RuleSet) -> DataFrame:
    first: dict[tuple[str, str], int] = {}
    for rank, (code, name, _) in enumerate(rules.products):
        first.setdefault((code, name), rank)
    return df.sparkSession.createDataFrame(
        [(*pair, rank) for pair, rank in first.items()], f"pool_code string, pool_name string, {RANK} int"
    )


def display_order(df: DataFrame, period: str, order_no: str, line: str) -> list[Column]:
    """Sort key: list position, period, order number, then numeric lines before text lines.

    Rows that are alike in all of these stay in ledger order.
    """
    text = clean(cell_text(df, line))
    number = text.try_cast("decimal(38,10)")
    return [
        F.col(RANK),
        clean(cell_text(df, period)),
        clean(cell_text(df, order_no)),
        number.isNull(),
        number,
        F.when(number.isNull(), text),
        *([F.col(ROW_ID)] if ROW_ID in df.columns else []),
    ]


def production_scope(doc_type: Column) -> Column:
    scope = F.lit(C.SCOPE_UNKNOWN)
    for text, name in C.DOC_TYPE_SCOPES.items():
        scope = F.when(clean(doc_type) == text, name).otherwise(scope)
    return scope


def with_scope(rows: DataFrame) -> DataFrame:
    """Production scope, and whether the row can be analyzed at all."""
    rows = rows.withColumn("scope", production_scope(cell_text(rows, C.DOC_TYPE)))
    fit = positive(rows) & (F.col("unit_total") > 0) & (F.col("scope") != C.SCOPE_UNKNOWN)
    return rows.withColumn("can_analyze", F.coalesce(fit, F.lit(False)))


def with_logs(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``log_<metric>`` of positive unit costs on analyzable rows, else NULL."""
    return rows.selectExpr(
        "*",
        *[f"CASE WHEN can_analyze AND unit_{m} > 0 THEN ln(CAST(unit_{m} AS double)) END AS log_{m}" for m in metrics],
    )


def unpivot_metrics(rows: DataFrame, ids: list[str], values: dict[str, str], value_name: str = "value") -> DataFrame:
    """One row per (row, metric) with a non-NULL value: a narrow expansion before partial sums.

    ``values`` maps a metric to the SQL expression of its value.
    """
    wide = rows.selectExpr(*ids, *[f"{expr} AS {m}" for m, expr in values.items()])
    return wide.unpivot(ids, list(values), "metric", value_name).where(F.col(value_name).isNotNull())


def _widen(stats: DataFrame, pool: list[str], metrics: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """Pool statistics with one column per (statistic, metric)."""
    return stats.groupBy(*pool).agg(
        *[
            F.expr(f"max(CASE WHEN metric = '{m}' THEN {c} END) AS {prefix}_{m}")
            for m in metrics
            for c, prefix in columns.items()
        ]
    )


def metric_statistics(
    rows: DataFrame,
    pool: list[str],
    weight: str = DONE,
    metrics: tuple[str, ...] = METRICS,
    buckets: tuple[robust.Bucket, ...] = robust.LOG_BUCKETS,
) -> DataFrame:
    """Per pool, for every metric: center, MAD and pool size, side by side in one row.

    Long rows exist only on the way into partial sums; the deviations are built from
    wide rows joined once with the wide centers.
    """
    keys = [*pool, "metric"]
    logs = unpivot_metrics(rows, [*pool, weight], {m: f"log_{m}" for m in metrics})
    centers = robust.weighted_median(logs, keys, "value", weight, buckets)
    centers = centers.where(F.col("pool_rows") >= C.MIN_POOL_SIZE)
    # One short row per pool. Written once, it is not derived again at every later step.
    wide = stage(_widen(centers, pool, metrics, {"median": "center", "pool_rows": "n"}), "centers")
    spread = rows.select(*pool, weight, *[f"log_{m}" for m in metrics]).join(wide, pool)
    gaps = unpivot_metrics(spread, [*pool, weight], {m: f"abs(log_{m} - center_{m})" for m in metrics})
    mads = robust.weighted_median(gaps, keys, "value", weight, buckets, "mad")
    return stage(wide.join(_widen(mads, pool, metrics, {"mad": "mad"}), pool), "metric_statistics")


def with_scores(rows: DataFrame, stats: DataFrame, pool: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Effective MAD and modified z-score of every metric, computed inside one row."""
    joined = rows.join(stats, pool, "left")
    floored = joined.selectExpr(
        "*",
        *[
            f"CASE WHEN mad_{m} IS NOT NULL THEN greatest(mad_{m}, {C.MIN_LOG_MAD}D) END AS mad_eff_{m}"
            for m in metrics
        ],
    )
    return floored.selectExpr(
        "*", *[f"{C.Z_SCALE}D * (log_{m} - center_{m}) / mad_eff_{m} AS z_{m}" for m in metrics]
    )


def with_verdict(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Level and main source of each row, from the largest absolute score.

    Ties name several sources, unless the total is among them. Rows without a known
    scope get neither; normal rows name no source.
    """
    sizes = ", ".join(f"abs(z_{m})" for m in metrics)
    biggest = f"greatest({sizes})" if len(metrics) > 1 else sizes
    rows = rows.selectExpr("*", f"{biggest} AS z_max")
    ties = " + ".join(f"CASE WHEN abs(z_{m}) = z_max THEN 1 ELSE 0 END" for m in metrics)
    total = f"WHEN abs(z_total) = z_max THEN '{C.METRICS['total'][1]}'" if "total" in metrics else ""
    single = " ".join(f"WHEN abs(z_{m}) = z_max THEN '{C.METRICS[m][1]}'" for m in metrics)
    return rows.selectExpr(
        "*",
        f"""CASE WHEN scope = '{C.SCOPE_UNKNOWN}' THEN ''
                 WHEN z_max > {C.HIGH_LIMIT}D THEN '{C.LEVEL_HIGH}'
                 WHEN z_max > {C.WATCH_LIMIT}D THEN '{C.LEVEL_WATCH}'
                 ELSE '{C.LEVEL_NORMAL}' END AS anomaly_level""",
        f"""CASE WHEN scope = '{C.SCOPE_UNKNOWN}' OR z_max IS NULL OR z_max <= {C.WATCH_LIMIT}D THEN ''
                 {total} WHEN {ties} > 1 THEN '{C.SEVERAL_SOURCES}' {single} END AS anomaly_source""",
    )


def review_reasons(metrics: tuple[str, ...] = METRICS) -> str:
    """SQL of the ``;``-joined reasons: unknown scope first, then each metric without a positive value."""
    missing = [
        f"CASE WHEN NOT coalesce(unit_{m} > 0, false) THEN '{C.METRICS[m][0]}{C.NON_POSITIVE_SUFFIX}' END"
        for m in metrics
    ]
    unknown = f"CASE WHEN scope = '{C.SCOPE_UNKNOWN}' THEN '{C.UNKNOWN_SCOPE_REASON}' END"
    return f"concat_ws(';', {', '.join([unknown, *missing])})"


def explanation(metrics: tuple[str, ...] = METRICS) -> str:
    """SQL of the ``; ``-joined account of every metric graded above normal."""

    def fixed(expr: str, digits: int) -> str:
        return f"format_number(CAST({expr} AS double), '0.{'0' * digits}')"

    def entry(m: str) -> str:
        gap = f"log_{m} - center_{m}"
        level = f"CASE WHEN abs(z_{m}) > {C.HIGH_LIMIT}D THEN '{C.LEVEL_HIGH}' ELSE '{C.LEVEL_WATCH}' END"
        fields = (
            (f"{C.METRICS[m][2]}: ", level),
            ("当前值=", fixed(f"unit_{m}", 2)),
            ("当前log=", fixed(f"log_{m}", 4)),
            ("基准值=", fixed(f"exp(center_{m})", 2)),
            ("基准log=", fixed(f"center_{m}", 4)),
            ("log偏离=", fixed(gap, 4)),
            ("相对偏离=", f"concat({fixed(f'expm1({gap}) * 100', 2)}, '%')"),
            ("score=", fixed(f"z_{m}", 2)),
            ("有效工单数=", f"CAST(n_{m} AS string)"),
            ("原始MAD=", fixed(f"mad_{m}", 4)),
            ("有效MAD=", fixed(f"mad_eff_{m}", 4)),
        )
        text = ", ".join(f"concat('{label}', {value})" for label, value in fields)
        return f"CASE WHEN abs(z_{m}) > {C.WATCH_LIMIT}D THEN concat_ws(', ', {text}) END"

    return f"concat_ws('; ', {', '.join(entry(m) for m in metrics)})"


def prepare(facts: DataFrame, rules: RuleSet) -> DataFrame:
    """Listed work orders (first occurrences) with scope, fitness and log costs."""
    return with_logs(with_scope(keep_listed(facts.where("is_first"), rules)))


def score(prepared: DataFrame) -> DataFrame:
    """Scores, verdict, explanation and reasons.

    The statistics read a narrow table of pools, weights and logs, written once. The scores
    are computed on the full rows, which are read a single time.
    """
    narrow = stage(prepared.select(*POOL, DONE, *[f"log_{m}" for m in METRICS]).where("can_analyze"), "logs")
    stats = metric_statistics(narrow, POOL)
    scored = with_verdict(with_scores(prepared, stats, POOL))
    return scored.selectExpr("*", f"{explanation()} AS explanation", f"{review_reasons()} AS review_reason")


def analysis_columns(rules: RuleSet) -> list[str]:
    """Layout of the analysis table with the standalone pairs inserted at their markers."""
    columns = list(C.ANALYSIS_LAYOUT)
    fallback = C.STANDALONE_ANALYSIS_COLUMNS[C.OUTSOURCED]
    for item in rules.standalone_items:
        pair = C.STANDALONE_ANALYSIS_COLUMNS.get(item.strip(), fallback)
        for marker, name in zip(("总单位完工成本", C.ANALYZABLE), pair, strict=True):
            if name not in columns:
                columns.insert(columns.index(marker), name)
    return columns


def analysis_table(scored: DataFrame, rules: RuleSet, ordered: bool = False) -> DataFrame:
    """Analysis output under its labels; ``ordered`` adds the global display sort.

    Without a whitelist the display order is that of the ledger.
    """
    month = C.MONTH if C.MONTH in scored.columns else C.PERIOD
    values = {
        "月份": month, "成本中心": C.COST_CENTER, "产品编码": C.PRODUCT_CODE, "产品名称": C.PRODUCT_NAME,
        "规格型号": C.SPEC, "工单编号": C.ORDER_NO, "工单行": C.ORDER_LINE, "基本单位": C.UNIT,
        "生产类型": "scope", "本期完工数量": DONE, "总完工成本": TOTAL, "异常等级": "anomaly_level",
        "异常主要来源": "anomaly_source", "异常明细解释": "explanation", "复核原因": "review_reason",
    }
    values |= {f"{label}合计完工金额": b for b, label in C.BUCKET_LABELS.items()}
    values |= {label: f"unit_{m}" for m, (label, _, _) in C.METRICS.items()}
    fallback = C.STANDALONE_ANALYSIS_COLUMNS[C.OUTSOURCED]
    for bucket, item in rules.standalone_buckets().items():
        amount, unit = C.STANDALONE_ANALYSIS_COLUMNS.get(item.strip(), fallback)
        values.setdefault(amount, bucket)
        values.setdefault(unit, f"unit_{bucket}")

    def value(label: str) -> Column:
        if label == C.ANALYZABLE:
            return F.when(F.col("can_analyze"), C.YES).otherwise(C.NO)
        name = values[label]
        return F.col(f"`{name}`") if name in scored.columns else F.lit(None).cast("string")

    if ordered:
        as_read = not rules.products and ROW_ID in scored.columns
        order = [F.col(ROW_ID)] if as_read else display_order(scored, month, C.ORDER_NO, C.ORDER_LINE)
        scored = scored.orderBy(*order)
    return scored.select(*[value(c).alias(c) for c in analysis_columns(rules)])
