"""Registered queries: the operators bound to the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom import rules as R
from ledgerloom.functions import text as X
from ledgerloom.operators import anomaly, diff, facts, issues, normalize, policy, robust, split
from ledgerloom.operators.fill import BLOCK, BLOCK_ROWS, Guard, ordered_fill
from ledgerloom.plans import ledger_run
from ledgerloom.rules import MonthRange, RuleSet
from ledgerloom.session import stage, staging_root
from ledgerloom.sources import discovery
from ledgerloom.sources.rows import ROW_ID, SRC_ID, read_table
from ledgerloom.sources.text import read_ledger

# Whitelist for the ledger derived from the tables: every brand, three of its six types.
LISTED_TYPES = ("ECONOMY", "LARGE", "PROMO")
DERIVED_RULES = RuleSet(
    "sk",
    C.STANDALONE_ITEMS["sk"],
    tuple((f"Brand#{b}", t, 10 * (3 * b + i)) for b in range(1, 26) for i, t in enumerate(LISTED_TYPES)),
)
MONTHS = MonthRange("1996-03", "1998-07")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ ledger derived from the tables
LEDGER_COLUMNS = {
    # what a quantity row (step 0) carries; other rows leave it to the fill
    C.PERIOD: "concat(year(o_orderdate), '年', month(o_orderdate), '期')",
    C.COST_CENTER: "CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN '集成车间' "
    "ELSE concat('车间', l_suppkey % 5) END",
    C.PRODUCT_CODE: "p_brand",
    C.PRODUCT_NAME: "p_type",
    C.SPEC: "concat('S', p_size)",
    C.ORDER_NO: "CAST(l_orderkey AS string)",
    C.ORDER_LINE: "concat(l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN '.0' ELSE '' END)",
    C.VENDOR_CODE: "CASE WHEN l_suppkey % 3 = 0 THEN concat('V', l_suppkey) END",
    C.VENDOR_NAME: "CASE WHEN l_suppkey % 4 = 0 THEN concat('N', l_suppkey) END",
    C.UNIT: "'PCS'",
    C.DOC_TYPE: "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '汇报入库-普通生产' "
    "WHEN '2' THEN '汇报入库-普通生产' WHEN '3' THEN '直接入库-普通生产' WHEN '4' THEN '汇报入库-返工生产' "
    "ELSE '其他入库' END",
}
LEDGER_STEPS = """CASE step
    WHEN 1 THEN '直接材料' WHEN 3 THEN '直接人工' WHEN 4 THEN '制造费用_其他' WHEN 5 THEN '制造费用-人工'
    WHEN 6 THEN '制造费用_机物料及低耗'
    WHEN 7 THEN CASE WHEN l_partkey % 41 = 0 THEN '制造费用_未分类' ELSE '制造费用_折旧' END
    WHEN 8 THEN '制造费用_水电费' WHEN 9 THEN '委外加工费'
    WHEN 10 THEN CASE WHEN l_partkey % 31 = 0 THEN '未映射费用' ELSE '软件费用' END END"""
# Shares of a line's price in hundredths; depreciation and utilities are equal on purpose.
LEDGER_SHARES = {
    "material": "35 + l_partkey % 13",
    "labor": "5 + l_partkey % 11",
    "other": "3 + l_suppkey % 7",
    "moh_labor": "2 + l_linenumber",
    "consumables": "1 + l_orderkey % 5",
    "even": "1 + (l_partkey + l_suppkey) % 3",
}
LEDGER_CENTS = """CASE step
    WHEN 0 THEN CASE WHEN l_orderkey % 83 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN cents + 1 ELSE cents END
    WHEN 1 THEN material WHEN 2 THEN material
    WHEN 3 THEN CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE labor END
    WHEN 4 THEN other WHEN 5 THEN moh_labor WHEN 6 THEN consumables WHEN 7 THEN even WHEN 8 THEN even
    WHEN 9 THEN cents div 25
    WHEN 10 THEN cents - material - labor - other - moh_labor - consumables - even * 2 - cents div 25
    ELSE cents END"""


# order lines in a partition of the derived ledger, which has twelve rows of each
LEDGER_LINES = 1 << 16


def derived_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw ledger in lineitem file order: per line one quantity row, nine or ten cost rows,
    one material subtotal and one total row. Identity columns stand on the quantity row only.

    The joined lines are staged, then dealt by the blocks of the fill before they multiply.
    """
    wanted = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    # the table may be one row group, read by one task; runs of rows are spread before they multiply
    lines = read_table(spark, f"{sf_dir}/lineitem.parquet", wanted).repartition(F.floor(F.col(ROW_ID) / 1024))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    base = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    base = stage(base.drop("o_orderkey", "p_partkey"), "ledger_lines", codec="zstd")
    # so many rows of a line make a block, and so many lines a partition
    runs = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LEDGER_LINES))
    base = base.withColumn(BLOCK, F.floor(F.col(ROW_ID) * 16 / BLOCK_ROWS))
    base = base.repartition(runs, SRC_ID, BLOCK).sortWithinPartitions(SRC_ID, ROW_ID)
    base = base.selectExpr("*", "CAST(CAST(l_extendedprice AS decimal(18,2)) * 100 AS bigint) AS cents")
    # all that depends on the line alone is made once a line, below the steps
    base = base.selectExpr("*", *[f"cents * ({share}) div 100 AS {name}" for name, share in LEDGER_SHARES.items()])
    base = base.selectExpr("*", *[f"{expr} AS _line{i}" for i, expr in enumerate(LEDGER_COLUMNS.values())])
    steps = base.selectExpr("*", "explode(sequence(0, 11)) AS step")
    identity = [f"CASE WHEN step = 0 THEN _line{i} END AS `{name}`" for i, name in enumerate(LEDGER_COLUMNS)]
    identity[0] = f"CASE step WHEN 0 THEN _line0 WHEN 11 THEN '合计' END AS `{C.PERIOD}`"
    return steps.selectExpr(
        *identity,
        f"CASE WHEN step = 2 THEN concat('M', l_partkey) END AS `{C.CHILD_MATERIAL}`",
        f"{LEDGER_STEPS} AS `{C.COST_ITEM}`",
        f"""CASE WHEN step = 0 AND l_orderkey % 97 <> 0 THEN
            CASE WHEN l_orderkey % 89 = 0 THEN 0 ELSE CAST(l_quantity AS decimal(18,6)) END END AS `{C.DONE_QTY}`""",
        f"CAST(CAST({LEDGER_CENTS} AS decimal(18,0)) * 0.01BD AS decimal(18,2)) AS `{C.DONE_AMOUNT}`",
        SRC_ID,
        f"{ROW_ID} * 16 + step AS {ROW_ID}",
        BLOCK,
    )


_runs: dict[tuple[str, str, str], ledger_run.CostRun] = {}


def derived_run(spark: SparkSession, sf_dir: str, months: MonthRange | None = None) -> ledger_run.CostRun:
    """The run over the derived ledger, planned and staged once per session and folder.

    A month filter is set upon the whole run where that is there already.
    """
    key = (spark.sparkContext.applicationId, sf_dir, repr(months))
    whole = _runs.get((*key[:2], repr(None)))
    if key not in _runs and whole:
        _runs[key] = whole.within(months)
    elif key not in _runs:
        _runs[key] = ledger_run.run(derived_ledger(spark, sf_dir), DERIVED_RULES, months, blank_text=False)
    return _runs[key]


def _plain_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routed ledger of the run without the columns its preparation added."""
    added = (facts.KEY, facts.BUCKET, facts.AMOUNT, facts.DONE, facts.VALIDITY)
    return derived_run(spark, sf_dir).routed.drop(*added)


# ------------------------------------------------------------------ normalize
def total_row_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kept = normalize.drop_total_rows(orders, ("o_orderpriority", "o_orderstatus", "o_custkey"), "LOW")
    return kept.select("o_orderkey", "o_orderpriority")


def _periods(spark, sf_dir):
    text = """CASE o_orderkey % 5
        WHEN 0 THEN concat(year(o_orderdate), '年', month(o_orderdate), '期')
        WHEN 1 THEN date_format(o_orderdate, 'yyyyMM')
        WHEN 2 THEN concat('　', date_format(o_orderdate, 'yyyy-MM'), ' ')
        WHEN 3 THEN concat(year(o_orderdate), '年期') ELSE '  ' END"""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS `{C.PERIOD}`")


def period_key_label(spark, sf_dir):
    labelled = normalize.with_month(_periods(spark, sf_dir))
    return labelled.select(
        "o_orderkey", X.period_key(F.col(C.PERIOD)).alias("period_key"), F.col(C.MONTH).alias("month_label")
    )


def month_range_filter(spark, sf_dir):
    labelled = normalize.with_month(_periods(spark, sf_dir))
    return normalize.in_months(labelled, MONTHS).select("o_orderkey", F.col(C.MONTH).alias("month_label"))


def _event_ledger(spark, sf_dir):
    """Events in id order, with the type known on every third event only."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE WHEN user_id % 3 = 0 THEN event_type ELSE '  ' END AS kind",
        "CASE WHEN event_type = 'purchase' THEN CAST(value AS decimal(18,2)) END AS paid",
        "CASE WHEN event_type IN ('view', 'click') THEN concat('u', user_id) END AS actor",
    )


def ordered_fill_events(spark, sf_dir):
    filled = ordered_fill(
        _event_ledger(spark, sf_dir), {"paid": "paid", "actor": "actor"}, row="event_id", scope=(), block_rows=4096
    )
    return filled.select("event_id", "paid", "actor")


def conditional_fill(spark, sf_dir):
    guard = Guard("kind", "error", ("actor",))
    filled = ordered_fill(
        _event_ledger(spark, sf_dir),
        {"kind": "kind", "actor": "actor"},
        (guard,),
        row="event_id",
        scope=(),
        block_rows=4096,
    )
    return filled.select("event_id", "kind", "actor")


def filled_cost_item(spark, sf_dir):
    filled = ordered_fill(
        _event_ledger(spark, sf_dir), {"filled_kind": "kind"}, row="event_id", scope=(), block_rows=4096
    )
    return filled.select("event_id", X.clean(F.col("kind")).alias("kind"), "filled_kind")


# ------------------------------------------------------------------ split and keys
def ledger_split(spark, sf_dir):
    routed = derived_run(spark, sf_dir).routed
    item = F.coalesce(F.col(C.COST_ITEM), F.lit("")).alias("cost_item")
    return routed.groupBy(F.col(split.ROUTE).alias("route"), item).agg(F.count(F.lit(1)).alias("route_rows"))


def key_normalize(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "concat('　', c_name, ' ') AS a",
        "concat(c_custkey, CASE c_custkey % 3 WHEN 0 THEN '.0' WHEN 1 THEN ' ' ELSE '.00' END) AS b",
        "CAST(c_acctbal AS decimal(18,4)) AS c",
        "CASE WHEN c_nationkey > 5 THEN concat(c_nationkey, 'x.0') END AS d",
    )
    return customers.select("c_custkey", facts.work_order_key(customers, ("a", "b", "c", "d")).alias("row_key"))


def normalized_ledger(spark, sf_dir):
    """Filled identity of every cost center and vendor, counted over the whole ledger."""
    routed = derived_run(spark, sf_dir).routed
    names = {"month": C.MONTH, "cost_center": C.COST_CENTER, "vendor_code": C.VENDOR_CODE, "vendor_name": C.VENDOR_NAME}
    keys = [F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in names.items()]
    return routed.groupBy(*keys).agg(F.count(F.lit(1)).alias("ledger_rows"))


# ------------------------------------------------------------------ facts
FACT_COLUMNS = ("key_rows", *facts.BASE_BUCKETS, "standalone_0", "standalone_1")


def cost_bucket_pivot(spark, sf_dir):
    detail = split.part(_plain_ledger(spark, sf_dir), split.DETAIL)
    return facts.bucket_amounts(facts.prepare_detail(detail, DERIVED_RULES), DERIVED_RULES)


def _detail_issues(spark, sf_dir, kind):
    run = derived_run(spark, sf_dir)
    found = issues.detail_issues(run.prepared.where(F.col(split.ROUTE) == split.DETAIL))
    return found.where(F.col("issue_type") == kind).select("source_row", "row_id", "field_name", "original_value")


def unmapped_audit(spark, sf_dir):
    return _detail_issues(spark, sf_dir, "UNMAPPED_COST_ITEM")


def missing_amount_audit(spark, sf_dir):
    return _detail_issues(spark, sf_dir, "MISSING_AMOUNT")


def qty_validity(spark, sf_dir):
    qty = split.part(_plain_ledger(spark, sf_dir), split.QTY)
    return facts.prepare_qty(qty).groupBy(facts.VALIDITY).agg(F.count(F.lit(1)).alias("qty_rows"))


def amount_limits(spark, sf_dir):
    """Validity and findings of quantities and totals at the limits of the decimals."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        f"l_orderkey * 8 + l_linenumber AS {ROW_ID}", f"'2025年1期' AS `{C.PERIOD}`",
        f"CAST(l_partkey AS string) AS `{C.PRODUCT_CODE}`", f"'x' AS `{C.PRODUCT_NAME}`",
        f"CAST(l_orderkey AS string) AS `{C.ORDER_NO}`", f"CAST(l_linenumber AS string) AS `{C.ORDER_LINE}`",
        f"""CASE l_partkey % 7 WHEN 0 THEN concat(l_linenumber, '000000000000') WHEN 1 THEN '0.0000004'
            WHEN 2 THEN concat(l_linenumber, '.1234567') WHEN 3 THEN concat(l_linenumber, repeat('0', 28)) ELSE '7' END AS `{C.DONE_QTY}`""",
        f"""CASE l_suppkey % 5 WHEN 0 THEN concat(l_linenumber, '000000000000000000')
            WHEN 1 THEN concat(l_linenumber, '.12345678901') WHEN 2 THEN concat(l_linenumber, '.', repeat('1', 29))
            WHEN 3 THEN 'none' ELSE '5' END AS `{C.DONE_AMOUNT}`""",
    )
    prepared = facts.prepare_qty(rows)
    found = issues.qty_issues(prepared).select("source_row", "issue_type", "field_name", "original_value")
    validity = prepared.select(F.col(ROW_ID).alias("source_row"), facts.VALIDITY).distinct()
    return validity.join(found, "source_row", "left")


def duplicate_keys(spark, sf_dir):
    qty = split.part(_plain_ledger(spark, sf_dir), split.QTY)
    return facts.key_counts(facts.valid_qty(facts.prepare_qty(qty))).where("key_rows > 1")


def first_occurrence(spark, sf_dir):
    first = facts.first_occurrences(derived_run(spark, sf_dir).facts)
    return first.select(facts.KEY, F.col(ROW_ID).alias("source_row"))


def fact_join_reconcile(spark, sf_dir):
    return derived_run(spark, sf_dir).facts.select(
        F.col(ROW_ID).alias("source_row"), facts.KEY, *FACT_COLUMNS, "moh_components", "derived_total",
        "moh_matches", "total_matches",
    )


def check_status(spark, sf_dir):
    done = derived_run(spark, sf_dir).facts
    return done.groupBy("check_status", "check_reason").agg(F.count(F.lit(1)).alias("fact_rows"))


def unit_cost(spark, sf_dir):
    units = [f"CAST(round(unit_{m}, 8) AS double) AS unit_{m}" for m in (*C.METRICS, "standalone_0", "standalone_1")]
    return derived_run(spark, sf_dir).facts.selectExpr(f"{ROW_ID} AS source_row", *units)


def quantity_table(spark, sf_dir):
    """The quantity output under its labels."""
    return derived_run(spark, sf_dir).quantity_table.select(
        *[F.col(c).alias(a) for c, a in QTY_OUTPUT.items()],
        *[F.round(F.col(c), 8).cast("double").alias(a) for c, a in QTY_UNITS.items()],
    )


def published_quantity(spark, sf_dir):
    """The quantity output as published: the whole run is written, moved into place and read back."""
    target = f"{staging_root(spark)}/ledgerloom/{uuid.uuid4().hex}/published"
    paths = derived_run(spark, sf_dir).publish(target)
    return spark.read.parquet(paths[C.QTY_TABLE]).select(
        *[F.col(c).alias(a) for c, a in QTY_OUTPUT.items()],
        *[F.round(F.col(c), 8).cast("double").alias(a) for c, a in QTY_UNITS.items()],
    )


QTY_OUTPUT = {
    C.MONTH: "month", C.COST_CENTER: "cost_center", C.PRODUCT_CODE: "product_code", C.PRODUCT_NAME: "product_name",
    C.SPEC: "spec", C.ORDER_NO: "order_no", C.ORDER_LINE: "order_line", "本期完工直接材料合计完工金额": "dm_amount",
    "本期完工制造费用合计完工金额": "moh_amount", "本期完工软件费用合计完工金额": "software_amount",
    C.MOH_MATCH_COLUMN: "moh_match", DERIVED_RULES.total_expression + C.TOTAL_MATCH_SUFFIX: "total_match",
    C.CHECK_STATUS_COLUMN: "check_status", C.CHECK_REASON_COLUMN: "check_reason",
}
QTY_UNITS = {"直接材料单位完工金额": "dm_unit", "软件费用单位完工成本": "software_unit"}


def detail_table(spark, sf_dir):
    """The detail output under its labels, summed per product, center and cost item."""
    detail = derived_run(spark, sf_dir).detail_table
    keys = {C.PRODUCT_CODE: "product_code", C.COST_CENTER: "cost_center", C.COST_ITEM: "cost_item"}
    return detail.groupBy(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in keys.items()]).agg(
        F.count(F.lit(1)).alias("detail_rows"),
        F.sum(C.DONE_AMOUNT).alias("amount"),
        F.count(C.CHILD_MATERIAL).alias("material_rows"),
    )


# ------------------------------------------------------------------ issues
ISSUE_COLUMNS = ("source_row", "seq", "row_id", "issue_type", "field_name", "original_value", "reason", "action")


def nonpositive_unit_cost(spark, sf_dir):
    found = issues.fact_issues(derived_run(spark, sf_dir).facts, DERIVED_RULES)
    return found.where("issue_type = 'NON_POSITIVE_UNIT_COST'").select(
        "source_row", "row_id", "field_name", "original_value"
    )


def reconcile_issues(spark, sf_dir):
    found = issues.fact_issues(derived_run(spark, sf_dir).facts, DERIVED_RULES)
    return found.where(F.col("issue_type").isin("MOH_BREAKDOWN_MISMATCH", "TOTAL_COST_MISMATCH")).select(
        "source_row", "row_id", "issue_type", "original_value", "reason"
    )


def issue_log(spark, sf_dir):
    return derived_run(spark, sf_dir).issues.select("phase", *ISSUE_COLUMNS)


def issue_counts(spark, sf_dir):
    return issues.issue_counts(derived_run(spark, sf_dir).issues)


# ------------------------------------------------------------------ anomaly analysis
def whitelist_order(spark, sf_dir):
    """The listed work orders in display order (the driver compares them as a set)."""
    listed = anomaly.keep_listed(facts.first_occurrences(derived_run(spark, sf_dir).facts), DERIVED_RULES)
    ordered = listed.orderBy(*anomaly.display_order(listed, C.MONTH, C.ORDER_NO, C.ORDER_LINE))
    return ordered.select(anomaly.RANK, facts.KEY)


def production_scope(spark, sf_dir):
    scoped = anomaly.with_scope(derived_run(spark, sf_dir).facts)
    return scoped.groupBy("scope", "can_analyze").agg(F.count(F.lit(1)).alias("fact_rows"))


def metric_unpivot(spark, sf_dir):
    ready = anomaly.prepare(derived_run(spark, sf_dir).facts, DERIVED_RULES)
    long = anomaly.unpivot_metrics(ready, anomaly.POOL, {m: f"log_{m}" for m in C.METRICS})
    return long.groupBy(*anomaly.POOL, "metric").agg(
        F.count(F.lit(1)).alias("pool_rows"), F.round(F.min("value"), 8).alias("low"), F.round(F.max("value"), 8).alias("high")
    )


_scored: dict[tuple[str, str], DataFrame] = {}


def _scores(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scored:
        _scored[key] = stage(derived_run(spark, sf_dir).scored(), "scored")
    return _scored[key]


def row_verdict(spark, sf_dir):
    return _scores(spark, sf_dir).select(facts.KEY, "scope", "can_analyze", "anomaly_level", "anomaly_source")


def review_reasons(spark, sf_dir):
    return _scores(spark, sf_dir).select(facts.KEY, "review_reason")


def explanations(spark, sf_dir):
    return _scores(spark, sf_dir).select(facts.KEY, "explanation")


def metric_scores(spark, sf_dir):
    return _scores(spark, sf_dir).selectExpr(
        facts.KEY, *[f"round(z_{m}, 6) AS z_{m}" for m in C.METRICS], *[f"n_{m}" for m in ("total", "moh_labor")]
    )


def analysis_table(spark, sf_dir):
    """The analysis output under its labels."""
    out = anomaly.analysis_table(_scores(spark, sf_dir), DERIVED_RULES)
    return out.select(
        *[F.col(c).alias(a) for c, a in ANALYSIS_OUTPUT.items()],
        *[F.round(F.col(c), 8).cast("double").alias(a) for c, a in ANALYSIS_UNITS.items()],
    )


ANALYSIS_OUTPUT = {
    "月份": "month", "成本中心": "cost_center", "产品编码": "product_code", "产品名称": "product_name",
    "工单编号": "order_no", "工单行": "order_line", "生产类型": "scope", "本期完工数量": "qty",
    "总完工成本": "total", "直接人工合计完工金额": "dl_amount", "委外加工费合计完工金额": "outsource_amount",
    "是否可参与分析": "analyzable", "异常等级": "level", "异常主要来源": "source",
}
ANALYSIS_UNITS = {"总单位完工成本": "total_unit", "软件费用单位完工成本": "software_unit"}


# ------------------------------------------------------------------ robust statistics on line items
def _prices(spark, sf_dir):
    """Log unit price of each line item, weighted by quantity, pooled by brand and type."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_type", "CAST(l_quantity AS decimal(18,6)) AS weight",
        "CAST(l_extendedprice AS decimal(18,2)) / CAST(l_quantity AS decimal(18,6)) AS price",
    ).selectExpr("*", "ln(CAST(price AS double)) AS log_price")


PRICE_POOL = ["p_brand", "p_type"]


def weighted_median(spark, sf_dir):
    """Weighted median unit price per pool. Prices are positive, so log-width buckets order them."""
    buckets = (lambda v: F.floor(F.ln(v.cast("double")) * 8), lambda v: F.floor(v * 16))
    prices = stage(_prices(spark, sf_dir).select(*PRICE_POOL, "price", "weight"), "prices")
    return robust.weighted_median(prices, PRICE_POOL, "price", "weight", buckets).select(
        *PRICE_POOL, F.round("median", 8).cast("double").alias("median"), "pool_rows"
    )


def weighted_mad(spark, sf_dir):
    prices = stage(_prices(spark, sf_dir).select(*PRICE_POOL, "log_price", "weight"), "prices")
    centers = stage(robust.weighted_median(prices, PRICE_POOL, "log_price", "weight"), "centers")
    return robust.weighted_mad(prices, PRICE_POOL, "log_price", "weight", centers).select(
        *PRICE_POOL, F.round("mad", 8).alias("mad")
    )


def _price_scores(spark, sf_dir):
    prices = _prices(spark, sf_dir)
    stats = robust.pool_statistics(prices, PRICE_POOL, "log_price", "weight")
    scored = prices.join(stats, PRICE_POOL, "left")
    z = robust.modified_z(F.col("log_price"), F.col("median"), robust.effective_mad(F.col("mad")))
    return scored.withColumn("z", z)


def modified_zscore(spark, sf_dir):
    return _price_scores(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("z", 6).alias("z")
    )


def grade_counts(spark, sf_dir):
    scored = _price_scores(spark, sf_dir)
    return scored.groupBy("p_brand", robust.grade(F.round("z", 9)).alias("grade")).agg(F.count(F.lit(1)).alias("line_rows"))


# ------------------------------------------------------------------ quality and run summary
def quality_metrics(spark, sf_dir):
    return derived_run(spark, sf_dir).quality


def run_counts(spark, sf_dir):
    return derived_run(spark, sf_dir).counts


def month_filtered_quality(spark, sf_dir):
    return derived_run(spark, sf_dir, MONTHS).quality


def run_record(spark, sf_dir):
    run = derived_run(spark, sf_dir)
    files = discovery.content_identity(spark, sf_dir, "lineitem.parquet")
    return run.record(inputs=files.withColumn("path", F.substring_index("path", "/", -1)))


# ------------------------------------------------------------------ sources
def null_profile(spark, sf_dir):
    rows = _event_ledger(spark, sf_dir)
    return discovery.null_profile(rows)


def content_identity(spark, sf_dir):
    files = discovery.content_identity(spark, sf_dir, "*.parquet")
    return files.select(F.substring_index("path", "/", -1).alias("file"), "size", "sha256")


def text_identity(spark, sf_dir):
    """Content identity of every document: bytes and SHA-256, row by row and so without a size limit."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256")
    )


def text_ledger_scan(spark, sf_dir):
    """Orders written as delimited ledger files with metadata and header rows, then scanned back.

    Files of at most 20,000 orders, in two header layouts.
    """
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey % 2 + o_orderkey div 40000 * 2 AS book",
        "o_orderkey + 10 AS at",
        """CASE WHEN o_orderkey % 2 = 0
           THEN concat_ws(',', concat(year(o_orderdate), '年', month(o_orderdate), '期'), o_orderkey,
                          concat('"', o_orderpriority, ', "",""', '"'), o_totalprice, 'beyond')
           ELSE concat_ws(',', o_orderkey, concat(year(o_orderdate), '年', month(o_orderdate), '期'), o_totalprice)
           END AS line""",
    )
    books = rows.select("book").distinct()
    heads = books.selectExpr(
        "book",
        """inline(CASE WHEN book % 2 = 0 THEN array(
               struct(0L AS at, 'Export' AS line), struct(1L AS at, 'Generated data' AS line),
               struct(2L AS at, '年期,工单编号,费用, 本期完工' AS line), struct(3L AS at, ',,项目,金额' AS line))
           ELSE array(
               struct(0L AS at, '工单编号,年期,本期完工金额,物料编码' AS line),
               struct(1L AS at, ',,本期完工金额,Unnamed: 3' AS line)) END)""",
    )
    path = f"{staging_root(spark)}/ledgerloom/{uuid.uuid4().hex}/text"
    both = rows.unionByName(heads).repartition("book").sortWithinPartitions("book", "at")
    both.select("book", "line").write.partitionBy("book").text(path)
    ledger = read_ledger(spark, path)
    return ledger.select(
        F.col(C.ORDER_NO).cast("bigint").alias("order_no"),
        X.period_key(F.col(C.PERIOD)).alias("period_key"),
        F.col(C.COST_ITEM).alias("cost_item"),
        F.col(C.DONE_AMOUNT).cast("decimal(18,2)").alias("amount"),
        F.col(C.CHILD_MATERIAL).alias("material"),
    )


# ------------------------------------------------------------------ comparison
def _order_versions(spark, sf_dir):
    """Orders and a perturbed copy: tiny and real price changes, blanks, lost rows, text changes."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "CAST(o_totalprice AS decimal(28,10)) AS price", "o_custkey"
    )
    changed = base.where("o_orderkey % 101 <> 0").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 41 = 0 THEN concat(o_orderpriority, '!') ELSE o_orderpriority END AS o_orderpriority",
        """CAST(CASE WHEN o_orderkey % 29 = 0 THEN price + 0.0000001 WHEN o_orderkey % 31 = 0 THEN price + 0.0000000001
           ELSE price END AS decimal(28,10)) AS price""",
        "o_custkey",
    )
    return base, changed


def cell_diff(spark, sf_dir):
    return diff.cell_diff(*_order_versions(spark, sf_dir), ["o_orderkey"])


def cell_diff_columns(spark, sf_dir):
    """Columns that only one side has."""
    base, _ = _order_versions(spark, sf_dir)
    other = base.drop("o_custkey").withColumn("note", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'x' END"))
    return diff.cell_diff(base, other, ["o_orderkey"])


def cell_diff_repeated_keys(spark, sf_dir):
    """Line items keyed by order alone: most keys repeat on a side."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS decimal(18,2)) AS qty")
    return diff.cell_diff(lines.drop("l_linenumber"), lines.where("l_linenumber <> 2").drop("l_linenumber"), ["l_orderkey"])


def shape_diff(spark, sf_dir):
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem")
    return diff.shape_diff(
        {"orders": orders, "lines": lines, "part": parts},
        {"orders": orders.where("o_orderkey % 101 <> 0"), "lines": lines, "part": parts.drop("p_name")},
    )


def positional_diff(spark, sf_dir):
    """Cells of two versions of the order lines, paired by their place alone."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    lines = table(spark, sf_dir, "lineitem").select(*order)
    changed = lines.selectExpr(
        *order[:4],
        "CASE WHEN l_orderkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity",
        "CASE WHEN l_partkey % 40 <> 0 THEN l_returnflag END AS l_returnflag",
    ).where("l_linenumber < 100")
    longer = lines.unionByName(lines.where("l_linenumber = 1").withColumn("l_orderkey", F.lit(2**60) + F.col("l_orderkey")))
    return diff.positional_diff(longer, changed, order, ["l_quantity", "l_returnflag"])


def run_compare(spark, sf_dir):
    """Every difference of two versions of a table in one report."""
    versions = [{"orders": v} for v in _order_versions(spark, sf_dir)]
    return diff.compare_runs(*versions, {"orders": ["o_orderkey"]}, {"orders": ["price"]})


def header_policy(spark, sf_dir):
    """Two versions of the three output tables under the rule set ``gb``, filled from the order lines.

    The quantity table of the second one lacks a column and has one of the other rule set, its detail amounts differ.
    """
    rules = RuleSet.named("gb")
    numbers, keys = policy.numeric_columns(rules), policy.group_keys()
    keys_and_price = ["l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"]
    lines = diff.spread(table(spark, sf_dir, "lineitem").select(*keys_and_price), *keys_and_price)
    lines = lines.groupBy(*keys_and_price[:3]).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,10)").alias("price")
    )
    lines = stage(lines, "policy_lines")
    source = (F.lit("2026-01"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber"))
    lost, foreign = C.QTY_UNIT_COLUMNS["dl"], C.STANDALONE_UNIT_COLUMNS[C.SOFTWARE]

    def filled(name):
        values = [F.when(F.col("l_partkey") % 100 == 0, F.col("price")) if c == lost else F.col("price") for c in numbers[name]]
        labels = [*keys[name], *numbers[name]]
        return lines.select(*[v.alias(c) for v, c in zip((*source[: len(keys[name])], *values), labels, strict=True)])

    expected = {name: filled(name) for name in C.OUTPUT_TABLES}
    qty, detail = expected[C.QTY_TABLE], expected[C.DETAIL_TABLE]
    actual = expected | {
        C.QTY_TABLE: qty.drop(lost).withColumn(foreign, F.when(F.col(C.PRODUCT_CODE) % 90 == 0, F.lit(1))),
        C.DETAIL_TABLE: detail.withColumn(C.DONE_AMOUNT, (F.col(C.DONE_AMOUNT) + 1).cast("decimal(28,10)")),
    }
    return policy.compare_outputs(expected, actual, rules)


def cell_diff_report(spark, sf_dir):
    """The first twenty mismatches by coordinate; the limit is the report's own."""
    found = diff.cell_diff(*_order_versions(spark, sf_dir), ["o_orderkey"])
    return diff.bounded_report(found, ["o_orderkey", "column_name", "mismatch_kind"])


def column_totals_diff(spark, sf_dir):
    return diff.column_totals_diff(*_order_versions(spark, sf_dir), ["o_orderkey"], ["price", "o_custkey"])


def group_totals_diff(spark, sf_dir):
    return diff.group_totals_diff(*_order_versions(spark, sf_dir), ["o_orderkey"], ["price"])


def _line_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "CASE WHEN l_partkey % 19 = 0 THEN '　' ELSE CAST(l_linenumber AS string) END AS line", "l_tax",
        "CASE WHEN l_partkey % 23 = 0 THEN 'n/a' WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_partkey AS string) END AS note",
    )


def dup_blank_keys(spark, sf_dir):
    return diff.key_problems(_line_keys(spark, sf_dir), ["l_orderkey", "line"])


def numeric_problems(spark, sf_dir):
    found = diff.numeric_problems(_line_keys(spark, sf_dir), ["l_orderkey"], ["l_tax", "note"])
    return found.groupBy("l_orderkey", "column_name", "mismatch_kind").agg(F.count(F.lit(1)).alias("cells"))


def run_contract_diff(spark, sf_dir):
    """Metrics and issue counts of the whole run against those of the month-filtered run."""
    whole, some = derived_run(spark, sf_dir), derived_run(spark, sf_dir, MONTHS)
    metrics = [r.quality.select("category", "metric", "value") for r in (whole, some)]
    counts = [issues.issue_counts(r.issues) for r in (whole, some)]
    return diff.run_contract_diff(*metrics, *counts)


# ------------------------------------------------------------------ rules
def _product_dimension(spark, sf_dir):
    """Parts as a product list: real names repeat, and some codes and orders are spoiled."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS position",
        "CASE WHEN p_partkey % 43 = 0 THEN concat(p_brand, ' ') WHEN p_partkey % 47 = 0 THEN ' ' "
        "ELSE concat('P', p_partkey div 2 * 2 + CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_partkey % 2 END) END AS code",
        "p_name AS name",
        "CAST(CASE WHEN p_partkey % 59 = 58 THEN p_partkey - 1 ELSE p_partkey END AS int) AS display_order",
    )


def product_dim_check(spark, sf_dir):
    return R.product_problems(_product_dimension(spark, sf_dir), "position").groupBy("problem").agg(
        F.count(F.lit(1)).alias("problem_rows"), F.sum("display_order").alias("order_sum")
    )


def rules_fingerprint(spark, sf_dir):
    """Fingerprint of the product list made of every brand and type that occurs."""
    pairs = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").cast("int").alias("display_order"))
    products = pairs.select(F.col("p_brand").alias("code"), F.col("p_type").alias("name"), "display_order")
    return R.fingerprint(products, "sk", C.STANDALONE_ITEMS["sk"])


def all_queries():
    chosen = (
        total_row_filter, period_key_label, month_range_filter, ordered_fill_events, conditional_fill,
        filled_cost_item, key_normalize, normalized_ledger, ledger_split, cost_bucket_pivot, unmapped_audit,
        missing_amount_audit, qty_validity, duplicate_keys, first_occurrence, fact_join_reconcile, check_status,
        unit_cost, quantity_table, detail_table, nonpositive_unit_cost, reconcile_issues, issue_log, issue_counts,
        whitelist_order, production_scope, metric_unpivot, row_verdict, review_reasons, explanations, metric_scores,
        analysis_table, weighted_median, weighted_mad, modified_zscore, grade_counts, quality_metrics, run_counts,
        month_filtered_quality, run_record, null_profile, content_identity, text_ledger_scan, cell_diff,
        cell_diff_report, column_totals_diff, group_totals_diff, dup_blank_keys, numeric_problems,
        run_contract_diff, product_dim_check, rules_fingerprint, amount_limits, cell_diff_columns,
        cell_diff_repeated_keys, shape_diff, positional_diff, run_compare, header_policy, text_identity, published_quantity,
    )
    return {q.__name__: q for q in chosen}
