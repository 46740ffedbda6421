import math
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.operators import anomaly, facts, quality, robust
from ledgerloom.rules import RuleSet
from ledgerloom.sources.rows import ROW_ID

GB = RuleSet("gb", C.STANDALONE_ITEMS["gb"])
SK = RuleSet("sk", C.STANDALONE_ITEMS["sk"])
NORMAL, REWORK = "汇报入库-普通生产", "汇报入库-返工生产"


def work_orders(spark, rows, rules=GB):
    """Facts of work orders: (order, total, doc type[, qty[, line[, month[, code, name]]]])."""
    data = []
    for i, r in enumerate(rows):
        order, total, doc, qty, line, month, code, name = [*r, *["1", "1", "2025年01期", "P1", "产品"][len(r) - 3 :]]
        data.append((month, code, name, order, line, doc, D(qty), D(str(total)), f"k{i}", i))
    df = spark.createDataFrame(
        data,
        "`月份` string, `产品编码` string, `产品名称` string, `工单编号` string, `工单行号` string, `单据类型` string, "
        f"done_qty decimal(18,6), done_total decimal(28,10), work_order_key string, {ROW_ID} bigint",
    )
    zero = F.lit(0).cast("decimal(28,10)")
    df = df.withColumns({b: zero for b in (*facts.BASE_BUCKETS, *rules.standalone_buckets())})
    df = df.withColumn("dm", F.col("done_total")).withColumns({"is_first": F.lit(True), "key_rows": F.lit(1)})
    return facts.with_unit_costs(df, rules)


def analyse(spark, rows, rules=GB):
    return anomaly.score(anomaly.prepare(work_orders(spark, rows, rules), rules))


def brute_median(pairs):
    pairs = sorted(p for p in pairs if p[1] > 0)
    half, upto = sum(w for _, w in pairs) / 2, 0
    for v, w in pairs:
        upto += w
        if upto > half:
            return v
    return None


@pytest.mark.parametrize(
    ("pairs", "median"), [([(1, 1), (10, 10), (100, 1)], 10), ([(1, 1), (2, 1)], 2), ([(1, 0), (2, -1), (3, 1)], 3)]
)
def test_weighted_median_vectors(spark, pairs, median):
    df = spark.createDataFrame([("p", float(v), D(w)) for v, w in pairs], "pool string, v double, w decimal(18,6)")
    got = robust.weighted_median(df, ["pool"], "v", "w")
    assert got.first()["median"] == median
    if median == 10:
        assert robust.weighted_mad(df, ["pool"], "v", "w", got).first()["mad"] == 0


def test_weighted_median_equals_brute_force_for_any_buckets(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(5)}", round(rng.gauss(4, 0.4), rng.choice([1, 9])), D(rng.randrange(0, 6))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "pool string, v double, w decimal(18,6)")
    expected = {p: brute_median([(v, w) for q, v, w in rows if q == p]) for p in {r[0] for r in rows}}
    for buckets in ((), robust.widths(0.5), robust.LOG_BUCKETS):
        got = {r["pool"]: r["median"] for r in robust.weighted_median(df, ["pool"], "v", "w", buckets).collect()}
        assert got == expected


@pytest.mark.parametrize(("z", "level"), [(None, None), (2.5, "正常"), (2.6, "关注"), (3.5, "关注"), (-3.6, "高度可疑")])
def test_grades(spark, z, level):
    assert spark.createDataFrame([(z,)], "z double").select(robust.grade(F.col("z"))).first()[0] == level


def test_levels_sources_and_explanation(spark):
    totals = (100, 101, 102, 103, 106, 115, 130)
    rows = analyse(spark, [(f"WO{t}", t, NORMAL) for t in totals]).orderBy("done_total").collect()
    assert [r["anomaly_level"] for r in rows] == ["正常"] * 5 + ["关注", "高度可疑"]
    assert [r["anomaly_source"] for r in rows[4:]] == ["", "总成本异常", "总成本异常"]
    text = rows[6]["explanation"]
    assert text.startswith("总成本: 高度可疑, 当前值=130.00, 当前log=4.8675, 基准值=103.00, 基准log=4.6347, log偏离=0.2328, 相对偏离=26.21%, score=")
    assert "有效工单数=7, 原始MAD=" in text and "; 直接材料: 高度可疑" in text and rows[0]["explanation"] == ""


def test_scopes_have_pools_of_their_own_and_two_rows_are_no_pool(spark):
    rows = [("a", 100, NORMAL), ("b", 105, NORMAL), ("c", 500, NORMAL), ("d", 200, REWORK), ("e", 210, REWORK), ("f", 500, REWORK)]
    got = {r["工单编号"]: r for r in analyse(spark, rows).collect()}
    assert got["c"]["anomaly_level"] == got["f"]["anomaly_level"] == "高度可疑" and got["f"]["scope"] == "返工生产"
    assert all(r["z_total"] is None and r["anomaly_level"] == "正常" for r in analyse(spark, rows[:2]).collect())


def test_near_zero_mad_uses_the_floor(spark):
    rows = [("1", "10000", REWORK, "100"), ("2", "71000.000568", REWORK, "710"), ("3", "10001", REWORK, "100"), ("4", "12000", REWORK, "100"), ("5", "18000", REWORK, "100")]
    got = {r["工单编号"]: r for r in analyse(spark, rows).collect()}
    assert got["3"]["anomaly_level"] == "正常" and got["3"]["explanation"] == ""
    assert got["4"]["anomaly_level"] == got["5"]["anomaly_level"] == "高度可疑"
    assert got["4"]["mad_eff_total"] == C.MIN_LOG_MAD == pytest.approx(math.log1p(0.005), rel=1e-12)


def test_verdict_ties(spark):
    zs = {"total": None, "dm": 3.0, "dl": -3.0, **{m: None for m in list(C.METRICS)[3:]}}
    df = spark.createDataFrame([(C.SCOPE_NORMAL, *zs.values())], "scope string, " + ", ".join(f"z_{m} double" for m in zs))
    row = anomaly.with_verdict(df).first()
    assert (row["anomaly_level"], row["anomaly_source"]) == ("关注", "多项同时异常")
    assert anomaly.with_verdict(df.withColumn("z_total", F.lit(3.0))).first()["anomaly_source"] == "总成本异常"
    assert anomaly.with_verdict(df.withColumn("z_dm", F.lit(3.6))).first()["anomaly_source"] == "材料异常"
    assert anomaly.with_verdict(df.withColumn("scope", F.lit(C.SCOPE_UNKNOWN))).first()["anomaly_level"] == ""


def test_unknown_document_type(spark):
    row = analyse(spark, [("WO1", 100, "其他入库")]).first()
    labels = [m[0] for m in C.METRICS.values()][2:]
    assert row["review_reason"] == ";".join(["单据类型未归类，不参与正常生产/返工生产异常池", *[x + "小于等于0或为空" for x in labels]])
    assert (row["anomaly_level"], row["anomaly_source"], row["can_analyze"]) == ("", "", False)


def test_whitelist_is_exact_and_gives_the_order(spark):
    rules = RuleSet("gb", GB.standalone_items, (("P2", "产品二", 10), ("P1", "产品一", 20)))
    rows = [
        ("B", 1, NORMAL, "1", "1", "2025年02期", "P1", "产品一"), ("A", 1, NORMAL, "1", "10", "2025年01期", "P1", "产品一"),
        ("A", 1, NORMAL, "1", "2", "2025年01期", "P1", "产品一"), ("A", 1, NORMAL, "1", "x", "2025年01期", "P1", "产品一"),
        ("C", 1, NORMAL, "1", "1", "2025年01期", "P1", "产品二"), ("D", 1, NORMAL, "1", "1", "2025年01期", "P2", "产品二"),
        ("E", 1, NORMAL, "1", "1", "2025年01期", "P1", "产品一 "),
    ]
    out = anomaly.analysis_table(analyse(spark, rows, rules), rules, ordered=True)
    assert [(r["工单编号"], r["工单行"]) for r in out.collect()] == [("D", "1"), ("A", "2"), ("A", "10"), ("A", "x"), ("B", "1")]


def test_analysis_layout_inserts_standalone_pairs():
    columns = anomaly.analysis_columns(SK)
    assert len(columns) == 37
    at = columns.index("总单位完工成本")
    assert columns[at - 2 : at] == ["委外加工费合计完工金额", "软件费用合计完工金额"]
    at = columns.index("是否可参与分析")
    assert columns[at - 2 : at] == ["委外加工费单位完工成本", "软件费用单位完工成本"]


def test_quality_rates(spark):
    done = work_orders(spark, [("a", 10, NORMAL), ("b", 10, "其他"), ("c", 0, NORMAL), ("d", -1, NORMAL)])
    counts = quality.fact_counts(done).selectExpr("*", "9L AS detail_rows", "4L AS qty_input_rows", "0L AS invalid_qty_rows", "0L AS missing_total_rows", "13L AS ledger_rows")
    values = [r["value"] for r in quality.quality_metrics(counts).orderBy("position").collect()]
    assert values == ["9", "4", "4", "0", "0", "4", "0.00%", "0", "0", "25.00%"]
    empty = quality.quality_metrics(counts.withColumn("ledger_rows", F.lit(0)), months_filtered=True).orderBy("position").collect()
    assert [r["value"] for r in empty][6] == "N/A" and empty[9]["description"] == C.EMPTY_FILTER_TEXT


def test_dense_pool_goes_on_to_finer_buckets(spark, monkeypatch):
    monkeypatch.setattr(robust, "SORTED_ROWS", 50)
    rows = spark.range(20_000).selectExpr("'p' AS p", "CAST(1 + ((id * 7919) % 20000) * 0.005 / 20000 AS double) AS v", "1 + id % 3 AS w")
    got = robust.weighted_median(rows, ["p"], "v", "w").first()
    values = sorted((r["v"], r["w"]) for r in rows.collect())
    total, running = sum(w for _, w in values), 0
    for v, w in values:
        running += w
        if running * 2 > total:
            break
    assert (got["median"], got["pool_rows"]) == (v, 20_000)
    # the last step orders no more than the rows of one bucket of the last level
    finest = max(sum(1 for x, _ in values if x // 2.0**-33 == y // 2.0**-33) for y, _ in values[::97])
    assert finest <= 50
