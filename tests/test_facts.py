import decimal
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.functions import numbers
from ledgerloom.operators import facts, issues, joins, quality, split
from ledgerloom.rules import RuleSet
from ledgerloom.sources.rows import ROW_ID

GB = RuleSet("gb", C.STANDALONE_ITEMS["gb"])
SK = RuleSet("sk", C.STANDALONE_ITEMS["sk"])
KEYS = ["月份", "产品编码", "产品名称", "工单编号", "工单行号"]
BASE = ("2025年01期", "P1", "产品", "WO1", "1")


def detail(spark, *rows, base=BASE):
    data = [(*base, item, amount, i) for i, (item, amount) in enumerate(rows)]
    names = ", ".join(f"`{c}` string" for c in [*KEYS, C.COST_ITEM, C.DONE_AMOUNT])
    return spark.createDataFrame(data, names + f", {ROW_ID} bigint")


def qty(spark, *rows):
    data = [((*BASE, q, t) if len(r) == 2 else (*r[2], q, t)) + (100 + i,) for i, r in enumerate(rows) for q, t in [r[:2]]]
    names = ", ".join(f"`{c}` string" for c in [*KEYS, C.DONE_QTY, C.DONE_AMOUNT])
    return spark.createDataFrame(data, names + f", {ROW_ID} bigint")


def build(spark, details, quantities, rules=GB, rows_per_salt=1_000_000):
    prepared = facts.prepare_detail(details, rules)
    valid = facts.valid_qty(facts.prepare_qty(quantities))
    summary = facts.key_counts(valid).join(facts.bucket_amounts(prepared, rules), facts.KEY, "left")
    return prepared, facts.build_facts(valid, summary, rules, rows_per_salt)


@pytest.mark.parametrize(
    ("item", "bucket"),
    [
        ("直接材料", "dm"), (" 直接人工 ", "dl"), ("制造费用_折旧", "moh_depreciation"), ("制造费用-人工", "moh_labor"),
        ("制造费用_人工", "moh"), ("制造费用_未分类", "moh"), ("委外加工费", "standalone_0"), ("软件费用", "standalone_1"), ("x", None),
    ],
)
def test_classification(spark, item, bucket):
    df = spark.createDataFrame([(item,)], "i string")
    assert df.select(facts.cost_bucket(F.col("i"), SK.standalone_buckets())).first()[0] == bucket
    if item == "软件费用":
        assert df.select(facts.cost_bucket(F.col("i"), GB.standalone_buckets())).first()[0] is None


def test_component_counts_twice_and_unknown_component_once(spark):
    rows = detail(spark, ("制造费用_折旧", "12.50"), ("制造费用_未分类", "9"))
    got = facts.bucket_amounts(facts.prepare_detail(rows, GB), GB).first()
    assert (got["moh"], got["moh_depreciation"], got["moh_other"]) == (D("21.5"), D("12.5"), 0)
    _, done = build(spark, rows, qty(spark, ("1", "21.5")))
    row = done.first()
    assert not row["moh_matches"] and row["total_matches"] and row["check_reason"] == C.MOH_CHECK_REASON


def test_issue_payloads_and_order(spark):
    rows = detail(
        spark, ("直接材料", None), ("直接材料", "1"), ("未映射费用", "3"), (" ", "4"), ("直接人工", "1"),
        *[(item, "1") for item in C.OVERHEAD_ITEMS.values()],
    )
    prepared, done = build(spark, rows, qty(spark, ("1", "7"), ("2", "8")))
    log = issues.issue_log(prepared, done, GB).orderBy(*issues.ORDER).collect()
    assert [r["issue_type"] for r in log] == [
        "MISSING_AMOUNT", "UNMAPPED_COST_ITEM", "DUPLICATE_WORK_ORDER_KEY", "DUPLICATE_WORK_ORDER_KEY", "TOTAL_COST_MISMATCH",
    ]
    assert tuple(log[1][f] for f in issues.FIELDS) == (
        "2025年01期|P1|WO1|1", "UNMAPPED_COST_ITEM", "成本项目名称", "未映射费用", "成本项目未映射到直接材料/直接人工/制造费用",
        "该行已从分析数据中排除", False,
    )
    assert log[2]["original_value"] == "2" and log[4]["original_value"] == "计算值=7;数量页=8"
    assert log[4]["reason"] == "直接材料+直接人工+制造费用+委外加工费不等于数量页总完工成本"


def test_amount_that_is_no_number_is_reported_with_its_text(spark):
    prepared = facts.prepare_detail(detail(spark, ("直接材料", "1,000"), ("直接材料", " 2 "), ("直接材料", "9" * 29)), GB)
    found = issues.detail_issues(prepared).orderBy("source_row").collect()
    assert [r["original_value"] for r in found] == ["1,000", "9" * 29]
    assert facts.bucket_amounts(prepared, GB).first()["dm"] == 2


def test_quantity_without_details_is_zero_everywhere(spark):
    _, done = build(spark, detail(spark), qty(spark, ("1", "0")), SK)
    row = done.first()
    assert all(row[b] == 0 for b in (*facts.BASE_BUCKETS, "standalone_0", "standalone_1"))
    assert row["total_matches"] and row["check_status"] == C.PASSED
    found = issues.fact_issues(done, SK).orderBy("seq").collect()
    assert [r["field_name"] for r in found] == [m[0] for m in C.METRICS.values()]
    assert {r["original_value"] for r in found} == {"0"}


def test_keys_join_after_normalization(spark):
    rows = detail(spark, ("直接材料", "10"), base=(" 2025年01期 ", " P1 ", "产品", " WO1 ", " 1.0 "))
    _, done = build(spark, rows, qty(spark, ("2", "10")))
    row = done.first()
    assert (row["dm"], row["work_order_key"], row["unit_dm"]) == (10, "2025年01期|P1|WO1|1", 5)


def test_validity_counts_a_doubly_bad_row_once(spark):
    prepared = facts.prepare_qty(qty(spark, (None, None), ("0", "1"), ("-1", "1"), ("x", "1"), ("1", None), ("1", "1")))
    got = dict(prepared.groupBy(facts.VALIDITY).count().collect())
    assert got == {facts.BAD_QTY: 4, facts.NO_TOTAL: 1, facts.VALID: 1}


def test_duplicates_keep_rows_and_the_first_is_the_work_order(spark):
    other = ("2025年01期", "P2", "产品", "WO2", "1")
    for salt in (1, 1_000_000):
        _, done = build(spark, detail(spark, ("直接材料", "5")), qty(spark, ("1", "5"), ("2", "5"), ("3", "5", other)), rows_per_salt=salt)
        got = sorted((r[ROW_ID], r["key_rows"], r["is_first"], r["dm"]) for r in done.collect())
        assert got == [(100, 2, True, 5), (101, 2, False, 5), (102, 1, True, 0)]


def test_hot_key_join_equals_plain_join(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 97 END AS k")
    lookup = spark.range(90).selectExpr("id AS k", "id * 10 AS v")
    hot = joins.hot_keys(rows, ["k"], 100)
    assert [tuple(r) for r in hot.collect()] == [(0, 11)]
    got = joins.lookup_join(rows, lookup, ["k"], hot, "id")
    assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=str) == sorted(
        map(tuple, rows.join(lookup, "k", "left").select("id", "k", "v").collect()), key=str
    )


def test_join_without_hot_keys_takes_the_lookup_as_it_was_dealt(spark):
    rows = spark.range(60).selectExpr("id", "CAST(id % 7 AS string) AS k")
    lookup = spark.range(30).selectExpr("CAST(id % 5 AS string) AS k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = joins.lookup_join(rows, lookup, ["k"], joins.hot_keys(rows, ["k"], 1000), "id")
    assert got.columns == ["k", "id", "n"]
    assert "_salt" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.select("k", "n").distinct().orderBy("k").collect()] == [
        *[(str(k), 6) for k in range(5)], ("5", None), ("6", None),
    ]


def test_quantity_table_layout(spark):
    _, done = build(spark, detail(spark, ("直接材料", "100"), ("委外加工费", "5")), qty(spark, ("10", "105")))
    out = facts.quantity_table(done, GB)
    assert out.columns[-4:] == [
        "制造费用明细项合计是否等于制造费用合计", "直接材料+直接人工+制造费用+委外加工费是否等于总完工成本", "数据校验状态", "异常原因说明",
    ]
    row = out.first()
    assert row["委外加工费单位完工成本"] == D("0.5") and row["数据校验状态"] == "通过" and row["异常原因说明"] == ""


def test_sums_that_overflow_are_never_zero(spark):
    big = "900000000000000000"
    rows = detail(spark, ("直接材料", big), ("直接材料", big), ("直接人工", "1"))
    prepared, done = build(spark, rows, qty(spark, ("1", "5")))
    row = done.first()
    assert row["dm"] is None and row["dl"] == 1 and row["derived_total"] is None
    assert not row["total_matches"] and row["check_status"] == C.NEEDS_REVIEW
    found = {(r["issue_type"], r["field_name"]) for r in issues.fact_issues(done, GB).collect()}
    assert {("SUM_OUT_OF_RANGE", "dm"), ("SUM_OUT_OF_RANGE", "derived_total")} <= found


def test_only_numbers_beyond_all_digits_are_reported(spark):
    rows = qty(
        spark, ("2000000000000", "5"), ("0.0000004", "5"), ("1", "1000000000000000000"), ("1", "0.12345678901"), ("x", "5"), ("1", None),
        ("1", "5"), ("9" * 29, "5"), ("1", "1" + "0" * 28), ("1", "0." + "1" * 29), ("0." + "0" * 28 + "4", "5"), ("-0.0000004", "5"), ("4e-7", "5"),
    )
    prepared = facts.prepare_qty(rows)
    assert [r[0] for r in prepared.orderBy(ROW_ID).select(facts.VALIDITY).collect()] == [
        facts.VALID, facts.VALID, facts.VALID, facts.VALID, facts.BAD_QTY, facts.NO_TOTAL,
        facts.VALID, facts.OUT_OF_RANGE, facts.OUT_OF_RANGE, facts.VALID, facts.BAD_QTY, facts.BAD_QTY, facts.VALID,
    ]
    got = sorted((r["source_row"], r["issue_type"], r["original_value"]) for r in issues.qty_issues(prepared).collect())
    assert got == [
        (107, "NUMBER_OUT_OF_RANGE", "9" * 29), (108, "NUMBER_OUT_OF_RANGE", "1" + "0" * 28),
        (109, "NUMBER_ROUNDED", "0." + "1" * 29), (110, "NUMBER_ROUNDED", "0." + "0" * 28 + "4"),
    ]
    counts = quality.ledger_counts(prepared.withColumn(split.ROUTE, F.lit(split.QTY))).first()
    assert counts["invalid_qty_rows"] + counts["missing_total_rows"] + counts["out_of_range_rows"] + 7 == counts["qty_input_rows"] == 13


@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(0, 28), st.booleans()), min_size=1, max_size=12))
@settings(max_examples=15, deadline=None)
def test_number_and_rest_are_the_cell(spark, cells):
    texts = [("-" if minus else "") + format(D(n).scaleb(-scale), "f") for n, scale, minus in cells] + ["12345678901234567890.5", "1e3", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "cell string")
    for kind in (numbers.MONEY, numbers.QUANTITY):
        for r in numbers.with_number(df, "cell", kind, "v", "rest", "misfit").collect():
            if r["cell"] in ("x", None):
                assert r["v"] is None and r["rest"] is None and r["misfit"] is None
                continue
            rest = r["rest"]["whole"] + r["rest"]["part"] if r["rest"] else 0
            assert decimal.Context(60).add(r["v"], rest) == D(r["cell"]), r


def test_reconciliation_compares_all_digits(spark):
    tiny = "0.0000000000000000000000000001"
    for other, same in (("0." + "0" * 27 + "2", True), ("0." + "0" * 27 + "3", False), ("0", False)):
        amounts = [("制造费用_折旧", tiny), ("制造费用_其他", tiny), ("直接材料", "123456789012345678901.25"), ("直接人工", "-123456789012345678901")]
        total = D("0.25") + D(other)
        done = build(spark, detail(spark, *amounts), qty(spark, ("1", format(total, "f"))))[1].first()
        assert done["moh_matches"] and done["total_matches"] == same
    unknown = [("制造费用_折旧", tiny), ("制造费用_未分类", tiny)]
    done = build(spark, detail(spark, *unknown), qty(spark, ("1", "0." + "0" * 27 + "2")))[1].first()
    assert not done["moh_matches"] and done["total_matches"]


def test_unit_costs_of_tiny_and_large_quantities(spark):
    rows = detail(spark, ("直接材料", "9999999999"))
    quantities = qty(spark, ("0.0000000000000000000000000001", "9999999999"), ("0.0000004", "5"), ("3000000000000", "6"))
    done = build(spark, rows, quantities)[1].orderBy(ROW_ID).collect()
    assert [r["unit_total"] for r in done] == [None, D("12500000"), D("0.000000000002")]
    assert not any(r["field_name"] in ("总单位完工成本",) for r in issues.fact_issues(build(spark, rows, quantities)[1], GB).collect() if r["issue_type"] == "NON_POSITIVE_UNIT_COST")
