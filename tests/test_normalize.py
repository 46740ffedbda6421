import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.errors import InvalidInput
from ledgerloom.functions import text as X
from ledgerloom.operators import normalize as N
from ledgerloom.operators import split
from ledgerloom.operators.fill import BLOCK, BLOCK_ROWS, Guard, ordered_fill
from ledgerloom.rules import MonthRange
from ledgerloom.sources.rows import ROW_ID, SRC_ID


def ledger(spark, columns, rows, src=1):
    schema = ", ".join(f"`{c}` string" for c in columns) + f", {SRC_ID} bigint, {ROW_ID} bigint"
    return spark.createDataFrame([(*r, src, i) for i, r in enumerate(rows)], schema)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(ROW_ID).collect()]


VENDOR_LEDGER = ["年期", "成本中心名称", "产品编码", "工单编号", "供应商编码"]


def test_excluded_workshop_neither_receives_nor_seeds_vendors(spark):
    raw = ledger(
        spark,
        VENDOR_LEDGER,
        [
            ("2025年01期", "普通车间", "P1", "WO-1", "V001"),
            (None, "集成车间", None, None, None),
            (None, "集成车间", "P2", "WO-2", "V999"),
            (None, "普通车间", "P3", "WO-3", "  "),
        ],
    )
    got = rows_of(N.normalize(raw, block_rows=2), "产品编码", "供应商编码", "年期")
    assert got == [
        ("P1", "V001", "2025年01期"), ("P1", None, "2025年01期"), ("P2", "V999", "2025年01期"), ("P3", "V001", "2025年01期"),
    ]


def test_fill_equals_sequential_fill_for_any_blocks_and_partitions(spark):
    rng = random.Random(7)
    rows = []
    for src in (1, 2):
        for i in range(400):
            guard = rng.choice([None, None, "open", " shut ", "  "])
            rows.append((src, i, guard, rng.choice([None, None, None, f"v{i}"]), rng.choice([None, i]) if i > 5 else None))
    expected = []
    for src in (1, 2):
        last_g = last_v = last_n = None
        for s, i, g, v, n in rows:
            if s != src:
                continue
            if g is not None and g.strip():
                last_g = g
            g_now = last_g if last_g is not None and (g is None or not g.strip()) else g
            shut = g_now is not None and g_now.strip() == "shut"
            v_now = v
            if not shut:
                if v is not None:
                    last_v = v
                v_now = v if v is not None else last_v
            if n is not None:
                last_n = n
            expected.append((s, i, g_now, v_now, last_n))
    df = spark.createDataFrame(rows, "src long, at long, g string, v string, n long")
    for block, parts in ((7, 3), (64, 1), (100_000, 5)):
        out = ordered_fill(
            df.repartition(parts), {"g": "g", "v": "v", "n": "n"}, (Guard("g", "shut", ("v",)),), "at", ("src",), block
        )
        assert sorted(tuple(r) for r in out.collect()) == sorted(expected)


def test_fill_crosses_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr("ledgerloom.operators.fill.GROUP_BLOCKS", 2)
    df = spark.range(40).selectExpr("id", "CASE WHEN id = 3 THEN 'a' WHEN id = 11 THEN 'b' END AS v")
    out = ordered_fill(df, {"v": "v"}, row="id", scope=(), block_rows=2).orderBy("id").collect()
    assert [r["v"] for r in out] == [None] * 3 + ["a"] * 8 + ["b"] * 29


def test_total_rows_go_before_the_fill_and_numbers_never_match(spark):
    raw = ledger(
        spark,
        ["年期", "成本中心名称", "产品编码"],
        [("2025年1期", "a", "P1"), ("合计", "x", "P9"), (None, "小 合计", "P8"), (None, None, None)],
    )
    assert rows_of(N.normalize(raw), "年期", "产品编码") == [("2025年1期", "P1"), ("2025年1期", "P1")]
    assert N.drop_total_rows(spark.range(3), ("id",), "1").count() == 3


@pytest.mark.parametrize(
    ("period", "label", "key"),
    [
        ("2025年7期", "2025年07期", "2025-07"),
        (" 2025年01期　", "2025年01期", "2025-01"),
        ("202512", "202512", "2025-12"),
        ("2025年13期", "2025年13期", None),
        ("20251", "20251", "2025-01"),
        ("2025", "2025", None),
        ("  ", None, None),
    ],
)
def test_month_label_and_period_key(spark, period, label, key):
    out = N.with_month(ledger(spark, ["年期"], [(period,)]))
    assert out.columns[:2] == ["年期", "月份"]
    row = out.select("月份", X.period_key(F.col("年期")).alias("k")).first()
    assert (row[0], row["k"]) == (label, key)


def test_existing_month_is_replaced_in_place_and_stays_without_a_period(spark):
    out = N.normalize(ledger(spark, ["月份", "年期"], [("old", "2025年07期")]))
    assert out.columns[:2] == ["月份", "年期"] and rows_of(out, "月份") == [("2025年07期",)]
    assert rows_of(N.normalize(ledger(spark, ["月份"], [("manual",)])), "月份") == [("manual",)]


def test_month_filter_stands_above_the_fill(spark):
    raw = ledger(
        spark, ["年期", "产品编码"], [("2025年01期", "P1"), (None, None), ("2025年02期", None), ("bad", "P3")]
    )
    out = N.normalize(raw, MonthRange("2025-02", "2025-02"))
    assert rows_of(out, "年期", "产品编码") == [("2025年02期", "P1")]


@pytest.mark.parametrize("bad", [("2025年01期", None), ("123中a", None), ("2025-13", None), ("2025-02", "2025-01")])
def test_month_range_is_strict(bad):
    with pytest.raises(InvalidInput):
        MonthRange(*bad)


def test_aliases_and_repeated_columns(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "x string, y string, z string, w string")
    out = N.canonical_names(df.toDF("物料编码", "费用项目", "物料编码", "其他"))
    assert out.columns == ["子项物料编码", "成本项目名称", "其他"]
    assert out.first()["子项物料编码"] == "c"
    kept = N.canonical_names(df.toDF("物料编码", "子项物料编码", "p", "q"))
    assert kept.columns == ["物料编码", "子项物料编码", "p", "q"]


def test_filled_cost_item(spark):
    out = N.normalize(ledger(spark, ["成本项目名称"], [(None,), ("直接人工",), (" ",)]))
    assert rows_of(out, "Filled_成本项目", "成本项目名称") == [(None, None), ("直接人工", "直接人工"), ("直接人工", None)]
    assert rows_of(N.normalize(ledger(spark, ["工单编号"], [("1",)])), "Filled_成本项目") == [(None,)]


def test_key_values(spark):
    values = [" 1.0 ", "10.00", "x.0", ".0", "　A B　", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(X.key_value(X.cell_text(df, "v"))).collect()] == ["1", "10.00", "x.0", ".0", "A B", ""]
    numbers = spark.sql("SELECT CAST(10.50 AS decimal(10,4)) AS d UNION ALL SELECT CAST(0 AS decimal(10,4)) UNION ALL SELECT 100")
    assert [r[0] for r in numbers.select(X.cell_text(numbers, "d")).collect()] == ["10.5", "0", "100"]


def test_routes(spark):
    columns = ["工单编号", "成本项目名称", "子项物料编码", "Filled_成本项目"]
    raw = ledger(
        spark,
        columns,
        [
            ("WO", None, None, "x"), (None, None, None, "x"), ("WO", "直接材料", None, "直接材料"),
            ("WO", " 直接材料 ", None, "直接材料"), ("WO", "制造费用", None, "制造费用"), ("WO", None, "M1", "直接人工"),
        ],
    )
    routed = split.route(raw)
    assert rows_of(routed, split.ROUTE, "成本项目名称") == [
        ("qty", None), ("other", None), ("other", "直接材料"), ("other", " 直接材料 "), ("detail", "制造费用"), ("detail", "直接人工"),
    ]
    assert rows_of(split.route(raw.drop("工单编号")), split.ROUTE)[1] == ("qty",)
    assert split.part(routed, split.OTHER).count() == 3


def test_projection_and_required_columns(spark):
    df = ledger(spark, ["备注", "工单编号", "年期"], [("a", "b", "c")])
    assert N.project(df, C.DETAIL_LAYOUT).columns == ["年期", "工单编号"]
    with pytest.raises(InvalidInput, match="产品数量统计缺少必要字段: 产品名称, 产品编码, 工单行号, 本期完工数量, 本期完工金额"):
        N.require(df, C.REQUIRED_QTY, C.QTY_DATASET)


def test_fill_keeps_rows_that_come_dealt_by_block(spark):
    """Rows dealt by scope and block are not shuffled again, neither alone nor with what blocks inherit."""
    rows = [(1 + i % 2, i * 3000, "集成车间" if i % 11 == 5 else f"c{i}" if i % 7 == 0 else None, f"v{i}" if i % 9 == 4 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "_src_id long, _row_id long, center string, vendor string")
    guard = (Guard("center", "集成车间", ("vendor",)),)
    fills = {"center": "center", "vendor": "vendor", "center_above": "center"}
    dealt = df.withColumn(BLOCK, F.floor(F.col("_row_id") / BLOCK_ROWS)).repartition(3, "_src_id", BLOCK)
    filled = ordered_fill(dealt, fills, guard, blank_text=False)
    assert filled.columns == [*df.columns, "center_above"]
    want, state = [], {}
    for src, at, center, vendor in rows:
        held = state.setdefault(src, [None, None])
        held[0] = center or held[0]
        shut = held[0] == "集成车间"
        held[1] = held[1] if shut else vendor or held[1]
        want.append((src, at, held[0], vendor if shut else held[1], held[0]))
    assert sorted(map(tuple, filled.collect()), key=lambda r: r[1]) == want
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            plan = ordered_fill(dealt, fills, guard, blank_text=False)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # without a broadcast the short table of blocks alone is dealt
        assert plan.count("Exchange hashpartitioning") == (1 if limit == "10m" else 2)
