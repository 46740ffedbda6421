from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom import rules as R
from ledgerloom.errors import InputNotFound, InvalidInput, OutputExists
from ledgerloom.operators import diff, issues, policy
from ledgerloom.plans import ledger_run
from ledgerloom.rules import MonthRange, RuleSet
from ledgerloom.sinks import tables
from ledgerloom.sources import discovery
from ledgerloom.sources.rows import ROW_ID, SRC_ID, read_table
from ledgerloom.sources.synthetic import synthetic_ledger
from ledgerloom.sources.text import read_ledger, split_cells

GB, SK = RuleSet.named("gb"), RuleSet.named("sk")
OPEN_GB = RuleSet("gb", C.STANDALONE_ITEMS["gb"])


# ------------------------------------------------------------------ text sources
def test_split_cells(spark):
    lines = ["a,,b ", '"x,""y""",2', "", "﻿p,q", ","]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "v string").select(split_cells(F.col("v"))).collect()]
    assert got == [["a", "", "b "], ['x,"y"', "2"], [""], ["p", "q"], ["", ""]]
    with pytest.raises(Exception, match="quoted line breaks"):
        spark.createDataFrame([('a,"b',)], "v string").select(split_cells(F.col("v"))).collect()


def test_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "title\n年期,说明\n\n年期,工单编号,费用,本期,本期\n,,项目,数量,None\n2025年1期,WO1,直接材料,1\n,,, 2 ,x,beyond\n"
    )
    (tmp_path / "b.csv").write_text("年期,工单,工单\n工单编号,产品编码,产品编码\n2025年2期,first,last\n")
    out = read_ledger(spark, str(tmp_path)).orderBy(ROW_ID).collect()
    assert [r["年期"] for r in out] == ["2025年1期", None, None] or out[2]["年期工单编号"] == "2025年2期"
    a, b, c = out
    assert (a["工单编号"], a["成本项目名称"], a["本期数量"], a["本期"]) == ("WO1", "直接材料", "1", None)
    assert (b["工单编号"], b["本期数量"], b["本期"]) == (None, " 2 ", "x")
    assert c["工单产品编码"] == "last" and c[SRC_ID] != a[SRC_ID] and c["工单编号"] is None


def test_file_without_header_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(InvalidInput, match="x.csv"):
        read_ledger(spark, str(tmp_path))


def test_row_ids_follow_file_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ledgerloom.sources.rows.CHUNK_ROWS", 16)
    for i in (2, 1):
        spark.range(100 * i, 100 * i + 50).coalesce(1).write.parquet(str(tmp_path / f"t/part={i}"))
    rows = read_table(spark, str(tmp_path / "t")).orderBy(ROW_ID).collect()
    assert [r["id"] for r in rows] == [*range(100, 150), *range(200, 250)]
    assert [r[ROW_ID] for r in rows] == list(range(100)) and [r[SRC_ID] for r in rows] == [1] * 50 + [2] * 50


def test_discovery_and_identity(spark, tmp_path):
    for name in ("GB-2026-06.CSV", "gb-1.csv", "sk-2026.csv"):
        (tmp_path / name).write_text("abc")
    assert discovery.discover(spark, str(tmp_path), "SK-????.csv").count() == 1
    with pytest.raises(InvalidInput):
        discovery.discover(spark, str(tmp_path), "gb-*.csv")
    assert discovery.discover(spark, str(tmp_path), "gb-*.csv", exactly_one=False).count() == 2
    for folder, pattern in ((tmp_path, "sk-??.csv"), (tmp_path / "none", "gb-*")):
        with pytest.raises(InputNotFound):
            discovery.discover(spark, str(folder), pattern)
    with pytest.raises(InvalidInput):
        discovery.caseless_glob("../x")
    row = discovery.content_identity(spark, str(tmp_path), "gb-1.csv").first()
    assert (row["size"], row["sha256"]) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_null_profile(spark):
    df = spark.createDataFrame([("a", None), (" ", 1.0), (None, 2.0)], "t string, n double")
    got = [tuple(r) for r in discovery.null_profile(df).orderBy("position").collect()]
    assert got == [(0, "t", 2, 3), (1, "n", 1, 3)]


# ------------------------------------------------------------------ whole run
def test_synthetic_ledger_run(spark, tmp_path):
    rules = RuleSet("sk", C.STANDALONE_ITEMS["sk"])
    run = ledger_run.run(synthetic_ledger(spark, SK, 50), rules)
    counts = run.counts.first()
    assert (counts["reader_rows"], counts["detail_rows"], counts["qty_output_rows"]) == (55, 4, 50)
    # the direct-material row has no child material, so it is neither detail nor quantity
    by_type = dict(issues.issue_counts(run.issues).collect())
    assert by_type["TOTAL_COST_MISMATCH"] == 50 and "DUPLICATE_WORK_ORDER_KEY" not in by_type
    record = run.record(outputs={"t": "p"}).first()
    assert record["rule_set"] == "sk" and record["issue_total"] == sum(by_type.values())
    assert record["issue_type_counts"] == by_type and len(record["quality_metrics"]) == 10
    files = spark.createDataFrame([("p", 3, "ab")], "path string, size bigint, sha256 string")
    paths = run.publish(str(tmp_path / "out"), inputs=files)
    assert list(paths) == list(C.OUTPUT_TABLES)
    written = spark.read.json(str(tmp_path / "out" / tables.RUN_RECORD)).first()["inputs"]
    assert (written["files"], written["bytes"], written["sha256"]) == (1, 3, "ab")
    log = [r["issue_type"] for r in spark.read.json(str(tmp_path / "out" / tables.ISSUE_LOG)).collect()]
    assert len(log) == sum(by_type.values()) and log[0] == "TOTAL_COST_MISMATCH"
    assert spark.read.parquet(paths[C.QTY_TABLE]).count() == 50
    assert spark.read.json(str(tmp_path / "out" / tables.RUN_RECORD)).count() == 1
    with pytest.raises(OutputExists):
        run.publish(str(tmp_path / "out"))


def test_facts_are_staged_once_and_only_when_read(spark, monkeypatch):
    staged, stage = [], ledger_run.stage
    monkeypatch.setattr(ledger_run, "stage", lambda df, name, **kw: staged.append(name) or stage(df, name, **kw))
    run = ledger_run.run(synthetic_ledger(spark, GB, 3), OPEN_GB)
    rows, details = run.prepared.count(), run.detail_table.count()
    assert staged == ["routed"]
    assert run.quantity_table.count() == 3 == rows - details > 0 == run.counts.first()["reader_rows"] - run.counts.first()["ledger_rows"]
    assert sorted(staged) == ["facts", "reader_rows", "routed"]


def test_numbers_that_a_cast_or_quotient_makes_again_are_not_staged(spark, tmp_path, monkeypatch):
    staged, stage = {}, ledger_run.stage
    monkeypatch.setattr(ledger_run, "stage", lambda df, name, **kw: staged.update({name: df.columns}) or stage(df, name, **kw))
    run = ledger_run.run(synthetic_ledger(spark, GB, 3), OPEN_GB)
    made = {"amount", "amount_misfit", "done_qty", "qty_misfit"}
    assert made <= set(run.routed.columns) and not made & set(staged["routed"])
    fact = run.facts.where("is_first").orderBy("_row_id").first()
    assert (fact["amount"], fact["done_qty"], fact["unit_total"] * 10) == (fact["done_total"], 10, fact["done_total"])
    assert "dm" in staged["facts"] and not [c for c in staged["facts"] if c.startswith("unit_")]
    head = "年期,产品编码,产品名称,工单编号,工单行号,成本项目名称,本期完工数量,本期完工金额\n,,,,,,,\n"
    (tmp_path / "in.csv").write_text(head + "2026年1期,P,N,W1,1,,10,105\n")
    run = ledger_run.run(read_ledger(spark, str(tmp_path / "in.csv")), OPEN_GB)
    assert made <= set(staged["routed"]) and run.facts.first()["unit_total"] == 10.5


def test_month_filter_that_leaves_nothing(spark):
    run = ledger_run.run(synthetic_ledger(spark, GB, 3), OPEN_GB, MonthRange("2030-01"))
    values = [r["value"] for r in run.quality.orderBy("position").collect()]
    assert values == ["0", "0", "0", "0", "0", "0", "N/A", "0", "0", "N/A"]


def test_text_file_to_tables_with_whitespace_cells(spark, tmp_path):
    lines = [
        "年期,产品编码,产品名称,工单编号,工单行号,成本项目名称,本期完工数量,本期完工金额,单据类型,累计完工金额", ",,,,,,,,,",
        "2026年1期,P,N,W1,1,,10,105,汇报入库-普通生产,n/a", "　, , ,,,直接人工,,100,,", ",,,,,委外加工费,,5,,7", "合计,,,,,,,205,,",
    ]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    run = ledger_run.run(read_ledger(spark, str(tmp_path / "in.csv")), OPEN_GB)
    fact = run.facts.first()
    assert (fact["dl"], fact["standalone_0"], fact["total_matches"], fact["work_order_key"]) == (100, 5, True, "2026年01期|P|W1|1")
    assert run.detail_table.count() == 2
    out = tables.typed(run.quantity_table).first()
    assert out["累计完工金额"] is None and out[tables.NON_NUMERIC] == {"累计完工金额": "n/a"} and out["本期完工金额"] == 105
    paths = run.publish(str(tmp_path / "out"), fmt="csv")
    assert spark.read.option("header", True).csv(paths[C.ANALYSIS_TABLE]).first()["总单位完工成本"].startswith("10.5")


def test_only_the_three_tables_are_published(spark, tmp_path):
    with pytest.raises(InvalidInput):
        tables.publish({C.RETIRED_TABLES[0]: spark.range(1)}, str(tmp_path / "x"))


# ------------------------------------------------------------------ rules
def test_rule_sets(spark):
    assert R.validate(spark, GB) is GB and R.validate(spark, SK) is SK and len(SK.products) == 8
    with pytest.raises(InvalidInput):
        RuleSet.named("other")
    with pytest.raises(InvalidInput, match="standalone"):
        R.validate(spark, RuleSet("gb", ("软件费用",), GB.products))
    swapped = (GB.products[1], GB.products[0], *GB.products[2:])
    for products, problem in (
        ((), "empty"), (swapped, "increasing"), ((GB.products[0], GB.products[0]), "duplicate"),
        ((("A", " ", 1),), "blank_name"), ((("A ", "B", 1),), "untrimmed_code"),
    ):
        with pytest.raises(InvalidInput, match=problem):
            R.validate(spark, RuleSet("gb", GB.standalone_items, products))


def test_fingerprint_follows_content_only(spark):
    def of(rules, table=None):
        table = rules.product_table(spark) if table is None else table
        return R.fingerprint(table, rules.name, rules.standalone_items).first()["fingerprint"]

    assert of(GB) == of(GB, GB.product_table(spark).repartition(5)) != of(SK)


# ------------------------------------------------------------------ comparison
def pair(spark):
    expected = spark.createDataFrame([("a", D("1.0"), "x"), ("b", D("2.0"), None), ("c", D("3.0"), "z"), ("d", D("1"), "q")], "k string, n decimal(28,10), t string")
    actual = spark.createDataFrame([("a", D("1.0000000001"), "x"), ("b", D("2.0000001"), "y"), ("d", D("1"), "q"), ("d", D("1"), "q")], "k string, n decimal(28,10), t string")
    return expected, actual


def test_cell_diff_respects_tolerance_and_types(spark):
    got = sorted((tuple(r) for r in diff.cell_diff(*pair(spark), ["k"]).collect()), key=str)
    assert got == [
        ("b", "n", "value_mismatch", "n", "n"), ("b", "t", "storage_type_mismatch", "blank", "s"),
        ("c", "n", "storage_type_mismatch", "n", "blank"), ("c", "t", "storage_type_mismatch", "s", "blank"),
        ("d", None, "repeated_key", None, None),
    ]
    assert diff.bounded_report(diff.cell_diff(*pair(spark), ["k"]), ["k", "column_name"], 3).count() == 3
    assert diff.cell_diff(pair(spark)[0], pair(spark)[0], ["k"]).count() == 0


def test_cell_diff_sees_columns_of_one_side(spark):
    expected = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, lost int, same string")
    actual = spark.createDataFrame([("a", "x", 5), ("b", None, None)], "k string, same string, new int")
    got = sorted(tuple(r)[:3] for r in diff.cell_diff(expected, actual, ["k"]).collect())
    kind = "storage_type_mismatch"
    assert got == [("a", "lost", kind), ("a", "new", kind), ("b", "lost", kind)]


def test_compare_runs_names_every_kind(spark):
    one, two = pair(spark)
    found = diff.compare_runs({"t": one}, {"t": two}, {"t": ["k"]}, {"t": ["n"]})
    kinds = {(r["column_name"], r["mismatch_kind"]) for r in found.collect()}
    assert (None, "repeated_key") in kinds and (None, "duplicate_group_key") in kinds
    assert ("n", "column_total_mismatch") in kinds and (None, "missing_in_actual") in kinds
    assert diff.compare_runs({"t": one}, {"t": one}, {"t": ["k"]}, {"t": ["n"]}).count() == 0
    assert diff.issue_totals_diff(*[spark.createDataFrame([("A", n)], "issue_type string, issue_count bigint") for n in (1, 1)]).count() == 0


def test_cell_diff_tells_cells_apart_whose_bits_are_alike(spark):
    """A day and an integer, decimals of two scales, and a value that moves into a blank neighbour."""
    expected = spark.sql("SELECT 1 AS k, DATE '1970-01-02' AS d, CAST(1 AS decimal(9,2)) AS n, 7 AS x, CAST(NULL AS int) AS y")
    actual = spark.sql("SELECT 1 AS k, 1 AS d, CAST(100 AS bigint) AS n, CAST(NULL AS int) AS x, 7 AS y")
    got = sorted(tuple(r)[1:3] for r in diff.cell_diff(expected, actual, ["k"]).collect())
    assert got == [("d", "storage_type_mismatch"), ("n", "value_mismatch"), ("x", "storage_type_mismatch"), ("y", "storage_type_mismatch")]
    same = spark.sql("SELECT CAST(NULL AS string) AS k, CAST('NaN' AS double) AS v, CAST(NULL AS int) AS y")
    assert diff.cell_diff(same, same.drop("y"), ["k"]).count() == 0
    plan = diff.cell_diff(expected, expected.withColumn("x", F.lit("t")), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_header_policy_of_rule_sets():
    gb, sk = (policy.header_rules(RuleSet.named(n)) for n in ("gb", "sk"))
    for name in C.OUTPUT_TABLES:
        assert not set(gb[name][0]) & set(gb[name][1]) and not sk[name][1]
        assert set(sk[name][0]) - set(gb[name][0]) == set(gb[name][1])
    assert len(gb[C.QTY_TABLE][1]) == len(gb[C.ANALYSIS_TABLE][1]) == 2 and not gb[C.DETAIL_TABLE][1]
    assert [len(policy.numeric_columns(RuleSet.named("gb"))[t]) for t in C.OUTPUT_TABLES] == [2, 20, 21]


def test_broken_headers_leave_out_totals(spark):
    one = spark.createDataFrame([("a", 1)], "k string, n int")
    two = one.withColumn("n", F.lit(5))
    args = ({"t": one}, {"t": two}, {"t": ["k"]}, {"t": ["n"]})
    assert sorted(r["mismatch_kind"] for r in diff.compare_runs(*args).collect()) == [
        "column_total_mismatch", "group_total_mismatch", "value_mismatch",
    ]
    got = diff.compare_runs(*args, {"t": (["k", "m"], ["n"])}).collect()
    assert sorted((r["mismatch_kind"], r["column_name"]) for r in got) == [
        ("required_header_missing", "m"), ("unexpected_numeric_header", "n"), ("value_mismatch", "n"),
    ]
    twice = one.select("k", "n", F.col("n").alias("n"))
    kinds = [r["mismatch_kind"] for r in diff.compare_runs({"t": twice}, {"t": twice}, {"t": ["k"]}, {"t": ["n"]}).collect()]
    assert kinds == ["duplicate_header"] * 2


def test_old_outputs_stop_a_run_before_it_writes(spark, tmp_path):
    out = tmp_path / "out"
    stale = out / tables.ISSUE_LOG
    stale.mkdir(parents=True)
    with pytest.raises(OutputExists):
        tables.check_free(spark, str(out), (*C.OUTPUT_TABLES, tables.ISSUE_LOG))
    assert [p.name for p in out.iterdir()] == [tables.ISSUE_LOG]
    tables.check_free(spark, str(out), C.OUTPUT_TABLES)
    spark.range(3).write.parquet(str(out / "_part" / "x"))
    tables.promote(spark, str(out / "_part"), str(out), ["x"])
    assert spark.read.parquet(str(out / "x")).count() == 3 and not (out / "_part").exists()


def test_totals_leave_out_repeated_and_blank_keys(spark):
    expected, actual = pair(spark)
    assert [tuple(r) for r in diff.column_totals_diff(expected, actual, ["k"], ["n"]).collect()] == [("n", False)]
    assert diff.column_totals_diff(expected, expected.where("k <> 'x'"), [], ["n"]).first()["matches"]
    got = dict(diff.group_totals_diff(expected, actual, ["k"], ["n"]).collect())
    assert got == {"b": "group_total_mismatch", "c": "missing_in_actual", "d": "missing_in_actual"}
    keys = spark.createDataFrame([("a",), ("a",), ("　",), (None,), ("b",)], "k string")
    problems = sorted((r["mismatch_kind"], r["key_rows"]) for r in diff.key_problems(keys, ["k"]).collect())
    assert problems == [("blank_group_key", 1), ("blank_group_key", 1), ("duplicate_group_key", 2)]


def test_header_shape_and_number_checks(spark):
    assert diff.header_problems(["a", "b", "b"], ["a", "c"], ["a", "b"], ["c"]) == [
        ("duplicate_header", "b"), ("required_header_missing", "b"), ("unexpected_numeric_header", "c"),
    ]
    one, two = spark.range(1), spark.range(2)
    assert diff.shape_problems({"x": one}, {"x": two}) == [("x", "shape_mismatch")]
    assert diff.shape_problems({"x": one}, {C.RETIRED_TABLES[0]: one}) == [(C.RETIRED_TABLES[0], "forbidden_table"), ("", "table_order_mismatch")]
    df = spark.createDataFrame([("a", "1.5"), ("b", "x"), ("c", None)], "k string, n string")
    assert [tuple(r) for r in diff.numeric_problems(df, ["k"], ["n"]).collect()] == [("b", "n", "numeric_storage_invalid")]


def test_run_contract(spark):
    metrics = spark.createDataFrame([("c", "m", "1"), ("c", "n", "2"), ("c", "o", "3")], "category string, metric string, value string")
    other = spark.createDataFrame([("c", "m", "1"), ("c", "n", "5"), ("c", "extra", "3"), ("c", "extra", "3")], metrics.schema)
    counts = spark.createDataFrame([("A", 2)], "issue_type string, issue_count bigint")
    got = sorted(map(tuple, diff.run_contract_diff(metrics, other, counts, counts.withColumn("issue_count", F.lit(3))).collect()))
    assert got == [("duplicate_metric", "c/extra"), ("issue_count_mismatch", "A"), ("issue_total_mismatch", ""), ("metric_mismatch", "c/n"), ("missing_metric", "c/o")]
    assert diff.issue_total_problem(counts, 2).count() == 0 and diff.issue_total_problem(counts, 3).count() == 1
