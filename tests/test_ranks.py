from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import diff
from ledgerloom.operators.ranks import row_numbers


def test_row_numbers_run_through_all_ranges(spark):
    values = [(7919 * i % 1000, i) for i in range(1000)] + [(None, -1)]
    df = spark.createDataFrame(values, "v int, i int").repartition(7)
    got = [(r["row_number"], r["v"]) for r in row_numbers(df, ["v"]).orderBy("row_number").collect()]
    assert got == [(1, None)] + [(n + 2, n) for n in range(1000)]
    assert row_numbers(df.limit(0), ["v"]).count() == 0


def test_rows_without_a_key_are_paired_by_place(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "o int, t string")
    a = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "o int, t string")
    found = diff.positional_diff(e, a, [F.col("o"), F.col("t")], ["t"]).collect()
    assert sorted((r["row_number"], r["mismatch_kind"]) for r in found) == [
        (2, "value_mismatch"), (3, "value_mismatch"), (4, "storage_type_mismatch"),
    ]


def test_comparisons_deal_rows_before_they_aggregate(spark):
    # a frequent key, repeated rows and a blank key
    rows = [(1, 10 * (i % 3)) for i in range(40)] + [(i, i) for i in range(2, 30)] + [(None, 1), (None, 2)]
    left = spark.createDataFrame(rows, "k int, v int")
    right = spark.createDataFrame(rows[1:-1], "k int, v int")
    found = (
        diff._digests(left, right, ["k"], ["v"]),
        diff._keyed_sums(left, right, ["k"], ["v"]),
        diff.key_problems(left, ["k"]),
    )
    for df in found:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan.split("Aggregate", 1)[1]
    assert {r["k"]: (r["n_expected"], r["n_actual"]) for r in found[0].collect()} == {
        1: (40, 39), None: (2, 1), **{i: (1, 1) for i in range(2, 30)}
    }
    assert sorted((r["mismatch_kind"], r["key_rows"]) for r in found[2].collect()) == [
        ("blank_group_key", 2), ("duplicate_group_key", 40),
    ]


def test_partitioned_staging_sorts_nothing_in_plain_sessions(spark):
    before = spark.conf.get(session.WRITERS_SETTING)
    spark.conf.unset(session.WRITERS_SETTING)
    try:
        with session._side_by_side(spark):
            assert spark.conf.get(session.WRITERS_SETTING) == "8"
        assert spark.conf.get(session.WRITERS_SETTING, None) is None
        staged = session.stage(spark.range(30).selectExpr("id", "id % 3 AS part"), "parts", partition_by=("part",))
        assert sorted(r["id"] for r in staged.where("part = 1").collect()) == list(range(1, 30, 3))
    finally:
        spark.conf.set(session.WRITERS_SETTING, before)
