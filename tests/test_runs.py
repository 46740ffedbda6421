"""The packed routed ledger against the same steps row by row."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.operators import facts, runs
from ledgerloom.operators.normalize import normalize
from ledgerloom.operators.split import route
from ledgerloom.plans import ledger_run
from ledgerloom.rules import MonthRange, RuleSet

CHOICES = {
    C.PERIOD: (["2026年1期", "2026年2期", "合计", " "], 0.2),
    C.COST_CENTER: (["集成车间", " 集成车间", "车间1"], 0.25),
    C.PRODUCT_CODE: (["P1", " P2"], 0.3),
    C.PRODUCT_NAME: (["N"], 0.3),
    C.ORDER_NO: (["W1", "7.0", " "], 0.3),
    C.ORDER_LINE: (["1", "2.0"], 0.3),
    C.VENDOR_CODE: (["V1", "V2"], 0.4),
    C.CHILD_MATERIAL: (["M"], 0.2),
    C.COST_ITEM: (["直接材料", " 直接人工", "制造费用_折旧", "未映射", " "], 0.6),
    C.DONE_QTY: (["5", "0", "x", "1.1234567"], 0.5),
    C.DONE_AMOUNT: (["10", "3.5", "none", "1e40"], 0.8),
}


def _ledger(spark, seed, typed, sources=2, rows=60):
    rng = random.Random(seed)
    lines = [
        (*[rng.choice(v) if rng.random() < p else None for v, p in CHOICES.values()], src, src * 1000 + i)
        for src in range(sources)
        for i in range(rows)
    ]
    schema = ", ".join(f"`{c}` string" for c in CHOICES) + ", _src_id bigint, _row_id bigint"
    ledger = spark.createDataFrame(lines, schema).repartition(3)
    numbers = {c: F.col(c).try_cast("decimal(18,2)") for c in (C.DONE_QTY, C.DONE_AMOUNT)}
    return ledger.withColumns(numbers) if typed else ledger


@pytest.mark.parametrize("seed,typed,months", [(1, True, None), (2, False, MonthRange("2026-02", None))])
def test_runs_hold_what_the_steps_give_row_by_row(spark, monkeypatch, seed, typed, months):
    monkeypatch.setattr(runs, "BLOCK_ROWS", 7)
    monkeypatch.setattr(runs, "RUN_ROWS", 3)
    rules, ledger = RuleSet.named("gb"), _ledger(spark, seed, typed)
    plain = facts.prepare_routed(route(normalize(ledger, months, block_rows=7)), rules)
    run = ledger_run.run(ledger, rules, months)
    assert sorted(run.routed.columns) == sorted(plain.columns)
    found, expected = (
        sorted(df.select(F.to_json(F.struct(*sorted(plain.columns))).alias("j")).collect()) for df in (run.routed, plain)
    )
    assert found == expected and len(found) > 20


def test_identity_is_staged_once_a_run(spark, monkeypatch):
    staged, stage = {}, ledger_run.stage

    def kept(df, name, **kw):
        staged[name] = stage(df, name, **kw)
        return staged[name]

    monkeypatch.setattr(ledger_run, "stage", kept)
    blank = {c: None for c in CHOICES}
    head = blank | {C.PERIOD: "2026年1期", C.PRODUCT_CODE: "P", C.PRODUCT_NAME: "N", C.ORDER_NO: "W", C.ORDER_LINE: "1"}
    rows = [head] + [blank | {C.COST_ITEM: "直接人工", C.DONE_AMOUNT: "1"}] * 3
    rows = [(*r.values(), 1, i) for i, r in enumerate([*rows, *rows])]
    schema = ", ".join(f"`{c}` string" for c in CHOICES) + ", _src_id bigint, _row_id bigint"
    run = ledger_run.run(spark.createDataFrame(rows, schema), RuleSet.named("gb"))
    assert staged["routed"].count() == 2
    assert [tuple(r) for r in run.routed.groupBy(facts.KEY).count().collect()] == [("2026年01期|P|W|1", 8)]


def test_month_filter_upon_the_whole_run_is_the_filtered_run(spark, monkeypatch):
    rules, ledger, months = RuleSet.named("gb"), _ledger(spark, 3, True), MonthRange("2026-02", None)
    whole, alone = ledger_run.run(ledger, rules), ledger_run.run(ledger, rules, months)
    monkeypatch.setattr(ledger_run, "run", None)
    monkeypatch.setattr(runs, "pack", None)
    some = whole.within(months)
    keyed = [sorted(map(repr, r.routed.select("_row_id", facts.KEY, C.MONTH, facts.BUCKET).collect())) for r in (some, alone)]
    assert keyed[0] == keyed[1] and 0 < len(keyed[0]) < whole.routed.count()
    assert some.counts.collect() == alone.counts.collect()
    assert "_run" not in some.routed.columns and some.reader_rows is whole.reader_rows
