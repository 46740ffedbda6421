"""The whole run: ledger in, three tables, issue log, quality metrics and run record out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.errors import InvalidInput
from ledgerloom.operators import anomaly, facts, issues, quality, runs
from ledgerloom.operators.normalize import canonical_names, in_months, normalize, project
from ledgerloom.operators.split import DETAIL, QTY, ROUTE, route
from ledgerloom.rules import MonthRange, RuleSet
from ledgerloom.session import stage
from ledgerloom.sinks import tables


@dataclass(frozen=True)
class CostRun:
    """Lazy outputs over two staged tables: the routed ledger and, once an output reads them, the quantity facts."""

    rules: RuleSet
    months: MonthRange | None
    ledger: DataFrame
    routed: DataFrame
    # the run without a month filter whose routed ledger this one filters
    whole: CostRun | None = None

    def within(self, months: MonthRange) -> CostRun:
        """The run of the same ledger under a month filter, which stands above the fill: nothing is filled or routed again."""
        if self.months:
            raise InvalidInput("the run has a month filter already")
        return CostRun(self.rules, months, self.ledger, in_months(self.routed, months), self)

    @cached_property
    def reader_rows(self) -> DataFrame:
        """Number of rows read, counted once: every count, metric and record of the run reads this one row."""
        if self.whole:
            return self.whole.reader_rows
        return stage(self.ledger.agg(F.count(F.lit(1)).alias("reader_rows")), "reader_rows")

    @cached_property
    def facts(self) -> DataFrame:
        """One row per valid quantity row, staged once. Unit costs are quotients of what is staged, made when read."""
        summary = facts.work_order_summary(self.prepared, self.rules)
        joined = facts.join_facts(facts.valid_qty(self.prepared), summary, self.rules)
        staged = stage(facts.with_checks(joined, self.rules), "facts", codec="zstd")
        return facts.with_unit_costs(staged, self.rules)

    @property
    def prepared(self) -> DataFrame:
        """Detail and quantity rows with key, bucket and decimals."""
        return self.routed.where(F.col(ROUTE).isin(QTY, DETAIL))

    @property
    def detail_table(self) -> DataFrame:
        return project(self.routed.where(F.col(ROUTE) == DETAIL), C.DETAIL_LAYOUT)

    @property
    def quantity_table(self) -> DataFrame:
        return facts.quantity_table(self.facts, self.rules)

    def scored(self) -> DataFrame:
        """Scored work orders."""
        return anomaly.score(anomaly.prepare(self.facts, self.rules))

    def analysis_table(self, ordered: bool = False) -> DataFrame:
        return anomaly.analysis_table(self.scored(), self.rules, ordered)

    @property
    def issues(self) -> DataFrame:
        return issues.issue_log(self.prepared, self.facts, self.rules)

    @property
    def counts(self) -> DataFrame:
        """One row with all counts of the run."""
        parts = (
            self.reader_rows,
            self.routed.agg(F.count(F.lit(1)).alias("ledger_rows")),
            quality.ledger_counts(self.prepared),
            quality.fact_counts(self.facts),
        )
        out = parts[0].withColumn("_k", F.lit(1))
        for part in parts[1:]:
            out = out.join(part.withColumn("_k", F.lit(1)), "_k")
        return out.drop("_k")

    @property
    def quality(self) -> DataFrame:
        return quality.quality_metrics(self.counts, months_filtered=bool(self.months))

    def record(self, inputs: DataFrame | None = None, outputs: dict[str, str] | None = None) -> DataFrame:
        span = (self.months.start, self.months.end) if self.months else (None, None)
        counts = issues.issue_counts(self.issues)
        return quality.run_record(self.rules.name, span, self.counts, self.quality, counts, inputs, outputs)

    def publish(self, target: str, fmt: str = "parquet", inputs: DataFrame | None = None) -> dict[str, str]:
        """Publish the tables, the issue log, the input list and, last of all, the run record.

        All targets are checked first and everything is written aside, then moved: a run is published
        as a whole or not at all, but for a failure between two renames, which a missing run record shows.
        """
        spark, target = self.routed.sparkSession, target.rstrip("/")
        names = [*C.OUTPUT_TABLES, tables.ISSUE_LOG, *([tables.INPUT_LIST] if inputs is not None else []), tables.RUN_RECORD]
        tables.check_free(spark, target, names)
        aside = f"{target}/_unpublished-{uuid.uuid4().hex}"
        tables.publish(
            {
                C.DETAIL_TABLE: tables.typed(self.detail_table),
                C.QTY_TABLE: tables.typed(self.quantity_table),
                C.ANALYSIS_TABLE: self.analysis_table(ordered=True),
            },
            aside,
            fmt,
        )
        outputs = {name: f"{target}/{name}" for name in C.OUTPUT_TABLES}
        tables.publish_log(self.issues.orderBy(*issues.ORDER).select(*issues.FIELDS), aside, tables.ISSUE_LOG)
        if inputs is not None:
            tables.publish_log(inputs, aside, tables.INPUT_LIST)
        tables.publish_log(self.record(inputs, outputs), aside, tables.RUN_RECORD)
        tables.promote(spark, aside, target, names)
        return outputs


def run(
    ledger: DataFrame, rules: RuleSet, months: MonthRange | None = None, blank_text: bool = True
) -> CostRun:
    """Plan a run. The routed ledger is staged; facts and the number of rows read when an output first needs them.

    The routed ledger holds keys, buckets and numbers read from text of every row, so they are computed
    once; decimals that are a cast of a typed column are made again when read. It is staged in runs of rows that share their identity by the
    fill, so identity, month and key are cleaned, filled and written once a run. Outputs of the routed ledger
    alone don't wait for the facts; ``ledger`` must stay readable until the rows read are counted. ``blank_text=False`` is for ledgers whose
    blank cells are NULL already, such as those of the text reader.
    """
    names = canonical_names(ledger).columns
    if C.PERIOD in names:
        packed = stage(runs.pack(ledger, rules, months, blank_text), "routed", codec="zstd", sorted_groups=True)
        return CostRun(rules, months, ledger, facts.with_plain_numbers(runs.unpack(packed)))
    # without a period the month may be a row's own
    routed = facts.prepare_routed(route(normalize(ledger, months, blank_text=blank_text)), rules)
    staged = stage(facts.without_plain_numbers(routed), "routed", partition_by=(ROUTE,), codec="zstd")
    return CostRun(rules, months, ledger, facts.with_plain_numbers(staged))
