"""Work-order facts: keys, cost buckets, reconciliation, duplicates and unit costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.functions.numbers import (
    MONEY,
    PART,
    QUANTITY,
    TOO_WIDE,
    always_held,
    difference,
    is_positive,
    is_zero,
    with_number,
)
from ledgerloom.functions.text import cell_text, clean, key_value, whole_number
from ledgerloom.operators import joins
from ledgerloom.operators.normalize import require
from ledgerloom.operators.split import DETAIL, QTY, ROUTE
from ledgerloom.rules import RuleSet
from ledgerloom.session import stage
from ledgerloom.sources.rows import ROW_ID

KEY = "work_order_key"
BUCKET = "bucket"
AMOUNT = "amount"
DONE = "done_qty"
TOTAL = "done_total"
VALIDITY = "validity"
VALID, BAD_QTY, NO_TOTAL, OUT_OF_RANGE = "valid", "invalid_qty", "missing_total", TOO_WIDE
# numbers beyond all bounds, and what the decimals could not hold of the others: of the amount and of the quantity
AMOUNT_MISFIT, QTY_MISFIT = "amount_misfit", "qty_misfit"
AMOUNT_REST, QTY_REST = "amount_rest", "qty_rest"
BASE_BUCKETS = tuple(C.BUCKET_LABELS)
COMPONENTS = tuple(C.OVERHEAD_ITEMS)


# ------------------------------------------------------------------ keys and classification
def work_order_key(df: DataFrame, parts: tuple[str, ...] | None = None) -> Column:
    """``month|product|order|line`` of normalized parts; the period stands in for the month."""
    if parts is None:
        first = C.MONTH if C.MONTH in df.columns else C.PERIOD
        parts = (first, C.PRODUCT_CODE, C.ORDER_NO, C.ORDER_LINE)
    return F.concat_ws("|", *[key_value(cell_text(df, p)) for p in parts])


def cost_bucket(item: Column, standalone: dict[str, str], trimmed: bool = False) -> Column:
    """Bucket of a cost item, NULL when it is not mapped.

    Overhead items without a known component get the bucket ``moh``.
    """
    item = item if trimmed else clean(item)
    bucket = F.when(item == C.DIRECT_MATERIAL, "dm").when(item == C.DIRECT_LABOR, "dl")
    for name, label in C.OVERHEAD_ITEMS.items():
        bucket = bucket.when(item == label, name)
    bucket = bucket.when(item.startswith(C.OVERHEAD_PREFIX), "moh")
    for name, label in standalone.items():
        bucket = bucket.when(item == label.strip(), name)
    return bucket


def _counted(standalone: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """Buckets whose amounts count in each sum."""
    return {b: (b,) for b in (*BASE_BUCKETS, *standalone)} | {"moh": ("moh", *COMPONENTS)}


def bucket_sums(standalone: dict[str, str], bucket: str = BUCKET, amount: str = AMOUNT) -> list[Column]:
    """One exact sum per bucket; a component counts in the overhead total as well.

    A bucket without any amount is zero. Sums return to MONEY so that later arithmetic keeps its
    scale; a sum that does not fit is NULL, never zero.
    """
    counted = _counted(standalone)
    # one bit of each bucket that has amounts: only a sum that does not fit is NULL. Rows add to their own sums alone
    bits = " ".join(f"WHEN {b!r} THEN {1 << i}" for i, b in enumerate(counted))
    seen = f"coalesce(bit_or(CASE WHEN {amount} IS NOT NULL THEN CASE {bucket} {bits} END END), 0)"
    found = []
    for name, buckets in counted.items():
        own = sum(1 << i for i, b in enumerate(counted) if b in buckets)
        total = f"try_sum(CASE WHEN {bucket} IN ({', '.join(repr(b) for b in buckets)}) THEN {amount} END)"
        found.append(F.expr(f"CASE WHEN {seen} & {own} = 0 THEN CAST(0 AS {MONEY}) ELSE try_cast({total} AS {MONEY}) END AS {name}"))
    return found


# ------------------------------------------------------------------ prepared rows
def with_key(df: DataFrame) -> DataFrame:
    """Add the key. The parts are trimmed in a step of their own, once per row."""
    first = C.MONTH if C.MONTH in df.columns else C.PERIOD
    parts = [p for p in (first, C.PRODUCT_CODE, C.ORDER_NO, C.ORDER_LINE)]
    trimmed = df.withColumns({f"_part{i}": clean(cell_text(df, p)) for i, p in enumerate(parts)})
    names = [f"_part{i}" for i in range(len(parts))]
    return trimmed.withColumn(KEY, F.concat_ws("|", *[whole_number(F.col(n)) for n in names])).drop(*names)


def with_bucket(df: DataFrame, rules: RuleSet, rows: Column | None = None) -> DataFrame:
    """Add the cost bucket of the rows chosen, with the item trimmed once per row."""
    bucket = cost_bucket(F.col("_item"), rules.standalone_buckets(), trimmed=True)
    tagged = df.withColumn("_item", clean(cell_text(df, C.COST_ITEM)))
    return tagged.withColumn(BUCKET, bucket if rows is None else F.when(rows, bucket)).drop("_item")


def prepare_detail(detail: DataFrame, rules: RuleSet) -> DataFrame:
    """Detail rows with key, bucket and amount; an amount that is no number is NULL."""
    require(detail, C.REQUIRED_DETAIL, C.DETAIL_DATASET)
    return _with_amount(with_bucket(with_key(detail), rules))


def prepare_qty(qty: DataFrame) -> DataFrame:
    """Quantity rows with key, decimals and the outcome of the validity test.

    The quantity is tested first: a bad quantity with a missing total counts once.
    """
    require(qty, C.REQUIRED_QTY, C.QTY_DATASET)
    rows = with_numbers(with_key(qty))
    return rows.withColumn(VALIDITY, validity(rows))


def _with_amount(rows: DataFrame) -> DataFrame:
    return with_number(rows, C.DONE_AMOUNT, MONEY, AMOUNT, AMOUNT_REST, AMOUNT_MISFIT)


def with_numbers(rows: DataFrame) -> DataFrame:
    """Amount and quantity as exact numbers, with their rests and misfits."""
    return _with_quantity(_with_amount(rows))


def _with_quantity(rows: DataFrame) -> DataFrame:
    return with_number(rows, C.DONE_QTY, QUANTITY, DONE, QTY_REST, QTY_MISFIT)


def positive(rows: DataFrame, value: str = DONE, rest: str = QTY_REST) -> Column:
    """Whether a number is above zero, with its rest."""
    plain = F.coalesce(F.col(value) > 0, F.lit(False))
    if rest not in rows.columns:
        return plain
    return F.when(F.col(rest).isNull(), plain).otherwise(F.expr(is_positive(value, rest)))


def validity(rows: DataFrame) -> Column:
    """A number beyond all bounds is out of range: neither invalid nor missing."""
    wide = [F.col(c).eqNullSafe(TOO_WIDE) for c in (QTY_MISFIT, AMOUNT_MISFIT)]
    return (
        F.when(wide[0], OUT_OF_RANGE)
        .when(~positive(rows), BAD_QTY)
        .when(wide[1], OUT_OF_RANGE)
        .when(F.col(AMOUNT).isNull(), NO_TOTAL)
        .otherwise(VALID)
    )


def valid_qty(prepared: DataFrame) -> DataFrame:
    """Rows that passed, with their completed total."""
    return prepared.where(F.col(VALIDITY) == VALID).withColumn(TOTAL, F.col(AMOUNT))


# ------------------------------------------------------------------ aggregation and join
def bucket_amounts(prepared_detail: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per key with all bucket sums; unmapped rows take no part."""
    mapped = prepared_detail.where(F.col(BUCKET).isNotNull())
    return _with_rests(mapped.groupBy(KEY).agg(*bucket_sums(rules.standalone_buckets())), prepared_detail, rules)


def _with_rests(sums: DataFrame, prepared: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``rest_<bucket>`` to the sums of a key: what the rests of its amounts add to them.

    Only rows with a rest are read for it, so the table to join is small or empty.
    """
    if AMOUNT_REST not in prepared.columns:
        return sums
    counted = _counted(rules.standalone_buckets())
    rests = []
    for name, buckets in counted.items():
        mine = f"{BUCKET} IN ({', '.join(repr(b) for b in buckets)})"
        fields = [
            f"'{field}', try_cast(try_sum(CASE WHEN {mine} THEN {AMOUNT_REST}.{field} END) AS {kind})"
            for field, kind in (("whole", "decimal(38,0)"), ("part", PART))
        ]
        rests.append(F.expr(f"named_struct({', '.join(fields)}) AS rest_{name}"))
    odd = prepared.where(F.col(AMOUNT_REST).isNotNull() & F.col(BUCKET).isNotNull())
    return sums.join(odd.groupBy(KEY).agg(*rests), KEY, "left")


def key_counts(valid: DataFrame) -> DataFrame:
    """Rows per key and the first row of each key, by a combining aggregate."""
    return valid.groupBy(KEY).agg(F.count(F.lit(1)).alias("key_rows"), F.min(ROW_ID).alias("first_row"))


def prepare_routed(routed: DataFrame, rules: RuleSet) -> DataFrame:
    """A routed ledger with what :func:`prepare_detail` and :func:`prepare_qty` add, in one pass."""
    for which, needed in ((C.DETAIL_DATASET, C.REQUIRED_DETAIL), (C.QTY_DATASET, C.REQUIRED_QTY)):
        require(routed, needed, which)
    rows = with_numbers(with_bucket(with_key(routed), rules, F.col(ROUTE) == DETAIL))
    return rows.withColumn(VALIDITY, F.when(F.col(ROUTE) == QTY, validity(rows)))


def plain_numbers(df: DataFrame) -> dict[str, tuple[str, str, str]]:
    """Numbers of a prepared ledger that are casts of a typed column: name -> (source, type, misfit)."""
    numbers = {AMOUNT: (C.DONE_AMOUNT, MONEY, AMOUNT_MISFIT), DONE: (C.DONE_QTY, QUANTITY, QTY_MISFIT)}
    return {out: n for out, n in numbers.items() if always_held(df, n[0], n[1])}


def without_plain_numbers(prepared: DataFrame) -> DataFrame:
    """A prepared ledger as it is staged: numbers that a cast makes again are not written a second time."""
    return prepared.drop(*[c for out, (_, _, misfit) in plain_numbers(prepared).items() for c in (out, misfit)])


def with_plain_numbers(staged: DataFrame) -> DataFrame:
    """The ledger that :func:`without_plain_numbers` made narrower."""
    rows = staged
    for out, (source, kind, misfit) in plain_numbers(staged).items():
        rows = with_number(rows, source, kind, out, "", misfit)
    return rows


def work_order_summary(prepared: DataFrame, rules: RuleSet) -> DataFrame:
    """Bucket sums, row count and first row of every key in a single aggregate.

    Detail and quantity rows share the key, so one shuffle of partial sums serves both.
    """
    is_valid = F.col(VALIDITY) == VALID
    sums = prepared.groupBy(KEY).agg(
        *bucket_sums(rules.standalone_buckets()),
        F.count(BUCKET).alias("detail_rows"),
        F.count_if(is_valid).alias("key_rows"),
        F.min(F.when(is_valid, F.col(ROW_ID))).alias("first_row"),
    )
    return _with_rests(sums, prepared, rules)


def join_facts(
    valid: DataFrame, summary: DataFrame, rules: RuleSet, rows_per_salt: int = joins.ROWS_PER_SALT
) -> DataFrame:
    """Valid quantity rows LEFT JOIN their key's summary.

    Amounts of a key without summary are zero; sums that did not fit stay NULL. Duplicates keep their
    amounts. ``is_first`` marks the first row of each key.
    """
    # the summary counts these same rows, but is made of all detail rows
    hot = stage(joins.hot_keys(valid.select(KEY), [KEY], rows_per_salt), "hot_keys")
    joined = joins.lookup_join(valid, summary, [KEY], hot, ROW_ID)
    buckets = (*BASE_BUCKETS, *rules.standalone_buckets())
    kept = [f"`{c}`" for c in joined.columns if c not in (*buckets, "first_row", "detail_rows")]
    # a summary without detail_rows may lack the sums of a key altogether
    absent = "key_rows IS NULL" if "detail_rows" in joined.columns else f"coalesce({', '.join(buckets)}) IS NULL"
    zeroed = [f"CASE WHEN {absent} THEN CAST(0 AS {MONEY}) ELSE {b} END AS {b}" for b in buckets]
    return joined.selectExpr(*kept, *zeroed, f"{ROW_ID} = first_row AS is_first")


# ------------------------------------------------------------------ checks and unit costs
def with_checks(facts: DataFrame, rules: RuleSet) -> DataFrame:
    """Exact reconciliation of components and total, with reason text and status."""
    def added(names) -> str:
        total = names[0]
        for name in names[1:]:
            total = f"try_add({total}, {name})"
        return f"try_cast({total} AS {MONEY})"

    derived = ("dm", "dl", "moh", *rules.standalone_buckets())
    sums = facts.selectExpr(
        "*", f"{added(COMPONENTS)} AS moh_components", f"{added(derived)} AS derived_total"
    )

    def matches(added_up: str, names, other: str, other_rest: str) -> str:
        """Exact equality of a sum of buckets and another column; a sum that does not fit matches nothing."""
        plain = f"{added_up} = {other}"
        rests = [(f"rest_{n}", 1) for n in names] + [(other_rest, -1)]
        rests = [(c, sign) for c, sign in rests if c in facts.columns]
        if not rests:
            return f"coalesce({plain}, false)"
        odd = f"coalesce({', '.join(f'{c}.whole' for c, _ in rests)}) IS NOT NULL"
        return f"coalesce(CASE WHEN {odd} THEN {is_zero(difference([added_up], [other], rests))} ELSE {plain} END, false)"

    checked = sums.selectExpr(
        "*",
        f"{matches('moh_components', COMPONENTS, 'moh', 'rest_moh')} AS moh_matches",
        f"{matches('derived_total', derived, TOTAL, AMOUNT_REST)} AS total_matches",
    )
    reason = F.concat_ws(
        ";",
        F.when(~F.col("moh_matches"), C.MOH_CHECK_REASON),
        F.when(~F.col("total_matches"), rules.total_expression + C.TOTAL_CHECK_SUFFIX),
    )
    status = F.when(F.col("moh_matches") & F.col("total_matches"), C.PASSED).otherwise(C.NEEDS_REVIEW)
    return checked.withColumns({"check_reason": reason, "check_status": status})


def with_unit_costs(facts: DataFrame, rules: RuleSet) -> DataFrame:
    """``unit_<metric>`` for the total, the eight buckets and the standalone items.

    NULL on a zero divisor or when the quotient does not fit. Where a number has a rest, the
    quotient is that of doubles.
    """
    sources = {"total": TOTAL, **{b: b for b in (*BASE_BUCKETS, *rules.standalone_buckets())}}
    rests = {"total": AMOUNT_REST} | {b: f"rest_{b}" for b in sources}

    def near(value: str, rest: str) -> str:
        if rest not in facts.columns:
            return f"CAST({value} AS double)"
        return f"(CAST({value} AS double) + coalesce(CAST({rest}.whole AS double) + CAST({rest}.part AS double), 0D))"

    def unit(metric: str, value: str) -> str:
        odd = [f"{r}.whole IS NOT NULL" for r in (rests[metric], QTY_REST) if r in facts.columns]
        exact = f"try_divide({value}, {DONE})"
        if not odd:
            return exact
        quotient = f"try_cast(try_divide({near(value, rests[metric])}, {near(DONE, QTY_REST)}) AS decimal(38,14))"
        return f"CASE WHEN {' OR '.join(odd)} THEN {quotient} ELSE {exact} END"

    return facts.selectExpr("*", *[f"{unit(m, c)} AS unit_{m}" for m, c in sources.items()])


def build_facts(
    valid: DataFrame, summary: DataFrame, rules: RuleSet, rows_per_salt: int = joins.ROWS_PER_SALT
) -> DataFrame:
    """Quantity facts: amounts, duplicate count, checks and unit costs."""
    return with_unit_costs(with_checks(join_facts(valid, summary, rules, rows_per_salt), rules), rules)


def first_occurrences(facts: DataFrame) -> DataFrame:
    """The first row of each key: the work orders."""
    return facts.where("is_first")


# ------------------------------------------------------------------ output table
def quantity_table(facts: DataFrame, rules: RuleSet) -> DataFrame:
    """Quantity output: source columns, amounts, unit costs and checks under their labels."""
    items = rules.standalone_buckets()
    cols = [F.col(f"`{c}`") for c in C.QTY_LAYOUT if c in facts.columns]
    cols += [F.col(b).alias(f"本期完工{label}合计完工金额") for b, label in C.BUCKET_LABELS.items()]
    cols += [F.col(b).alias(f"本期完工{label}合计完工金额") for b, label in items.items()]
    cols += [F.col(f"unit_{b}").alias(label) for b, label in C.QTY_UNIT_COLUMNS.items()]
    cols += [
        F.col(f"unit_{b}").alias(C.STANDALONE_UNIT_COLUMNS.get(label.strip(), C.STANDALONE_UNIT_FALLBACK))
        for b, label in items.items()
    ]

    def yes_no(name: str) -> Column:
        return F.when(F.col(name), C.YES).otherwise(C.NO)

    cols += [
        yes_no("moh_matches").alias(C.MOH_MATCH_COLUMN),
        yes_no("total_matches").alias(rules.total_expression + C.TOTAL_MATCH_SUFFIX),
        F.col("check_status").alias(C.CHECK_STATUS_COLUMN),
        F.col("check_reason").alias(C.CHECK_REASON_COLUMN),
    ]
    return facts.select(*cols)
