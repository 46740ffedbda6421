"""Rule sets: product whitelist, standalone cost items, month range."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.errors import InvalidInput
from ledgerloom.functions.text import clean

PRODUCT_SCHEMA = "code string, name string, display_order int"
# A whitelist is configuration. Above this size it is joined without a broadcast.
MAX_BROADCAST_PRODUCTS = 10_000
# breaches in the order in which they are reported
PROBLEMS = (
    "blank_code", "untrimmed_code", "blank_name", "untrimmed_name", "duplicate_code", "duplicate_pair",
    "duplicate_display_order", "display_order_not_increasing",
)
_MONTH = re.compile(r"[0-9]{4}-(0[1-9]|1[0-2])", re.ASCII)


@dataclass(frozen=True)
class RuleSet:
    """Name, ordered ``(code, name, display_order)`` products and standalone cost items."""

    name: str
    standalone_items: tuple[str, ...]
    products: tuple[tuple[str, str, int], ...] = field(default=())

    @classmethod
    def named(cls, name: str) -> RuleSet:
        key = name.strip().lower()
        if key not in C.STANDALONE_ITEMS:
            raise InvalidInput(f"unknown rule set: {name!r}")
        return cls(key, C.STANDALONE_ITEMS[key], C.PRODUCTS[key])

    @property
    def total_expression(self) -> str:
        return "+".join((C.DIRECT_MATERIAL, C.DIRECT_LABOR, C.OVERHEAD_PREFIX, *self.standalone_items))

    def standalone_buckets(self) -> dict[str, str]:
        """bucket column -> configured item, in configured order."""
        return {f"standalone_{i}": item for i, item in enumerate(self.standalone_items)}

    def product_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.products), PRODUCT_SCHEMA)


@dataclass(frozen=True)
class MonthRange:
    """Inclusive ``YYYY-MM`` bounds; either may be absent."""

    start: str | None = None
    end: str | None = None

    def __post_init__(self):
        for label in ("start", "end"):
            value = getattr(self, label)
            if value is None:
                continue
            if not _MONTH.fullmatch(value.strip()):
                raise InvalidInput(f"month_{label} must be YYYY-MM, got {value!r}")
            object.__setattr__(self, label, value.strip())
        if self.start and self.end and self.start > self.end:
            raise InvalidInput(f"month_start={self.start} is later than month_end={self.end}")

    def __bool__(self) -> bool:
        return self.start is not None or self.end is not None


def product_problems(products: DataFrame, position: str | None = None) -> DataFrame:
    """Rows ``(problem, code, name, display_order)`` for every breach of the product rules.

    Codes and names must be trimmed and non-blank, codes, pairs and display orders
    unique, and ``display_order`` must rise strictly along the dense ``position``.
    """
    fields = ["code", "name", "display_order"]
    checks = []
    for column in ("code", "name"):
        c = F.col(column)
        blank = c.isNull() | (clean(c) == "")
        checks += [(f"blank_{column}", blank), (f"untrimmed_{column}", ~blank & (c != clean(c)))]
    marked = products.select(
        *fields, F.explode(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks])).alias("problem")
    ).where("problem is not null")
    found = [marked.select("problem", *fields)]
    for problem, keys in (
        ("duplicate_code", ["code"]),
        ("duplicate_pair", ["code", "name"]),
        ("duplicate_display_order", ["display_order"]),
    ):
        repeated = products.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found.append(products.join(repeated, keys, "left_semi").select(F.lit(problem).alias("problem"), *fields))
    if position is not None:
        # an equi-join with the row one position up needs no global window
        previous = products.select(
            (F.col(position) + 1).alias(position), F.col("display_order").alias("previous")
        )
        found.append(
            products.join(previous, position)
            .where("previous >= display_order")
            .select(F.lit("display_order_not_increasing").alias("problem"), *fields)
        )
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def validate(spark: SparkSession, rules: RuleSet) -> RuleSet:
    """Raise InvalidInput when a rule set breaks the configuration rules."""
    expected = C.STANDALONE_ITEMS.get(rules.name)
    if expected is not None and tuple(rules.standalone_items) != expected:
        raise InvalidInput(f"standalone items of {rules.name} must be {expected}")
    if not rules.products:
        raise InvalidInput("product list must not be empty")
    table = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(rules.products)], "position int, " + PRODUCT_SCHEMA
    )
    rank = F.array_position(F.array(*[F.lit(p) for p in PROBLEMS]), F.col("problem"))
    problem = product_problems(table, "position").orderBy(rank, "display_order").first()
    if problem is not None:
        raise InvalidInput(f"product list: {problem['problem']} at {problem['code']!r}")
    return rules


def fingerprint(products: DataFrame, name: str, standalone_items: tuple[str, ...]) -> DataFrame:
    """One row ``(rule_set, fingerprint)``: SHA-256 over the effective rules in display order."""
    ordered = F.array_sort(F.collect_list(F.struct("display_order", "code", "name")))
    canonical = F.to_json(
        F.struct(
            F.lit(name).alias("name"),
            ordered.alias("products"),
            F.array(*[F.lit(i) for i in standalone_items]).alias("standalone_items"),
        )
    )
    return products.agg(F.sha2(canonical, 256).alias("fingerprint")).select(
        F.lit(name).alias("rule_set"), "fingerprint"
    )
