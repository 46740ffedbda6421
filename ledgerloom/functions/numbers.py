"""Decimal policy and column expressions for exact ledger arithmetic.

Money is DECIMAL(28,10), quantities are DECIMAL(18,6). Their quotient is then
DECIMAL(38,14), so a unit cost keeps 14 decimals without leaving decimal space.
Text that is no number becomes NULL and counts as missing. What a decimal can't hold of a number of up to 28 digits
before and 28 behind the point is kept beside it as a rest of two decimals, whole and part; sums and comparisons of
the few rows that have one are exact as well. Only numbers beyond that are out of range or rounded, which
the issue log reports with their text.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import clean

MONEY = "decimal(28,10)"
QUANTITY = "decimal(18,6)"


def as_decimal(df: DataFrame, name: str, kind: str = MONEY) -> Column:
    """Column ``name`` as an exact decimal; text is trimmed and parsed, failures are NULL."""
    c = F.col(f"`{name}`")
    source = df.schema[name].dataType
    if isinstance(source, T.StringType):
        return clean(c).try_cast(kind)
    if isinstance(source, T.NumericType):
        return c.try_cast(kind)
    # dates and other kinds carry no amount
    return F.lit(None).cast(kind)


TOO_WIDE, ROUNDED = "out_of_range", "rounded"
# Numbers have up to 28 digits before and 28 behind the point; what their decimal can't hold of them is the rest.
LIMIT = 28
# parts of a number and sums of them
PART = f"decimal(36,{LIMIT})"


def _always_fits(kind: T.DataType, target: str) -> bool:
    """Whether a decimal of type ``target`` holds every number of a column type."""
    held = T._parse_datatype_string(target)
    digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}.get(type(kind))
    if digits is None and not isinstance(kind, T.DecimalType):
        return False
    whole, scale = (digits, 0) if digits else (kind.precision - kind.scale, kind.scale)
    return whole <= held.precision - held.scale and scale <= held.scale


def always_held(df: DataFrame, name: str, kind: str) -> bool:
    """Whether column ``name`` needs no more than a cast: there is no text to read, and never a rest or a misfit."""
    source = df.schema[name].dataType
    return not isinstance(source, (T.StringType, T.NumericType)) or _always_fits(source, kind)


def with_number(df: DataFrame, name: str, kind: str, out: str, rest: str, misfit: str) -> DataFrame:
    """Add column ``name`` as an exact number: a decimal and, for the few that it can't hold, the rest.

    ``out`` is of type ``kind``, rounded where the cell has further decimals and zero where it is too large. The
    number is ``out`` + ``rest.whole`` + ``rest.part``; ``rest`` is NULL where nothing is missing, and
    is not added at all where the column's type rules it out. ``misfit`` says ``out_of_range`` beyond LIMIT digits before the point,
    when ``out`` is NULL, and ``rounded`` beyond LIMIT digits behind it.
    """
    source = df.schema[name].dataType
    if always_held(df, name, kind):
        return df.withColumns({out: as_decimal(df, name, kind), misfit: F.lit(None).cast("string")})
    scale = T._parse_datatype_string(kind).scale
    cell = clean(F.col(f"`{name}`")) if isinstance(source, T.StringType) else F.col(f"`{name}`").cast("string")
    held = cell.try_cast(kind)
    # most numbers fit: they are short, and nothing else is asked of them
    point = F.instr(cell, ".")
    longer = (F.length(cell) > scale + 1) & (point > 0) & (F.length(cell) - point > scale)
    odd = (held.isNull() | longer | cell.rlike("[eE]")) & cell.rlike("[0-9]")
    found = F.when(odd, _bound(cell, lambda c: _bound(_spelled(c), lambda s: _apart(s, kind))))
    return df.withColumn("_found", found).select(
        *df.columns,
        F.when(F.col("_found").isNull(), held).otherwise(F.col("_found.out")).alias(out),
        F.col("_found.rest").alias(rest),
        F.col("_found.misfit").alias(misfit),
    )


def _bound(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _spelled(cell: Column) -> Column:
    """A number without exponent, as far as the widest decimals hold it."""
    written = F.coalesce(*[cell.try_cast(kind).cast("string") for kind in ("decimal(38,18)", "decimal(38,0)")])
    return F.when(cell.rlike("[eE]"), F.coalesce(written, cell)).otherwise(cell)


def _apart(cell: Column, kind: str) -> Column:
    """``out``, ``rest`` and ``misfit`` of a number that ``kind`` may not hold."""
    before, behind = F.substring_index(cell, ".", 1), F.substring_index(cell, ".", -1)
    digits = F.when(before.isin("", "-", "+"), "0").otherwise(before)
    sign = F.when(F.startswith(cell, F.lit("-")), "-0.").otherwise("0.")
    has_point = F.instr(cell, ".") > 0
    # decimals print small numbers with an exponent; these have no more digits than that type
    small = F.when(cell.rlike("[eE]"), cell.try_cast("decimal(38,18)"))
    whole = F.coalesce(F.floor(small).cast("decimal(38,0)"), digits.try_cast("decimal(38,0)"))
    part = F.when(has_point, F.concat(sign, behind, F.lit("0"))).otherwise("0").try_cast(PART)
    values = F.struct(
        whole.alias("whole"),
        F.coalesce((small - F.floor(small)).cast(PART), part).alias("part"),
        F.coalesce(cell.try_cast(kind), F.lit(0).cast(kind)).alias("held"),
        F.coalesce(cell.try_cast("double"), F.lit(float("nan"))).alias("near"),
        (has_point & small.isNull() & (F.length(F.rtrim(behind, F.lit("0"))) > LIMIT)).alias("longer"),
    )

    def told(v: Column) -> Column:
        floor = F.floor(v["held"])
        whole = (v["whole"] - floor.cast("decimal(38,0)")).cast("decimal(38,0)")
        part = (v["part"] - (v["held"] - floor).cast(PART)).cast(PART)
        fits = v["part"].isNotNull() & F.coalesce(F.abs(v["whole"]) < F.lit(Decimal(10) ** LIMIT), F.lit(False))
        is_number = ~F.isnan(v["near"]) & (F.abs(v["near"]) < float("inf"))
        return F.struct(
            F.when(fits, v["held"]).alias("out"),
            F.when(fits & ~((whole == 0) & (part == 0)), F.struct(whole.alias("whole"), part.alias("part"))).alias("rest"),
            F.when(~fits & is_number, TOO_WIDE).when(fits & v["longer"], ROUNDED).alias("misfit"),
        )

    return _bound(values, told)


def difference(left: list[str], right: list[str], rests: list[tuple[str, int]]) -> tuple[str, str]:
    """Whole and fractional part (0 <= part < 1) of the difference of two sums, as SQL.

    ``left`` and ``right`` are MONEY columns, ``rests`` their rests with the sign they count with.
    """
    main = " + ".join([f"CAST({c} AS decimal(30,10))" for c in left] + [f"CAST(-{c} AS decimal(30,10))" for c in right])
    whole, part = f"CAST(floor({main}) AS decimal(38,0))", f"CAST({main} - floor({main}) AS {PART})"
    for rest, sign in rests:
        own = "-" if sign < 0 else ""
        whole = f"({whole} + {own}coalesce({rest}.whole, 0))"
        # back to the type each time: a wider one would lose decimals
        part = f"CAST({part} + CAST({own}coalesce({rest}.part, 0) AS {PART}) AS {PART})"
    return f"({whole} + CAST(floor({part}) AS decimal(38,0)))", f"({part} - CAST(floor({part}) AS decimal(8,0)))"


def is_zero(parts: tuple[str, str]) -> str:
    return f"({parts[0]} = 0 AND {parts[1]} = 0)"


def is_positive(value: str, rest: str) -> str:
    """Whether a number with a rest is above zero."""
    whole, part = difference([value], [], [(rest, 1)])
    return f"({whole} > 0 OR {whole} = 0 AND {part} > 0)"
