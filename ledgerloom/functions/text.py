"""Column expressions for ledger text: trimming, blanks, periods and key values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All characters with the Unicode White_Space property. Spark's plain trim only
# knows the ASCII space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
_PLAIN_NUMBER = "0." + "#" * 30
_NUMERIC = (T.DecimalType, T.IntegralType, T.FractionalType)


def clean(c: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """NULL or nothing but whitespace; never NULL itself."""
    # trimming one side is enough, and stops at the first character that is no whitespace
    return c.isNull() | (F.ltrim(c, F.lit(WHITESPACE)) == "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(clean(c), F.lit(""))


def plain_number(c: Column) -> Column:
    """A number as text without exponent or trailing zeros (10.50 -> ``10.5``)."""
    return F.call_function("format_number", c, F.lit(_PLAIN_NUMBER))


def cell_text(df: DataFrame, name: str) -> Column:
    """Column ``name`` as text: blanks are '', numbers lose trailing zeros, text stays as is."""
    if name not in df.columns:
        return F.lit("")
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        c = c.cast("string")
    elif isinstance(kind, _NUMERIC):
        c = plain_number(c)
    elif not isinstance(kind, T.StringType):
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def whole_number(t: Column) -> Column:
    """``123.0`` as ``123``; any other text as it is."""
    whole = F.substring(t, F.lit(1), F.length(t) - 2)
    return F.when(t.endswith(".0") & whole.rlike("^[0-9]+$"), whole).otherwise(t)


def key_value(text: Column) -> Column:
    """One part of a composite key: trimmed, and ``123.0`` becomes ``123``."""
    return whole_number(clean(text))


def period_key(text: Column) -> Column:
    """``YYYY-MM`` from the digits of a period text, NULL when there is no valid month."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    month = F.substring(digits, 5, 2).try_cast("int")
    return F.when(
        (F.length(digits) >= 5) & month.between(1, 12),
        F.concat(F.substring(digits, 1, 4), F.lit("-"), F.lpad(month.cast("string"), 2, "0")),
    )
