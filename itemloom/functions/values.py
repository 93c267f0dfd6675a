"""Lenient casts, dates and display text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

EXACT = "decimal(28,10)"
#: What a sum keeps of a number beyond :data:`EXACT`: ten fraction digits, then fifteen more.
_FINE, _FINE_UNITS = "decimal(38,10)", 1e15
#: Numbers with two fraction digits are summed in hundredths below this, so that no count of rows overflows.
_MOST_HUNDREDTHS = 1e9
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+|inf|infinity)([eE][+-]?\d+)?\s*$"


def try_number(c: Column, data_type: T.DataType) -> Column:
    """A number, NULL where the value is missing or not a number."""
    if isinstance(data_type, T.StringType):
        # Spark would also read Java literals such as '1d'.
        c = F.when(c.rlike("(?i)" + _NUMBER), F.trim(c))
    return c.try_cast("double")


def lenient_double(c: Column, data_type: T.DataType) -> Column:
    """A number, 0 where it is missing or not a number."""
    return F.coalesce(F.nanvl(try_number(c, data_type), F.lit(0.0)), F.lit(0.0))


def lenient_timestamp(c: Column) -> Column:
    """A wall-clock timestamp, NULL where it cannot be read."""
    return c.try_cast("timestamp_ntz")


def br_date(c: Column) -> Column:
    """``DD/MM/YYYY`` as a date."""
    return F.try_to_date(c, "dd/MM/yyyy")


def compact_date(c: Column) -> Column:
    """``DDMMYYYY`` as a date, NULL unless it is eight digits."""
    return F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "ddMMyyyy"))


def wall_micros(c: Column) -> Column:
    """A wall-clock timestamp as microseconds, whatever the session time zone."""
    seconds = F.unix_date(F.to_date(c)).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), c) * 1000000).cast("bigint")


def exact_part(c: Column) -> Column:
    """What of a number can be summed exactly: its first ten fraction digits."""
    return c.try_cast(EXACT)


def inexact_part(c: Column, exact: Column | None = None) -> Column:
    """The rest: all of a number too large for :data:`EXACT`, and what lies beyond its ten digits.
    ``exact`` is a column that holds the exact part, so that it is not worked out again."""
    exact = exact_part(c) if exact is None else exact
    beyond = c - exact.cast("double")
    return F.when(exact.isNull(), c).when(beyond != 0, beyond)


def hundredths(c: Column) -> Column:
    """A double of at most two fraction digits as a whole number of hundredths; NULL for any other, or a large one.

    A decimal is made by way of the number's text; whole numbers are added up many times faster.
    """
    whole = F.rint(c * 100)
    return F.when((F.abs(whole) < _MOST_HUNDREDTHS) & (whole / 100 == c), whole.cast("bigint"))


def with_hundredths(exact: Column, whole: Column) -> Column:
    """A sum of exact parts and a sum of hundredths, each NULL if it has no numbers, as one decimal."""
    half = "decimal(37,10)"  # the sum of two is a decimal that keeps ten fraction digits
    added = whole.cast("decimal(19,0)") * F.lit(Decimal("0.01"))
    return (
        F.when(whole.isNull(), exact)
        .when(exact.isNull(), added.cast(_FINE))
        .otherwise((exact.cast(half) + added.cast(half)).cast(_FINE))
    )


def rest_sum(c: Column, fine: str | None = None) -> Column:
    """Sum of inexact parts. Small ones are added as decimals of their own, so
    only numbers too large for a decimal are added in the order they come.
    ``fine`` names a column that holds :func:`fine_part` of them, for numbers that most rows lack."""
    part = fine_part(c) if fine is None else F.col(fine)
    total = F.sum(part) if fine is None else present_sum(fine)
    small, large = total.cast("double") / _FINE_UNITS, F.sum(F.when(part.isNull(), c))
    return F.coalesce(small + large, small, large)


def present_sum(name: str) -> Column:
    """Sum of a column that most rows lack. A filter leaves their totals untouched: a decimal total
    is otherwise read and written anew for each row, missing number or not."""
    return F.expr(f"sum(`{name}`) filter (where `{name}` is not null)")


def fine_part(c: Column) -> Column:
    """What :func:`rest_sum` adds as decimals of their own: a number below one, in its smallest units."""
    return F.when(F.abs(c) < 1, c * _FINE_UNITS).try_cast(_FINE)


def exact_sum(c: Column) -> Column:
    """A sum of numbers below 1e18 that no order of addition can change, to 25
    fraction digits; larger numbers are added as doubles. NULL over no numbers."""
    exact, rest = F.sum(exact_part(c)).cast("double"), rest_sum(inexact_part(c))
    return F.coalesce(exact + rest, exact, rest)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def decimal_text(c: Column) -> Column:
    """A decimal with the digits that it has: no zeros at the end of a fraction,
    and no point after a whole number."""
    text = c.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def source_text(c: Column, data_type: T.DataType) -> Column:
    """Text of a source column for a text column of the item table."""
    return decimal_text(c) if isinstance(data_type, T.DecimalType) else plain_text(c, data_type)


def _double_text(c: Column) -> Column:
    """A double with all its digits; an exponent only from 1e16 and below 1e-4."""
    raw = c.cast("string")
    digits = F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    exponent = F.regexp_extract(raw, "E(-?[0-9]+)$", 1)
    power = F.replace(exponent, F.lit("-"), F.lit(""))
    scientific = F.concat(
        F.regexp_replace(F.regexp_extract(raw, "^([^E]*)E", 1), r"\.0$", ""),
        F.when(exponent.startswith("-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(power, F.greatest(F.length(power), F.lit(2)), "0"),
    )
    size = F.abs(c)
    return (
        F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain)
        .when(F.isnan(c), F.lit("nan"))
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .otherwise(scientific)
    )


def plain_text(c: Column, data_type: T.DataType) -> Column:
    """Text of a value, NULL where it is missing."""
    if isinstance(data_type, T.DoubleType):
        return _double_text(c)
    text = c.cast("string")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        # All six digits of a fraction, or none.
        return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
    return text


def list_text(c: Column, separator: str = ", ") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), separator)


def display_cell(c: Column, data_type: T.DataType) -> Column:
    """Text of a value as a report shows it; a missing value is empty."""
    if isinstance(data_type, T.ArrayType):
        element = data_type.elementType
        c = F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: display_cell(x, element)), ", ")
        data_type = T.StringType()
    return F.coalesce(plain_text(c, data_type), F.lit(""))
