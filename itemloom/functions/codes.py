"""Codes: taxpayer ids, barcodes, goods classes and list entries."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from .text import strip


_COUNT = "decimal(30,0)"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def digits_only(c: Column) -> Column:
    """The digits of a text, NULL when there are none."""
    digits = _digits(c)
    return F.when(digits != "", digits)


def valid_gtin(c: Column) -> Column:
    """The digits of a barcode whose length and check digit are right, else NULL.

    Padded to 14 digits, odd positions weigh 3 and even ones 1; with the check
    digit itself the weighted sum is a multiple of ten.
    """
    digits = _digits(c)
    # As a number, zeros in front count for nothing; more digits than it takes are no barcode.
    number = digits.try_cast("bigint")
    weighted = [F.call_function("div", number, F.lit(10**k)) % 10 * F.lit(3 if k % 2 else 1) for k in range(14)]
    # One comparison instead of an AND, whose second operand Spark would not
    # share: this way the digits are worked out once per row.
    wanted = F.when(F.length(digits).isin(8, 12, 13, 14), F.lit(0)).otherwise(F.lit(-1))
    return F.when(reduce(add, weighted) % 10 == wanted, digits)


def _exact_length(c: Column, length: int) -> Column:
    digits = _digits(c)
    return F.when(F.length(digits) == length, digits)


def valid_ncm(c: Column) -> Column:
    return _exact_length(c, 8)


def valid_cest(c: Column) -> Column:
    return _exact_length(c, 7)


def numeric_sort_value(c: Column) -> Column:
    """The digits of a code as a number; codes without digits sort last."""
    return F.coalesce(digits_only(c).cast("double"), F.lit(float("inf")))


def code_entry(code: Column, count: Column) -> Column:
    """``[code; n]``."""
    return F.concat(F.lit("["), code, F.lit("; "), count.cast("string"), F.lit("]"))


def split_code(code: Column, number: Column) -> Column:
    """``code_separado_NN``; numbers above 99 keep all their digits."""
    return F.format_string("%s_separado_%02d", code, number)


def parse_code_entry(entry: Column) -> Column:
    """``[code; n]`` as ``struct(codigo, n)``; any other text counts once.

    Counts are decimals of 30 digits; a longer one counts as the largest of them.
    """
    pattern = r"^\[(.*?);\s*(\d+)\]"
    matched = entry.rlike(pattern)
    count = F.coalesce(F.regexp_extract(entry, pattern, 2).try_cast(_COUNT), F.lit("9" * 30).cast(_COUNT))
    return F.struct(
        F.when(matched, strip(F.regexp_extract(entry, pattern, 1))).otherwise(entry).alias("codigo"),
        F.when(matched, count).otherwise(F.lit(1).cast(_COUNT)).alias("n"),
    )


def taxpayer_id(c: Column, strict: bool = False) -> Column:
    """Digits of a taxpayer id. NULL when there are none, or, if strict, when
    there are not exactly 14."""
    return _exact_length(c, 14) if strict else digits_only(c)


def required_taxpayer_id(value: str | None) -> str:
    """The digits of a taxpayer id that a job is asked for; without any, the job has nobody to work for."""
    digits = "".join(re.findall("[0-9]", value or ""))
    if not digits:
        raise ValueError(f"{value!r} is no taxpayer id: it has no digits")
    return digits
