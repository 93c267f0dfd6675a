"""Filter conditions, compiled to Spark columns.

A condition never fails on a value it cannot read: relational operators
compare leniently cast numbers, and fall back to text equality when the value
given is not a number. A date counts as its days, a timestamp as its
microseconds since 1970. Where a column holds numbers or dates, the value given
is turned into one of the column's type, so that the filter reaches the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from functools import reduce
from operator import and_, ge, gt, le, lt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import without_accents
from .values import list_text, plain_text, try_number, wall_micros

CONTAINS = "contém"
EQUALS = "igual"
STARTS = "começa com"
ENDS = "termina com"
IS_NULL = "é nulo"
NOT_NULL = "não é nulo"
_RELATIONAL = {">": gt, ">=": ge, "<": lt, "<=": le}

# The quick filter fields and the columns that may hold them.
QUICK_FIELDS = {
    "descricao_normalizada": ["descricao_normalizada"],
    "descricao": ["descricao"],
    "ncm_padrao": ["ncm_padrao", "NCM_padrao", "lista_ncm"],
    "cest_padrao": ["cest_padrao", "CEST_padrao", "lista_cest"],
}


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: str = ""


def _number(value: str) -> float | None:
    try:
        return float(value.replace(",", "."))
    except ValueError:
        return None


_INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_FIRST_DAY, _LAST_DAY = (date.min - date(1970, 1, 1)).days, (date.max - date(1970, 1, 1)).days


def _relation(raw: Column, data_type: T.DataType, operator: str, number: float) -> Column:
    """A comparison with a number, free of casts of the column where its type allows it."""
    compare = _RELATIONAL[operator]
    if isinstance(data_type, T.DoubleType):
        return compare(raw, F.lit(number))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return compare(wall_micros(raw), F.lit(number))
    if isinstance(data_type, T.DecimalType):
        unit, low, high = data_type.scale, -(10**data_type.precision) + 1, 10**data_type.precision - 1
    elif type(data_type) in _INTEGERS:
        high = 2 ** (_INTEGERS[type(data_type)] - 1) - 1
        unit, low = 0, -high - 1
    elif isinstance(data_type, T.DateType):
        unit, low, high = 0, _FIRST_DAY, _LAST_DAY
    else:
        return compare(try_number(raw, data_type), F.lit(number))
    if math.isnan(number):
        return compare(raw.cast("double") if unit or not isinstance(data_type, T.DateType) else F.unix_date(raw).cast("double"), F.lit(number))
    # x > v holds for whole x as x > floor(v), x < v as x < ceil(v); and so on, in the column's units.
    up = operator in (">=", "<")
    if math.isinf(number):
        whole = high + 1 if number > 0 else low - 1
    else:
        whole = int((Decimal(repr(number)) * 10**unit).to_integral_value(ROUND_CEILING if up else ROUND_FLOOR))
    if not low <= whole <= high:
        return raw.isNotNull() & F.lit(compare(0, whole))
    if isinstance(data_type, T.DateType):
        return compare(raw, F.lit(date(1970, 1, 1) + timedelta(days=whole)))
    value = Decimal(whole).scaleb(-unit) if isinstance(data_type, T.DecimalType) else whole
    return compare(raw, F.lit(value).cast(data_type))


def column_text(name: str, data_type: T.DataType) -> Column:
    """A column as the text that conditions compare."""
    raw = F.col(f"`{name}`")
    return list_text(raw) if isinstance(data_type, T.ArrayType) else plain_text(raw, data_type)


def compile_condition(cond: Condition, data_type: T.DataType) -> Column:
    raw = F.col(f"`{cond.column}`")
    as_text = column_text(cond.column, data_type)
    text = F.coalesce(as_text, F.lit(""))
    value = cond.value or ""
    match cond.operator:
        case "contém":
            return F.lower(text).contains(value.lower())
        case "começa com":
            return F.lower(text).startswith(value.lower())
        case "termina com":
            return F.lower(text).endswith(value.lower())
        case "é nulo":
            return raw.isNull() | (text == "")
        case "não é nulo":
            return raw.isNotNull() & (text != "")
    compare = _RELATIONAL.get(cond.operator)
    number = _number(value)
    if compare is not None and number is not None:
        if isinstance(data_type, T.ArrayType):
            return compare(try_number(as_text, T.StringType()), F.lit(number))
        return _relation(raw, data_type, cond.operator, number)
    return text == value


def active(conditions: Iterable[Condition]) -> list[Condition]:
    """Conditions that name a column and, unless null tests, a value."""
    return [c for c in conditions if c.column and (c.operator in (IS_NULL, NOT_NULL) or c.value != "")]


def apply_conditions(df: DataFrame, conditions: Iterable[Condition]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    compiled = [compile_condition(c, types[c.column]) for c in active(conditions)]
    return df.where(reduce(and_, compiled)) if compiled else df


def _resolve_quick(field: str, columns: Sequence[str]) -> str:
    for name in QUICK_FIELDS[field]:
        if name in columns:
            return name
    plain = without_accents(field).lower()
    return next((c for c in columns if without_accents(c).lower() == plain), field)


def with_quick_filters(
    conditions: Iterable[Condition], values: Mapping[str, str], columns: Sequence[str]
) -> list[Condition]:
    """Replace earlier quick filters by the given ones; keep all others."""
    resolved = {field: _resolve_quick(field, columns) for field in QUICK_FIELDS}
    replaced = set(resolved) | set(resolved.values())
    kept = [c for c in conditions if c.column not in replaced]
    quick = [
        Condition(resolved[field], CONTAINS, values[field].strip())
        for field in QUICK_FIELDS
        if values.get(field, "").strip()
    ]
    return kept + quick
