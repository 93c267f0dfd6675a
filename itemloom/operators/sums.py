"""Totals by description, year and operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_description
from ..functions.values import exact_sum, rest_sum
from .groups import GROUP

# Operation words, tested in this order, and their column names.
YEAR_COLUMNS = [
    ("ENTRADA", "Valores_Entradas"),
    ("SAIDA", "Valores_Saidas"),
    ("INVENTARIO", "Estoque_final"),
]
OTHER_COLUMN = "Outros"


_PARTS = ["qtd_exata", "qtd_resto", "valor_exato", "valor_resto"]


def _total(exact: str, rest: str) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(F.sum(exact).cast("double"), zero) + F.coalesce(rest_sum(F.col(rest)), zero)


def annual_sums(profiles: DataFrame) -> DataFrame:
    """Quantity and value per group, year and operation; undated items are out
    and a missing operation is a group of its own.

    Added up per original description first, so that descriptions are normalised
    once each.
    """
    by_text = (
        profiles.where(F.col("ano").isNotNull())
        .groupBy("cnpj", "descricao", "ano", "tipo_operacao")
        .agg(*[(rest_sum(F.col(c)) if c.endswith("_resto") else F.sum(c)).alias(c) for c in _PARTS])
    )
    described = by_text.withColumn("descricao_normalizada", normalize_description(F.col("descricao")))
    dated = described.where(F.col("descricao_normalizada").isNotNull())
    return dated.groupBy(*GROUP, "ano", "tipo_operacao").agg(
        _total("qtd_exata", "qtd_resto").alias("qtd_total"), _total("valor_exato", "valor_resto").alias("valor_total")
    )


def year_column() -> Column:
    """Name of the year column an operation belongs to."""
    operation = F.upper(F.coalesce("tipo_operacao", F.lit("")))
    prefix = F.lit(OTHER_COLUMN)
    for word, name in reversed(YEAR_COLUMNS):
        prefix = F.when(operation.contains(word), F.lit(name)).otherwise(prefix)
    return F.concat_ws("_", prefix, F.col("ano").cast("string"))


def year_columns(sums: DataFrame) -> list[str]:
    """The year columns that occur: a few per year, whatever the data size."""
    return sorted(row[0] for row in sums.select(year_column().alias("c")).distinct().collect())


def annual_pivot(sums: DataFrame, columns: list[str]) -> DataFrame:
    """One row per group with a value column per year, 0 where nothing falls.

    Operations that share a column are added up.
    """
    named = sums.withColumn("__column", year_column())
    pivot = named.groupBy(*GROUP).pivot("__column", columns).agg(F.sum("valor_total"))
    return pivot.fillna(0.0, subset=columns)


def annual_map(sums: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(cnpj, descricao_normalizada, valores): the year columns of each group as a
    map in the order of their names, for the years of a range.

    A group has as many entries as it has columns with a value, so neither the
    driver nor the schema knows them, and one wrong date makes no column of all
    groups. What lies outside the range is in :func:`years_outside`.
    """
    inside = sums.where(F.col("ano").between(first_year, last_year))
    totals = inside.groupBy(*GROUP, year_column().alias("name")).agg(exact_sum(F.col("valor_total")).alias("total"))
    entries = F.array_sort(F.collect_list(F.struct("name", "total")))
    return totals.groupBy(*GROUP).agg(F.map_from_entries(entries).alias("valores"))


def years_outside(sums: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """The sums of years that :func:`annual_map` leaves out, for correction."""
    return sums.where(~F.col("ano").between(first_year, last_year))
