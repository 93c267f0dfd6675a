"""Cleaning, classification and pre-aggregation of items.

Everything the consolidation needs, except the item listing itself, depends on
an item only through its texts, its year and its operation. Annual sums come
from the ``profiles``, which hold the sums of each description, year and
operation; everything else from the ``variants``, which hold the texts. Each is
made of the items by itself: together, their keys are about as many as items,
and rows of all texts and all sums would be shuffled. Cleaning and
classification run on variants, per distinct product and unit, not per item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import numeric_sort_value, valid_cest, valid_gtin, valid_ncm
from ..functions.text import normalize_description, normalize_unit, strip
from ..functions.values import (
    exact_part, fine_part, hundredths, inexact_part, present_sum, rest_sum, with_hundredths,
)
from ..sources.schemas import AUDITED_COLUMNS, PRODUCT_KEYS
from ..sources.writer import stage
from .scale import hot_key_join, number_within

#: Grouping of :func:`variants` and of :func:`profiles`.
VARIANT_KEYS = ["cnpj", "fonte", *PRODUCT_KEYS, "unid"]
PROFILE_KEYS = ["cnpj", "descricao", "tipo_operacao", "ano"]


def identified(items: DataFrame) -> DataFrame:
    """Items with a code and a description; empty texts pass."""
    return items.where(F.col("codigo").isNotNull() & F.col("descricao").isNotNull())


def integrity_score() -> Column:
    """0 to 10, by which of four attributes an item has."""
    weights = {"tipo_item": 4, "gtin_limpo": 3, "ncm_limpo": 2, "cest_limpo": 1}
    score = F.lit(0)
    for name, weight in weights.items():
        score = score + F.when(F.col(name).isNotNull(), weight).otherwise(0)
    return score


def clean_items(items: DataFrame) -> DataFrame:
    """Add the cleaned columns; works on items and on variants."""
    return items.withColumns(
        {
            "descricao_normalizada": normalize_description(F.col("descricao")),
            "unid_padronizada": normalize_unit(F.col("unid")),
            "gtin_limpo": valid_gtin(F.col("gtin")),
            "ncm_limpo": valid_ncm(F.col("ncm")),
            "cest_limpo": valid_cest(F.col("cest")),
            "codigo_num_sort": numeric_sort_value(F.col("codigo")),
        }
    ).withColumn("score_integridade", integrity_score())


def profiles(items: DataFrame) -> DataFrame:
    """Sums of identified items by description, operation and year.

    Sums are kept as an exact decimal part, which no order of addition can
    change, and a double part for numbers too large for it.
    """
    exact, rest = {"qtd_exata": "qtd", "valor_exato": "valor"}, {"qtd_resto": "qtd_exata", "valor_resto": "valor_exato"}
    dated = (
        identified(items)
        .withColumn("ano", F.year("data_mov"))
        .withColumns({f"{c}_whole": hundredths(F.col(c)) for c in exact.values()})
        .withColumns({c: F.when(F.col(f"{c}_whole").isNull(), F.col(c)) for c in exact.values()})
        .withColumns({name: exact_part(F.col(c)) for name, c in exact.items()})
        .withColumns({name: inexact_part(F.col(exact[e]), F.col(e)) for name, e in rest.items()})
        .withColumns({f"{name}_fine": fine_part(F.col(name)) for name in rest})
    )
    return dated.groupBy(*PROFILE_KEYS).agg(
        *[with_hundredths(present_sum(name), F.sum(f"{c}_whole")).alias(name) for name, c in exact.items()],
        *[rest_sum(F.col(c), f"{c}_fine").alias(c) for c in rest],
    )


def variants(items: DataFrame) -> DataFrame:
    """Identified items grouped by their texts, with their number and first and last date."""
    return identified(items).groupBy(*VARIANT_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("data_mov").alias("primeira"), F.max("data_mov").alias("ultima")
    )


def reference_table(df: DataFrame, keys: dict[str, str], value: str, duplicates: str = "error") -> DataFrame:
    """A reference table with trimmed, unique, non-null keys.

    Duplicate keys stop the job, or, if asked with ``min``, the smallest value
    is taken.
    """
    trimmed = df.select(
        *[strip(F.col(f"`{source}`").cast("string")).alias(name) for name, source in keys.items()],
        strip(F.col(f"`{value}`").cast("string")).alias("co_sefin"),
    ).dropna(subset=list(keys))
    chosen = F.min("co_sefin")
    if duplicates == "error":
        message = F.concat(F.lit("Chave repetida na tabela de referência: "), F.concat_ws(" / ", *keys))
        chosen = F.when(F.count(F.lit(1)) > 1, F.raise_error(message).cast("string")).otherwise(chosen)
    return trimmed.groupBy(*keys).agg(chosen.alias("co_sefin"))


def classify(
    items: DataFrame,
    cest_ncm: DataFrame | None = None,
    cest: DataFrame | None = None,
    ncm: DataFrame | None = None,
    duplicates: str = "error",
    keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None,
) -> DataFrame:
    """Add the inferred goods class: by CEST and NCM, else CEST, else NCM.

    An absent reference table is skipped. The distinct pairs of codes are
    classified and joined back, whatever the size of the tables, so no frequent
    or missing code can fill one task. Items and pairs are staged, as both are
    read more than once; ``keep`` gives them a place of its own. The classes are
    joined to the staged items by each reader, so items are written once.
    """
    both = {"cest_limpo": "it_nu_cest", "ncm_limpo": "it_nu_ncm"}
    given = [
        (table, keys, value)
        for table, keys, value in (
            (cest_ncm, both, "it_co_sefin"),
            (cest, {"cest_limpo": "cest"}, "co-sefin"),
            (ncm, {"ncm_limpo": "ncm"}, "co-sefin"),
        )
        if table is not None
    ]
    if not given:
        return items.withColumn("co_sefin_inferido", F.lit(None).cast("string"))

    tiers = [(list(keys), reference_table(table, keys, value, duplicates)) for table, keys, value in given]
    keep = keep or (lambda name, make: stage(make(), name))
    given_items = items
    items = keep("cleaned", lambda: given_items)
    pairs = items.groupBy("cest_limpo", "ncm_limpo").agg(F.count(F.lit(1)).alias("__n"))
    classes = keep("classes", lambda: _first_tier(pairs, tiers))
    return hot_key_join(items, classes, ["cest_limpo", "ncm_limpo"], ["co_sefin_inferido"], "__n")


def _first_tier(df: DataFrame, tiers: list[tuple[list[str], DataFrame]]) -> DataFrame:
    columns = list(df.columns)
    found = []
    for number, (keys, table) in enumerate(tiers):
        name = f"__tier_{number}"
        df = df.join(table.withColumnRenamed("co_sefin", name), keys, "left")
        found.append(F.col(name))
    return df.select(*columns, F.coalesce(*found).alias("co_sefin_inferido"))


def product_index(products: DataFrame) -> DataFrame:
    """Distinct products of each taxpayer with their units and a running key.

    ``products`` are variants (or items) with the product columns and ``unid``;
    missing values are values of their own and sort last. Next to the index
    columns the result has ``n_itens``, the items of the product, and what else
    follows from its texts, if it was given.
    """
    missing = sorted({*PRODUCT_KEYS, "unid"} - set(products.columns))
    if missing:
        raise ValueError(f"Colunas ausentes para o índice de produtos: {missing}")
    unit = strip(F.col("unid"))
    weight = F.sum("n") if "n" in products.columns else F.count(F.lit(1))
    implied = [c for c in ("descricao_normalizada", "co_sefin_inferido") if c in products.columns]
    grouped = products.groupBy("cnpj", *PRODUCT_KEYS, *implied).agg(
        F.sort_array(F.collect_set(F.when(unit != "", unit))).alias("lista_unidades"), weight.alias("n_itens")
    )
    numbered = number_within(
        grouped, ["cnpj"], [F.col(k).asc_nulls_last() for k in PRODUCT_KEYS], "chave_produto", name="index"
    )
    return numbered.select("cnpj", "chave_produto", *PRODUCT_KEYS, "lista_unidades", "n_itens", *implied)


def attach_key(items: DataFrame, index: DataFrame, values: list[str] | None = None) -> DataFrame:
    """Add ``chave_produto`` (and other index columns) to items."""
    return hot_key_join(items, index, ["cnpj", *PRODUCT_KEYS], values or ["chave_produto"], "n_itens")


def audited_items(items: DataFrame, index: DataFrame) -> DataFrame:
    """Every item that has a normalised description, with its product key.

    What follows from a product's texts comes from the index, so it is worked
    out once per product and not per item.
    """
    keyed = attach_key(identified(items), index, ["chave_produto", "descricao_normalizada", "co_sefin_inferido"])
    return keyed.where(F.col("descricao_normalizada").isNotNull()).select("cnpj", *AUDITED_COLUMNS)
