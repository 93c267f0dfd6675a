"""The five source layouts and their mapping to the item table.

Each canonical column lists the source columns that may hold it. The first one
that *exists* is used, whatever its values; a column without candidates, or
without an existing one, is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import strip, strip_column
from ..functions.values import lenient_double, lenient_timestamp, source_text
from .schemas import ITEMS, ITEM_TEXTS, empty

INBOUND = "0 - ENTRADA"
OUTBOUND = "1 - SAIDA"
INVENTORY = "2 - INVENTARIO"
UNDEFINED = "INDEFINIDO"

# Candidate columns of each layout.
_SALES = {
    "codigo": ["prod_cprod", "cod_item", "codigo_produto"],
    "descricao": ["prod_xprod", "descr_item", "descricao_produto"],
    "ncm": ["prod_ncm", "cod_ncm", "ncm"],
    "cest": ["prod_cest", "cest"],
    "gtin": ["prod_cean", "prod_ceantrib", "prod_cbarra", "prod_ean", "prod_eantrib"],
    "unid": ["prod_ucom", "prod_utrib", "unid"],
    "tipo_operacao": ["tipo_operacao"],
    "qtd": ["prod_qcom", "qtd"],
    "valor": ["prod_vprod", "vl_item"],
    "data_mov": ["dhemi", "dh_emi", "dh_emi_utc", "emi_dh", "data_emissao"],
}
LAYOUTS: dict[str, dict[str, list[str]]] = {
    "nfe": _SALES,
    "nfce": _SALES,
    "c170": {
        "codigo": ["cod_item"],
        "descricao": ["descr_item"],
        "descr_compl": ["descr_compl"],
        "tipo_item": ["tipo_item"],
        "ncm": ["cod_ncm"],
        "cest": ["cest"],
        "gtin": ["cod_barra"],
        "unid": ["unid"],
        "tipo_operacao": ["tipo_operacao", "ind_oper"],
        "qtd": ["qtd"],
        "valor": ["vl_item"],
        "data_mov": ["dt_doc"],
    },
    "bloco_h": {
        "codigo": ["codigo_produto"],
        "descricao": ["descricao_produto"],
        "descr_compl": ["obs_complementar"],
        "tipo_item": ["tipo_item"],
        "ncm": ["cod_ncm"],
        "cest": ["cest"],
        "gtin": ["cod_barra"],
        "unid": ["unidade_medida"],
        "qtd": ["quantidade"],
        "valor": ["valor_item"],
        "data_mov": ["dt_inv"],
    },
    "fronteira": {
        "codigo": ["cod_item"],
        "descricao": ["desc_item"],
        "ncm": ["ncm"],
        "cest": ["cest"],
        "tipo_operacao": ["tipo_operacao"],
        "qtd": ["qtd_comercial"],
        "valor": ["valor_produto"],
        "data_mov": ["dhemi"],
    },
}


def first_existing(df: DataFrame, candidates: Sequence[str]) -> T.StructField | None:
    """The first candidate that is a column of ``df``, ignoring case."""
    by_name = {f.name.lower(): f for f in df.schema.fields}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def _operation(layout: str, c: Column) -> Column:
    if layout == "c170":
        return F.when(c.isin("1", "SAIDA"), F.lit(OUTBOUND)).otherwise(F.lit(INBOUND))
    if layout == "bloco_h":
        return F.lit(INVENTORY)
    return c


def canonical(df: DataFrame, layout: str) -> DataFrame:
    """One source in its own layout as item rows.

    A decimal column, as a database delivers numbers, becomes text with the
    digits that it has; it does not pass through a double.
    """
    candidates = LAYOUTS[layout]

    def column(target: T.StructField) -> Column:
        name = target.name
        if name == "cnpj":
            return source_text(F.col("cnpj"), df.schema["cnpj"].dataType).alias(name)
        if name == "fonte":
            return F.lit(layout).alias(name)
        field = first_existing(df, candidates.get(name, []))
        source = F.lit(None) if field is None else F.col(f"`{field.name}`")
        source_type = T.NullType() if field is None else field.dataType
        if name in ("qtd", "valor"):
            return lenient_double(source, source_type).alias(name)
        if name == "data_mov":
            return lenient_timestamp(source).alias(name)
        text = source_text(source, source_type).cast("string")
        if name == "tipo_operacao" and layout in ("c170", "bloco_h"):
            return _operation(layout, text).alias(name)
        if isinstance(source_type, T.StringType):
            return strip_column(f"`{field.name}`").alias(name)
        return strip(text).alias(name)

    return df.select(*[column(f) for f in ITEMS.fields])


def canonical_items(sources: Mapping[str, DataFrame | None], spark: SparkSession | None = None) -> DataFrame:
    """All given sources as one item table; an absent source is skipped."""
    parts = [canonical(sources[name], name) for name in LAYOUTS if sources.get(name) is not None]
    if parts:
        return reduce(DataFrame.unionByName, parts)
    return empty(spark or SparkSession.active(), ITEMS)
