"""Declared schemas of the item table and of the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# The names and the order of all columns below are the format of the tables.
ITEM_TEXTS = ["codigo", "descricao", "descr_compl", "tipo_item", "ncm", "cest", "gtin", "unid", "tipo_operacao"]

ITEMS = T.StructType(
    [T.StructField("cnpj", T.StringType()), T.StructField("fonte", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in ITEM_TEXTS]
    + [
        T.StructField("qtd", T.DoubleType()),
        T.StructField("valor", T.DoubleType()),
        T.StructField("data_mov", T.TimestampNTZType()),
    ]
)

#: What identifies a product, next to the taxpayer.
PRODUCT_KEYS = ["codigo", "descricao", "descr_compl", "tipo_item", "ncm", "cest", "gtin"]

AUDITED_COLUMNS = [
    "fonte", "chave_produto", *PRODUCT_KEYS, "unid", "data_mov", "descricao_normalizada", "co_sefin_inferido",
]

REGISTRY = T.StructType(
    [
        T.StructField("cnpj", T.StringType()),
        T.StructField("added_at", T.TimestampNTZType()),
        T.StructField("last_run_at", T.TimestampNTZType()),
    ]
)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
