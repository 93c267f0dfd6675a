"""Reading tables: optional Parquet, databases, SQL with parameters, catalogue."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.conditions import Condition, apply_conditions

#: Rows per round trip to a database.
FETCH_SIZE = 50_000


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose taxpayer id is text.

    Where the id is a folder name, Spark would take it for a number and lose
    its leading zeros.
    """
    df = spark.read.parquet(path)
    fields = [T.StructField(f.name, T.StringType()) if f.name == "cnpj" else f for f in df.schema.fields]
    schema = T.StructType(fields)
    return df if schema == df.schema else spark.read.schema(schema).parquet(path)


def load_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None when nothing is at the path."""
    try:
        return load_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_dataset(
    spark: SparkSession, path: str, conditions: Iterable[Condition] = (), columns: Iterable[str] = ()
) -> DataFrame:
    df = apply_conditions(load_table(spark, path), conditions)
    columns = list(columns)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def database_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table read in parallel ranges of a numeric or date column.

    Bounds of a date column are given as text, ``YYYY-MM-DD``.
    """
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties={"fetchsize": str(FETCH_SIZE), **(properties or {})},
    )


def query(spark: SparkSession, text: str, names: Iterable[str], params: Mapping[str, Any]) -> DataFrame:
    """SQL with named parameters. Names ignore case; a missing one is NULL."""
    given = {k.lower(): v for k, v in params.items()}
    return spark.sql(text.strip().rstrip(";"), args={n: given.get(n.lower()) for n in names})


def extract_all(builders: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Run named extracts in name order; each row carries its extract's name."""
    return {
        name.lower(): builders[name]().withColumn("fonte", F.lit(name.upper()))
        for name in sorted(builders, key=str.lower)
    }


def extract_counts(extracts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per extract; an extract without rows counts zero."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("linhas")).select(F.lit(name).alias("consulta"), "linhas")
        for name, df in extracts.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def catalogue(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Files and rows of each table per taxpayer, for tables read from files."""
    parts = [
        df.select("cnpj", F.col("_metadata.file_path").alias("file"))
        .groupBy("cnpj", "file")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("cnpj")
        .agg(F.count(F.lit(1)).alias("arquivos"), F.sum("n").alias("linhas"))
        .withColumn("tabela", F.lit(name))
        for name, df in sorted(datasets.items())
    ]
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    return result.where(F.col("cnpj").rlike("^[0-9]+$")).orderBy("cnpj", "tabela")
