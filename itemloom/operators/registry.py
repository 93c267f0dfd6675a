"""The registry of known taxpayers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.schemas import REGISTRY


def registry_upsert(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Registry after a batch of updates (``cnpj``, ``at``, ``ran_now``).

    The first update of an unknown taxpayer registers it; only those that ran
    set the time of the last run.
    """
    changes = updates.select(
        "cnpj", F.col("at").alias("added_at"), F.when(F.col("ran_now"), F.col("at")).alias("last_run_at")
    )
    return (
        state.select(*REGISTRY.names)
        .unionByName(changes)
        .groupBy("cnpj")
        .agg(F.min("added_at").alias("added_at"), F.max("last_run_at").alias("last_run_at"))
        .orderBy("cnpj")
    )


def known_taxpayers(registry: DataFrame, *tables: DataFrame) -> DataFrame:
    """Registered taxpayers and those that have data, sorted."""
    ids = registry.select("cnpj")
    for table in tables:
        ids = ids.union(table.select(F.col("cnpj").cast("string")))
    return ids.where(F.col("cnpj").rlike("^[0-9]+$")).distinct().orderBy("cnpj")
