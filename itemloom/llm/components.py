"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.writer import stage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of a link reaches.

    Every round takes the smallest label among neighbours, then the label of
    that label, so long paths shrink by halves. Labels are written after each
    round; rounds end when none has changed. A node of very many links is one
    row per link in joins that adaptive execution can split, and is combined
    map-side in the minimum. No link or label goes to the driver.
    """
    both = stage(
        links.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y")))
        .where("x <> y")
        .distinct(),
        "links",
    )
    labels = stage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(seen, "x").select("x", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("x").alias("next"), F.col("label").alias("further"))
        moved = stage(
            lower.join(jump, "next", "left").select(
                "x", F.least("next", F.coalesce("further", "next")).alias("label"), F.col("label").alias("old")
            ),
            "labels",
        )
        labels = moved.select("x", "label")
        if moved.where("label <> old").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
