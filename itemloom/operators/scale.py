"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.writer import stage

#: A key is hot when it holds more than one in this many rows. There can be at
#: most this many hot keys, which bounds what a hot-key join broadcasts.
HOT_KEY_LIMIT = 1000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of keys with their prefixed copies on the right."""
    return reduce(and_, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys])


def prefixed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{k}") for k in keys]


def hot_key_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], rows: str
) -> DataFrame:
    """Left join on nullable keys (NULL matches NULL) that survives hot keys.

    ``right`` has one row per key; its column ``rows`` tells how many left rows
    the key has. The few keys above the limit are broadcast, and their left
    rows, already matched, are spread over many tasks in the shuffled join that
    serves all other keys. They are spread by the task they come from, which
    grows with the data, separates even identical rows, and is the same if the
    task has to be repeated. The result is ``left`` plus ``values``.
    """
    total = right.agg(F.sum(rows)).scalar()
    hot = right.where(F.col(rows) * HOT_KEY_LIMIT > total).select(
        *prefixed(keys, "__hot_"), F.struct(*values).alias("__hot")
    )
    marked = left.join(F.broadcast(hot), same_keys(left, hot, keys, "__hot_"), "left").drop(*[f"__hot_{k}" for k in keys])
    marked = marked.withColumn("__task", F.spark_partition_id())
    marked = marked.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.col("__task") + 1))
    # Always 0, but not a constant: the optimizer would take a constant out of
    # the join keys, and the salt with it.
    zero = (F.col(rows) < 0).cast("int").alias("__zero")
    cold = right.select(*prefixed(keys, "__key_"), F.struct(*values).alias("__cold"), zero)
    on_cold = (marked["__salt"] == cold["__zero"]) & same_keys(marked, cold, keys, "__key_")
    joined = marked.join(cold, on_cold, "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*left.columns, *[found[v].alias(v) for v in values])


def number_within(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    number: str,
    size: str | None = None,
    name: str = "numbered",
) -> DataFrame:
    """Number rows 1, 2, ... inside each group, and optionally give its size.

    A window would sort a whole group in one task. Here rows are range
    partitioned by group and order, so a large group spans many tasks; each
    row's position is staged, and the rows a group has in earlier partitions are
    added from one small total per group and partition. Rows equal in group and
    order are told apart by the task they come from.
    """
    keys = [F.col(g).asc_nulls_last() for g in groups] + list(order)
    position = F.monotonically_increasing_id()
    staged = stage(
        df.withColumn("__task", F.spark_partition_id())
        .repartitionByRange(*keys, "__task")
        .sortWithinPartitions(*keys, "__task")
        .withColumn("__id", position)
        .withColumn("__part", F.shiftright("__id", 33).cast("int"))
        .withColumn("__pos", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id", "__task"),
        name,
    )
    pieces = staged.groupBy(*groups, "__part").agg(
        F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    # Each group has at most one piece per partition, so this window is small.
    in_group = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = in_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # Staged, so that its size is known: numbered rows are not shuffled to join a small table.
    starts = stage(
        pieces.select(
            *prefixed(groups, "__key_"),
            F.col("__part").alias("__key_part"),
            "__first",
            F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
            F.sum("__rows").over(in_group).alias("__size"),
        ),
        f"{name}-starts",
    )
    on = staged["__part"] == starts["__key_part"]
    if groups:
        on = on & same_keys(staged, starts, groups, "__key_")
    numbered = staged.join(starts, on)
    result = [F.col(c) for c in df.columns]
    result.append((F.col("__before") + F.col("__pos") - F.col("__first") + 1).alias(number))
    if size:
        result.append(F.col("__size").alias(size))
    return numbered.select(*result)
