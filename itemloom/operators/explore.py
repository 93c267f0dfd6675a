"""Filter, project and page over any table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.conditions import Condition, apply_conditions
from ..sources.writer import stage

PAGE_SIZE = 200

#: Pages up to this row are cut from the smallest rows of all tasks.
TOP_ROWS = 10_000


@dataclass(frozen=True)
class Page:
    total: int
    pages: int
    rows: DataFrame
    columns: list[str]


def visible(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns that exist; all of them when none is named."""
    if not columns:
        return df
    return df.select(*[f"`{c}`" for c in columns if c in df.columns])


def total_order(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """The given columns, then all others that can be ordered: one order for
    every page, so that no row is on two pages or on none."""
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    names = dict.fromkeys([*order, *df.columns])
    return [F.col(f"`{c}`").asc_nulls_last() for c in names if c not in maps]


class PageIndex:
    """A table in one order, cut into ranges whose numbers of rows are known.

    Made once for a filter and an order: each range is sorted and stored in a
    folder of its own, so a page anywhere reads the one or two it lies in.
    """

    def __init__(self, df: DataFrame, order: Sequence[str]):
        self.keys = total_order(df, order)
        self.columns = df.columns
        place = F.monotonically_increasing_id()
        self.ranges = stage(
            df.withColumn("__task", F.spark_partition_id())
            .repartitionByRange(*self.keys, "__task")
            .sortWithinPartitions(*self.keys, "__task")
            .drop("__task")
            .withColumn("__id", place)
            .withColumn("__range", F.shiftright("__id", 33).cast("int"))
            .withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__id"),
            "pages",
            by=["__range"],
        )
        # One row for each range.
        counts = self.ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect()
        self.starts, self.total = {}, 0
        for row in counts:
            self.starts[row["__range"]] = self.total, row["n"]
            self.total += row["n"]

    def rows(self, page: int, size: int) -> DataFrame:
        offset = (max(page, 1) - 1) * size
        wanted = F.lit(False)
        for number, (start, n) in self.starts.items():
            if start < offset + size and offset < start + n:
                inside = F.col("__place").between(offset - start, offset + size - 1 - start)
                wanted = wanted | ((F.col("__range") == number) & inside)
        return self.ranges.where(wanted).select(*[f"`{c}`" for c in self.columns]).orderBy(*self.keys)


def page_rows(df: DataFrame, page: int, size: int, order: Sequence[str], index: PageIndex | None = None) -> DataFrame:
    """One page of a table in the given order, which all other columns follow.

    The first pages are cut from the smallest rows, which each task looks for
    in its own; later ones come out of an index.
    """
    if index is None and max(page, 1) * size > TOP_ROWS:
        index = PageIndex(df, order)
    if index is not None:
        return index.rows(page, size)
    keys = total_order(df, order)
    return df.orderBy(*keys).limit(max(page, 1) * size).offset((max(page, 1) - 1) * size)


def explore(
    df: DataFrame,
    conditions: Iterable[Condition] = (),
    columns: Sequence[str] = (),
    page: int = 1,
    size: int = PAGE_SIZE,
    order: Sequence[str] = (),
    index: PageIndex | None = None,
) -> Page:
    """Matching rows: their number and one page of the visible columns.

    Rows are ordered by ``order``, or else by all columns, because the order of
    rows in files means nothing to Spark. Whoever turns many pages gives the
    ``index`` of the same filter, columns and order, from :func:`page_index`.
    """
    filtered, shown, order = _explored(df, conditions, columns, order)
    rows = page_rows(filtered, page, size, order, index)
    total = index.total if index else filtered.count()
    return Page(total, max(1, -(-total // size)), visible(rows, shown), shown)


def page_index(
    df: DataFrame, conditions: Iterable[Condition] = (), columns: Sequence[str] = (), order: Sequence[str] = ()
) -> PageIndex:
    """The index behind all pages of one filter, choice of columns and order."""
    filtered, _, order = _explored(df, conditions, columns, order)
    return PageIndex(filtered, order)


def _explored(df: DataFrame, conditions: Iterable[Condition], columns: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    shown = [c for c in columns if c in df.columns] or df.columns
    order = list(order) or df.columns
    needed = list(dict.fromkeys([*shown, *order]))
    return apply_conditions(df, conditions).select(*[f"`{c}`" for c in needed]), shown, order
