"""Text search that skips files: bits of the three-letter pieces of each file's texts.

No file statistics help a condition like "contains": a file has to be read to
know that it has no row with the text. The index keeps, for each file and
column, which of 2^20 hashed pieces of three letters occur. A file is read only
if it has all the pieces of what is searched for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.conditions import CONTAINS, Condition, active, apply_conditions, column_text
from ..operators.bits import BITMAP, bitmaps, is_set
from .commits import files
from .reader import load_table

#: Letters of a piece, and bits of a file and column: at most 128 KB.
PIECE, BITS = 3, 1 << 20


def _pieces(text: Column) -> Column:
    """Distinct bits of the pieces of a text in lower case."""
    letters = F.split(F.lower(text), "")

    def of(c: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(c) - PIECE, F.lit(0)))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(*[F.get(c, i + k) for k in range(PIECE)]), F.lit(BITS)))

    return F.array_distinct(F.get(F.transform(F.array(letters), of), F.lit(0)))


def build_text_index(spark: SparkSession, table: str, columns: Sequence[str], index: str) -> None:
    """Writes the index of some columns of a table. It is a small part of the table's size.

    Texts are as conditions see them. Rows of a file meet only as bits, after
    they were combined in the task that reads them.
    """
    df = load_table(spark, table)
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), column_text(c, types[c]).alias("text")) for c in columns])
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"), F.explode(cells).alias("cell"))
    rows = rows.select("file", "length", "cell.column", F.explode(_pieces(F.col("cell.text"))).alias("piece"))
    members = rows.select(
        "file", "length", "column", F.floor(F.col("piece") / BITMAP).cast("int").alias("part"), F.pmod("piece", F.lit(BITMAP)).alias("bit")
    )
    found = bitmaps(members, ["file", "length", "column", "part"], "bit")
    # Sorted by column and part, so that a search reads few row groups.
    found.repartitionByRange("column", "part", "file").sortWithinPartitions("column", "part").write.mode("overwrite").parquet(index)


def _path(name: str, encoded: bool) -> str:
    path = urlparse(name).path if encoded else name.split(":", 1)[-1]
    return "/" + (unquote(path) if encoded else path).lstrip("/")


def files_with(spark: SparkSession, table: str, index: str, conditions: Iterable[Condition]) -> list[str]:
    """Files of a table that may hold rows of all the "contains" conditions.

    Files that were written or changed after the index was are among them, and
    all files where no condition has a text of three letters in an indexed column.
    """
    listed = files(spark, table)
    known = spark.read.parquet(index)
    columns = {r["column"] for r in known.select("column").distinct().collect()}
    left = {(_path(name, False), length): name for name, length in listed}
    stale = set(left)
    for indexed in known.select("file", "length").distinct().collect():
        stale.discard((_path(indexed["file"], True), indexed["length"]))
    for c in active(conditions):
        # A lower-case letter may be two characters, so the text in lower case counts.
        if c.operator != CONTAINS or c.column not in columns or len(c.value.lower()) < PIECE:
            continue
        wanted = spark.range(1).select(F.explode(_pieces(F.lit(c.value.lower())))).collect()
        parts: dict[int, list[int]] = {}
        for (piece,) in wanted:
            parts.setdefault(piece // BITMAP, []).append(piece % BITMAP)
        has = reduce(
            or_,
            [
                (F.col("part") == part) & reduce(lambda a, b: a & b, [is_set(F.col("bits"), F.lit(b)) for b in bits])
                for part, bits in parts.items()
            ],
        )
        rows = known.where((F.col("column") == c.column) & has).groupBy("file", "length").count().where(F.col("count") == len(parts))
        kept = {(_path(r["file"], True), r["length"]) for r in rows.collect()}
        left = {key: name for key, name in left.items() if key in kept or key in stale}
    return sorted(left.values())


def load_matching(spark: SparkSession, table: str, index: str, conditions: Iterable[Condition]) -> DataFrame:
    """Rows of a table for which all conditions hold; files without a match are skipped."""
    conditions = list(conditions)
    schema = load_table(spark, table).schema
    names = files_with(spark, table, index, conditions)
    if not names:
        return spark.createDataFrame([], schema)
    return apply_conditions(spark.read.schema(schema).option("basePath", table).parquet(*names), conditions)
