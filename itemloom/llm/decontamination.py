"""Benchmark items inside documents: MinHash containment search, partitioned by size.

DataFrame functions only; there is no Python code on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.writer import stage

_NO_WORD = r"[^\p{L}\p{N}]+"


def _words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _NO_WORD), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, not once per use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda h: h.cast("string")), " ")


def _shingles(words: Column, width: int, short: Sequence[int] | None, hashed: bool) -> Column:
    """Runs of ``width`` neighbouring words. An item (``short`` None) of fewer words
    is one shingle of all of them; a document has the runs of the ``short`` lengths, too."""

    def runs(words: Column, size: int | Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - size)
        if hashed and size is width:
            return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
        one = lambda i: F.xxhash64(F.lit(size), _joined(F.slice(words, i + 1, size))) if hashed else F.array_join(F.slice(words, i + 1, size), " ")
        return F.transform(places, one)

    none = F.array().cast("array<bigint>" if hashed else "array<string>")

    def shingles(words: Column) -> Column:
        n = F.size(words)
        if short is None:
            few = F.xxhash64(n, _joined(words)) if hashed else F.array_join(words, " ")
            return F.when(n >= width, runs(words, width)).when(n > 0, F.array(few)).otherwise(none)
        return F.concat(*[F.when(n >= size, runs(words, size)).otherwise(none) for size in (width, *short)])

    return _let(words, shingles)


def _hashed(text: str, width: int, short: Sequence[int] | None = None) -> Column:
    """64-bit hashes of the shingles."""
    return _shingles(F.transform(_words(text), lambda w: F.xxhash64(w)), width, short, hashed=True)


def _spelled(text: str, width: int, short: Sequence[int] | None = None) -> Column:
    """The distinct shingles as text."""
    return F.array_distinct(_shingles(_words(text), width, short, hashed=False))


def item_sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """(item_id, shingle, n_item): the smallest shingle hashes of each item.

    Items are partitioned by the power of two of their number of shingles. A
    document with the asked share of an item lacks at most the rest, so of one
    more shingle than that it has at least one: a partition's sketches have this
    size for its largest items, and no containment is missed.
    """
    shingles = items.where("item_id is not null").select("item_id", F.explode(_hashed("text", width)).alias("shingle")).distinct()
    sized = shingles.withColumn("n_item", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    size = F.floor(largest * (100 - percent) / 100) + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("shingle"))
    return sized.withColumn("rank", rank).where(F.col("rank") <= size).select("item_id", "shingle", "n_item")


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each document that
    holds at least ``percent`` of the distinct shingles of an item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored and rows without an id are left out. Words are lower-case runs of
    letters and digits. A text without words contains nothing and is in nothing;
    an item of fewer words than a shingle is one shingle of all of them, which
    documents are searched for as well. Rows that repeat an id
    count as one document or item with the shingles of all of them.

    The sketches of the items are written first, so Spark knows their size: it
    sends a small table to all tasks and shuffles a larger one, then splitting
    hot shingles. Only documents that meet a sketch are read again, and verified
    by the words of all shingles.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    sketches = stage(item_sketches(items, width, percent), "item-sketches")
    n_words = F.size(_words("text")).alias("n")
    # Lengths below the width that occur among the items, so a few numbers.
    short = sorted(r["n"] for r in items.where("item_id is not null").select(n_words).where(F.col("n").between(1, width - 1)).distinct().collect())
    found = docs.select("doc_id", F.explode(_hashed("text", width, short)).alias("shingle"))
    met = found.join(sketches, "shingle")
    candidates = stage(met.select("doc_id", "item_id").distinct(), "candidates")

    named = items.where("item_id is not null")
    spelled = named.select("item_id", F.explode(_spelled("text", width)).alias("shingle")).distinct()
    sized = stage(spelled.withColumn("n_item", F.count(F.lit(1)).over(Window.partitionBy("item_id"))), "item-shingles")
    again = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = again.select("doc_id", F.explode(_spelled("text", width, short)).alias("shingle")).join(sized, "shingle")
    shared = shared.join(candidates, ["doc_id", "item_id"], "left_semi").distinct()
    counts = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    return counts.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).select(
        "doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )
