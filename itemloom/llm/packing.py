"""Sum-of-squares packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.writer import stage
from .tokens import tokenizer
from .words import text_batches

#: Pieces that one task packs, about. Each task leaves a few sequences partly
#: filled, so this bounds what is lost against packing all in one place.
TASK_PIECES = 60_000


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]): the tokens of each
    document and ``end_id``, cut every ``capacity`` tokens if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path, False)
        for part, data, offsets in text_batches(batches):
            ids, first = words.encode(data, offsets)
            docs_, piece, start, length, crc, tokens = [], [], [], [], [], []
            for i in range(part.num_rows):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    cut = own[at : at + capacity]
                    docs_.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut))
                    tokens.append(cut.tobytes())
            columns = [
                part.column("doc_id").take(pa.array(docs_, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(tokens, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order, by the sum-of-squares rule.

    With N(g) open bins of gap g, an item of size s goes where the sum of all
    N(g)^2 becomes smallest: into a bin of gap g (which becomes g - s, or closes)
    or into a new one. Of equal choices the smallest gap counts, then a new bin.
    """
    bins, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:]) + s
        gap = capacity
        if s < capacity:
            best = 2 * count[capacity - s] + 1
        else:
            best = 0
        if len(gaps):
            left = gaps - s
            change = 1 - 2 * count[gaps] + np.where(left > 0, 2 * count[left] + 1, 0)
            k = int(change.argmin())
            if change[k] <= best:
                gap = int(gaps[k])
        if gap == capacity:
            bins[i], made = made, made + 1
        else:
            bins[i] = open_bins[gap].pop()
            count[gap] -= 1
        offset[i] = capacity - gap
        if gap > s:
            open_bins[gap - s].append(int(bins[i]))
            count[gap - s] += 1
    return bins, offset


def best_place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The better of two orders: all but the short items as they come, then the
    short ones from long to short, which fills the gaps that are left. What
    counts as short is 1/32 of the capacity, which suits many items, or 1/4."""
    results = []
    for short in (capacity // 32, capacity // 4):
        small = lengths <= short
        few = np.flatnonzero(small)
        order = np.concatenate([np.flatnonzero(~small), few[np.argsort(-lengths[few], kind="stable")]])
        bins, offset = np.empty_like(order), np.empty_like(order)
        bins[order], offset[order] = place(lengths[order], capacity)
        results.append((bins, offset))
    return min(results, key=lambda x: x[0].max(initial=-1))


def pack(pieces: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Rows are dealt to tasks by a hash of ``keys``, to as many as the count of
    rows asks for, and each task packs its rows in the order of another hash.
    Both depend on the rows alone: a repeated task gives the same sequences.
    """
    pieces = stage(pieces, "pieces")
    tasks = max(1, round(pieces.count() / TASK_PIECES))
    columns = pieces.columns
    ordered = pieces.withColumn("__order", F.xxhash64(*keys, F.lit("order")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        table = table.sort_by([(k, "ascending") for k in ("__order", *keys, "length")]).drop_columns(["__order"])
        bins, offset = best_place(table.column("length").to_numpy(), capacity)
        bins = bins + (TaskContext.get().partitionId() << 32)
        table = table.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=50_000)

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ordered.repartition(tasks, *keys).mapInArrow(run, schema).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    ``docs`` has doc_id and text; other columns are ignored, rows without a
    doc_id are left out, and repeated rows are packed each. A missing or empty
    text is its end token alone. Returns, per piece, doc_id, piece, start,
    length, ids_crc32, sequence_id and offset, and the ids if asked for.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return pack(token_pieces(docs, path, capacity, with_ids=with_ids), ["doc_id", "piece"], capacity)
