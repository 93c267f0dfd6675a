"""Token ids of a corpus in Simple-8b files, in ascending document order."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.writer import staging_dir
from .simple8b import decode, encode
from .tokens import tokenizer
from .words import text_batches

#: Ids of one segment, a row of the files; whole documents, so a long one makes a longer segment.
SEGMENT_IDS = 1 << 18

_FORMAT = (
    "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, "
    "words binary, blocks binary, escapes binary"
)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> None:
    """Writes every document's ids and ``end_id`` to ``folder``.

    Shards are ranges of doc_id, ascending; a shard is the part of one task. A
    row of the files is one segment: the ids and lengths of its documents, the
    64-bit words of their token ids, the first word of each block of 512 ids,
    and the escapes. ``first_id`` counts from the start of the shard, so that
    no task needs to know another. The files are Parquet files: the commit of
    Spark's writer makes a repeated task safe on any shared file system.

    A missing text is an empty one; rows without a doc_id are left out; rows
    that repeat a doc_id follow each other in the order of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = tokenizer(path, True)
        shard, segment, total = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values = np.concatenate(ids)
            coded, first, escapes = encode(values)
            row = {
                "shard": shard, "segment": segment, "first_id": total, "n_ids": len(values),
                "doc_ids": np.concatenate(doc_ids), "lengths": np.concatenate(lengths),
                "words": coded.astype("<u8").tobytes(), "blocks": first.astype("<u4").tobytes(),
                "escapes": escapes.astype("<u8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for part, data, offsets in text_batches(batches):
            found, first = words.encode(data, offsets)
            rows = len(first) - 1
            ended = np.insert(found, first[1:], end_id)
            ids.append(ended)
            doc_ids.append(part.column("doc_id").to_numpy())
            lengths.append(np.diff(first) + 1)
            if sum(map(len, ids)) >= SEGMENT_IDS and rows:
                yield flush()
                total, segment = total + sum(map(len, ids)), segment + 1
                doc_ids, lengths, ids = [], [], []
        if ids:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_FORMAT))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _FORMAT).write.parquet(folder, compression="uncompressed")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 [, ids]) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it. It adds up the sizes of
    the earlier shards (one row per shard, a bounded table), the segment's place
    in its shard and the document's place in its segment.
    """
    files = spark.read.schema(_FORMAT).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                escapes = np.frombuffer(row["escapes"], dtype="<u8").reshape(-1, 2)
                values = decode(
                    np.frombuffer(row["words"], dtype="<u8"), np.frombuffer(row["blocks"], dtype="<u4"), escapes, row["n_ids"]
                ).astype("<u4")
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                own = [values[a:b] for a, b in zip(ends - lengths, ends)]
                n = len(lengths)
                columns = [
                    pa.array(np.full(n, row["shard"], dtype=np.int32)),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first_id"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["shard", "doc_id", "place", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = "shard int, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = files.mapInArrow(run, schema).join(F.broadcast(offsets), "shard")
    return found.select("doc_id", (F.col("before") + F.col("place")).alias("start"), *names[3:])


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes a corpus to a new folder of the shared checkpoint folder and reads it back."""
    spark = docs.sparkSession
    folder = f"{staging_dir(spark)}/itemloom/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, folder, end_id)
    return read_tokens(spark, folder)
