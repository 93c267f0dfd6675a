"""MinHash near-duplicates: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.writer import stage
from .components import components
from .near_sets import digests, shingle_sets
from .similarity_sketch import band_keys, fast_similarity_sketch
from .words import lists, signed, text_batches, utf8

#: Bands and bins per band: at similarity 0.8 a pair shares no band with a probability of 3e-6.
BANDS, ROWS = 32, 5
#: Bins of the finer sketch that compares the members of a bucket. It is kept as
#: one byte a bin; 5 standard deviations below the expected agreement are the
#: limit under which a pair is not verified (probability 3e-7).
FINE_BINS = 1024
#: Members and queries that one comparison block holds.
BLOCK = 2048


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            elements, first = shingle_sets(data, offsets, width)
            sizes = np.diff(first)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sketch = fast_similarity_sketch(elements, owner, len(sizes), bands * rows)
            keys = band_keys(sketch, bands, rows)
            keys = keys[sizes > 0].reshape(-1)
            starts = np.concatenate([[0], np.cumsum((sizes > 0) * bands)])
            a, b = digests(elements, first)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), signed(a), signed(b), lists(keys, starts)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    )


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows (x, y) of ``pairs`` whose full shingle sets have the similarity.

    The texts are joined to the pairs; a text of very many pairs is on the
    small side of a join, so that its pairs can be split over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                x, y = part.column(0), part.column(1)
                left = shingle_sets(*utf8(part.column(2)), width)
                distinct, where = np.unique(y.to_numpy(), return_index=True)
                right = shingle_sets(*utf8(part.column(3).take(pa.array(where))), width)
                at = np.searchsorted(distinct, y.to_numpy())
                keep = np.zeros(part.num_rows, dtype=bool)
                for i, j in enumerate(at):
                    s = left[0][left[1][i] : left[1][i + 1]]
                    t = right[0][right[1][j] : right[1][j + 1]]
                    small, large = min(len(s), len(t)), max(len(s), len(t))
                    if 100 * small >= percent * large > 0:
                        merged = np.sort(np.concatenate([s, t]))
                        common = int((merged[1:] == merged[:-1]).sum())
                        keep[i] = 100 * common >= percent * (small + large - common)
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([x.filter(mask), y.filter(mask)], names=["x", "y"])

    own = pairs.join(texts.select(F.col("doc").alias("x"), F.col("text").alias("text_x")), "x")
    both = own.join(texts.select(F.col("doc").alias("y"), F.col("text").alias("text_y")), "y")
    return both.select("x", "y", "text_x", "text_y").mapInArrow(run, "x long, y long")


def _fine(texts: DataFrame, width: int) -> DataFrame:
    """(doc, fine, keys): sketch of ``FINE_BINS`` bins, one byte each, and the keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            elements, first = shingle_sets(data, offsets, width)
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            fine = fast_similarity_sketch(elements, owner, part.num_rows, FINE_BINS).astype(np.uint8)
            keys = band_keys(fast_similarity_sketch(elements, owner, part.num_rows, BANDS * ROWS), BANDS, ROWS)
            columns = [pa.array([row.tobytes() for row in table], pa.binary()) for table in (fine, keys)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc", "fine", "keys"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, fine binary, keys binary")


def _alike(percent: int):
    """Compares a block: queries (role 1) against members of other components.

    Two texts may meet in many buckets; the first one that they share names them.
    """
    p = percent / 100 + (1 - percent / 100) / 256
    least = int(FINE_BINS * p - 5 * (FINE_BINS * p * (1 - p)) ** 0.5)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        fine = np.frombuffer(b"".join(block["fine"]), dtype=np.uint8).reshape(len(block), -1)
        keys = np.frombuffer(b"".join(block["keys"]), dtype=np.int64).reshape(len(block), -1)
        bucket = block["bucket"].iloc[0]
        doc, component, role = (block[c].to_numpy() for c in ("doc", "component", "role"))
        members = np.flatnonzero(role == 0)
        x, y = [], []
        for q in np.flatnonzero(role == 1):
            others = members[component[members] != component[q]]
            agree = np.count_nonzero(fine[others] == fine[q], axis=1)
            close = others[agree >= least]
            first = (keys[close] == keys[q]).argmax(axis=1)
            close = doc[close[keys[q][first] == bucket]]
            x.append(np.minimum(close, doc[q]))
            y.append(np.maximum(close, doc[q]))
        none = np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"x": np.concatenate([none, *x]), "y": np.concatenate([none, *y])})

    return run


def _open_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of one bucket but of different components that may be similar.

    In each bucket the members outside its largest component are compared with
    all members, in blocks of bounded size: what makes a bucket large makes more
    blocks, not larger ones, and no pair is left out.
    """
    labelled = members.join(labels.withColumnsRenamed({"node": "doc"}), "doc", "left").select(
        "bucket", "doc", F.coalesce("component", "doc").alias("component")
    )
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    spread = (
        parts.groupBy("bucket")
        .agg(
            F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("top"),
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("components"),
        )
        .where("components > 1")
        .select(
            F.col("bucket"),
            (-F.col("top.c")).alias("main"),
            F.ceil(F.col("n") / BLOCK).alias("chunks"),
            F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("query_chunks"),
        )
    )
    open_members = stage(labelled.join(spread, "bucket"), "open-members")
    chunk = F.xxhash64("doc")
    own = F.pmod(chunk, F.col("chunks")).alias("chunk")
    asked = F.pmod(chunk, F.col("query_chunks")).alias("query_chunk")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    rows = open_members.select("bucket", "doc", "component", F.lit(0).alias("role"), own, every("query_chunks", "query_chunk"))
    queries = open_members.where("component <> main").select(
        "bucket", "doc", "component", F.lit(1).alias("role"), every("chunks", "chunk"), asked
    )
    needed = texts.join(open_members.select("doc").distinct(), "doc")
    fine = stage(_fine(needed, width), "fine-sketches")
    blocks = rows.unionByName(queries).join(fine, "doc")
    return blocks.groupBy("bucket", "chunk", "query_chunk").applyInPandas(_alike(percent), "x long, y long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by 100 * common >= percent * union.

    ``docs`` has doc_id and text; other columns are ignored and rows without a
    doc_id are left out. Returns doc_id, n_shingles, component_id (smallest
    doc_id reachable) and kept (doc_id is its component). A document without
    words or text is linked with nothing; repeated rows are classed alike.

    Equal sets form one class first, however many copies there are. Class
    representatives meet in the buckets of their bands. Each bucket links its
    members to its smallest one, verified on full sets; only where that leaves
    several components in one bucket are more of its members compared, by
    blocks of finer sketches, and verified again.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    sketch = stage(sketches(docs, width), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    classes = stage(sketch.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    banded = sketch.withColumnRenamed("doc_id", "rep").join(classes, ["rep", *key], "left_semi")
    banded = banded.select(F.col("rep").alias("doc"), F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.min("doc").alias("center"), F.max("doc").alias("last")).where("center < last")
    members = stage(banded.join(shared.drop("last"), "bucket"), "members")
    candidates = members.select("doc").distinct().hint("shuffle_hash")
    # Several rows of one id hold either the same set or are told apart by their class.
    reps = docs.withColumnRenamed("doc_id", "doc").join(candidates, "doc", "left_semi")
    texts = stage(reps.groupBy("doc").agg(F.min("text").alias("text")), "texts")

    star = members.where("doc <> center").select(F.col("doc").alias("x"), F.col("center").alias("y")).distinct()
    links = stage(verified(star, texts, width, percent), "links")
    labels = components(links, "x", "y")
    more = stage(verified(_open_pairs(members, labels, texts, width, percent), texts, width, percent), "links")
    labels = components(links.unionByName(more), "x", "y")

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component_id")
    )
    found = sketch.drop("bands").join(named, key, "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
