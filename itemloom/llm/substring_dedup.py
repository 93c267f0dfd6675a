"""Removal of repeated word windows, found by recompression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.writer import stage
from .recompression import Sequences, long_symbols, window_anchors
from .words import SpanHash, signed, text_batches, word_spans

#: Rounds for long repeats (symbols of about 30 words), and for the symbols inside one window.
LONG_ROUNDS, WINDOW_ROUNDS = 12, 1


#: Two hashes of a word; together they tell words apart.
_HASHES = SpanHash(41), SpanHash(42)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Sequences, np.ndarray]:
    """Words, hashes of any sequence of them, and the first word of each row (rows + 1)."""
    start, end, first = word_spans(data, offsets)
    words, more = (h.spans(data, start, end) for h in _HASHES)
    return words, Sequences(words, more), first


def _lists(part: pa.RecordBatch, name: str) -> Iterator[tuple[int, list]]:
    """Rows that have a list, with their entries for the text of that row."""
    keys = part.column("key").to_pylist()
    for i, entries in enumerate(part.column(name).to_pylist()):
        if entries:
            yield i, [e for e in entries if e["key"] == keys[i]]


def _long_repeats(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, certified): stretches of words that a smaller doc_id has, too.

    Two neighbouring high-level symbols, and whole documents, are named by what
    they stand for; a name in a smaller doc_id proves the whole stretch. Of a
    copied passage of some length only a few words at its ends are left to the
    search by windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            words, sequences, first = _words(data, offsets)
            counts = np.diff(first)
            row = np.repeat(np.arange(len(counts)), counts)
            symbols = long_symbols(words, row, LONG_ROUNDS)
            near = np.flatnonzero(symbols.row[1:] == symbols.row[:-1])
            rows = np.concatenate([symbols.row[near], np.arange(len(counts))])
            start = np.concatenate([symbols.start[near], first[:-1]])
            end = np.concatenate([symbols.end[near + 1], first[1:]])
            whole = np.arange(len(rows)) >= len(near)
            # Two symbols that are all of a text are the whole text already.
            some = (end - start >= width) & (whole | (end - start < counts[rows]))
            rows, start, end = rows[some], start[some], end[some]
            own = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    signed(sequences.spans(start, end)),
                    signed(sequences.spans(start, end, 1)),
                    part.column("doc_id").take(own),
                    part.column("key").take(own),
                    pa.array((start - first[rows]).astype(np.int32)),
                    pa.array((end - first[rows]).astype(np.int32)),
                ],
                names=["a", "b", "doc_id", "key", "start", "end"],
            )

    spans = stage(docs.select("doc_id", "key", "text").mapInArrow(run, "a long, b long, doc_id long, key int, start int, end int"), "spans")
    first = spans.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        spans.join(first.select("a", "b", "first"), ["a", "b"])
        .where("first < doc_id")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("key", "start", "end")).alias("certified"))
    )


def _open_windows(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, width: int):
    """Words, first words of rows, and (first word, row, name) of windows outside certified stretches."""
    words, sequences, first = _words(data, offsets)
    window, row, name = window_anchors(words, first, width, WINDOW_ROUNDS, sequences)
    done = np.zeros(len(words) + 1, dtype=bool)
    for i, stretches in _lists(part, "certified"):
        for e in stretches:
            done[first[i] + e["start"] : first[i] + e["end"] - width + 1] = True
    keep = ~done[window]
    return first, sequences, window[keep], row[keep], name[keep]


def _names(docs: DataFrame, width: int) -> DataFrame:
    """(name, doc_id): the distinct names of the windows of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            _, _, _, row, name = _open_windows(part, data, offsets, width)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            own = [np.unique(name[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            rows = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays(
                [signed(np.concatenate([name[:0], *own])), part.column("doc_id").take(rows)], names=["name", "doc_id"]
            )

    return docs.mapInArrow(run, "name long, doc_id long")


def _windows(docs: DataFrame, width: int, lists: Sequence[str]) -> DataFrame:
    """Windows whose name is in one of the lists: a 128-bit hash of their words, and their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            first, sequences, window, row, name = _open_windows(part, data, offsets, width)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            wanted = np.zeros(len(row), dtype=bool)
            asked = [part.column(c) for c in lists]
            for i in range(part.num_rows):
                own = slice(bounds[i], bounds[i + 1])
                names = np.concatenate([c[i].values.to_numpy() for c in asked])
                wanted[own] = np.isin(name[own], names.view(np.uint64))
            window, row = window[wanted], row[wanted]
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    signed(sequences.spans(window, window + width)),
                    signed(sequences.spans(window, window + width, 1)),
                    part.column("doc_id").take(own),
                    part.column("key").take(own),
                    pa.array((window - first[row]).astype(np.int32)),
                ],
                names=["a", "b", "doc_id", "key", "at"],
            )

    return docs.mapInArrow(run, "a long, b long, doc_id long, key int, at int")


def _cut(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            gone: dict[int, list[tuple[int, int]]] = {}
            for i, stretches in _lists(part, "certified"):
                gone.setdefault(i, []).extend((e["start"], e["end"]) for e in stretches)
            for i, places in _lists(part, "repeated"):
                gone.setdefault(i, []).extend((e["at"], e["at"] + width) for e in places)
            raw = data.tobytes()
            n_words, n_removed, kept = [], [], []
            for i in range(part.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n_words.append(len(words))
                if i in gone:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    starts, ends = np.array(gone[i]).reshape(-1, 2).T
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, ends, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            columns += [part.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", *carry])

    types = dict(docs.dtypes)
    carried = "".join(f", {c} {types[c]}" for c in carry)
    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string" + carried)


def remove_repeats(docs: DataFrame, width: int = 13, carry: Sequence[str] = ()) -> DataFrame:
    """Removes every word of a window of ``width`` words that also starts in a
    document with a smaller doc_id.

    ``docs`` has doc_id and text. Words are runs of characters other than ASCII
    white space. Windows are judged on the input. Returns doc_id, n_words,
    n_removed, kept (the words left, joined by one space), and the columns of
    ``docs`` named in ``carry``, as they are. A missing text has no words; rows
    without a doc_id are left out; rows that repeat one are told apart by a hash
    of their text; a document of fewer words than a window is left as it is.

    High-level recompression symbols certify the inside of long repeats. All
    other windows are found by a symbol that lies inside them: only those whose
    symbol occurs in several documents are compared, by a 128-bit hash of their
    words. Texts are shuffled once, by doc_id; every further join brings small
    tables to them. What a hot passage adds up to in one place is one row per
    task in aggregations, and joins that adaptive execution can split.
    """
    carry = [c for c in carry if c != "doc_id"]
    further = [c for c in carry if c != "text"]
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.hash("text").alias("key"), "text", *further)
    certified = stage(_long_repeats(docs, width), "certified")
    marked = docs.join(certified.hint("shuffle_hash"), "doc_id", "left")
    names = _names(marked, width)
    shared = names.groupBy("name").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    asked = names.join(shared.select("name", "first").hint("shuffle_hash"), "name")
    # The smallest document of a name has nothing to remove by it; it only lends its windows.
    later = F.col("first") < F.col("doc_id")
    asked = asked.groupBy("doc_id").agg(
        F.collect_set(F.when(later, F.col("name"))).alias("later"), F.collect_set(F.when(~later, F.col("name"))).alias("lent")
    )
    asking = marked.join(asked.hint("shuffle_hash"), "doc_id")
    windows = _windows(asking.where(F.size("later") > 0), width, ["later"])
    first = _windows(asking, width, ["later", "lent"]).groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = (
        windows.join(first.select("a", "b", "first"), ["a", "b"])
        .where("first < doc_id")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("key", "at")).alias("repeated"))
    )
    return _cut(marked.join(repeated.hint("shuffle_hash"), "doc_id", "left"), width, carry)
