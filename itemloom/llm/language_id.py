"""Language of texts by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .folds import fold
from .words import text_batches

#: What a language is learned from: at most this many different labelled texts,
#: chosen by a hash of the text, and a stretch of each, this many characters together.
SAMPLE_TEXTS, SAMPLE_LETTERS = 200, 60_000
#: Letters that one cross-parse covers. Longer texts are parsed in stretches of
#: this length side by side; a phrase ends at the end of its stretch.
STRETCH = 256
#: Symbols that an automaton has a column for: a blank, the most frequent letters
#: of its language, and one for all others, whose transitions stand in a list.
SYMBOLS = 64
BLANK, OTHER = 0, SYMBOLS - 1

#: Bits of a letter that a language's sample does not have: those of any code point.
LITERAL_BITS = 21

_CODES = 0x110000


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case letter of each code point; 0 for what is no letter."""
    out = np.zeros(_CODES, dtype=np.int32)
    for code in range(_CODES):
        char = chr(code)
        if unicodedata.category(char)[0] == "L":
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _letters(codes: np.ndarray) -> np.ndarray:
    """Letters in lower case, 0 for everything else."""
    return _folded()[codes]


def _spaced(letters: np.ndarray) -> np.ndarray:
    """One blank between runs of letters."""
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0
    return letters[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton that accepts exactly the
    substrings of a sequence, from state 0; it is built in linear time."""
    rows: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        state = len(rows)
        rows.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in rows[p]:
            rows[p][c] = state
            p = link[p]
        if p >= 0:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(rows)
                rows.append(dict(rows[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and rows[p].get(c) == q:
                    rows[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return rows


class Language:
    """The automaton of one language's sample, as a table and a list."""

    def __init__(self, sample: str):
        letters = _spaced(_letters(np.frombuffer(sample.encode("utf-32-le"), dtype=np.uint32)))
        known, counts = np.unique(letters[letters > 0], return_counts=True)
        frequent = known[np.argsort(-counts, kind="stable")[: SYMBOLS - 2]]
        self.symbol = np.full(_CODES, OTHER, dtype=np.int8)
        self.symbol[0] = BLANK
        self.symbol[frequent] = np.arange(1, len(frequent) + 1)
        self.bits = np.log2(max(len(letters), 2))
        self.strange = np.ones(_CODES, dtype=bool)
        self.strange[letters] = self.strange[0] = False
        symbols = self.symbol[letters].astype(np.int64)
        rows = suffix_automaton(np.where(symbols == OTHER, SYMBOLS + letters, symbols).tolist())
        table = np.full((len(rows), SYMBOLS), -1, dtype=np.int32)
        others = []
        for state, row in enumerate(rows):
            for c, to in row.items():
                if c < SYMBOLS:
                    table[state, c] = to
                else:
                    others.append((state << 21 | c - SYMBOLS, to))
        # One entry says where to go, times SYMBOLS, and in its lowest bit
        # whether a phrase begins with the symbol. A symbol that even the root
        # does not know is a phrase of its own; behind it, and at the start,
        # there is a state that every symbol leaves with a new phrase.
        self.start = len(rows)
        root = np.where(table[0] < 0, self.start, table[0])
        table = np.concatenate([table, np.full((1, SYMBOLS), -1, dtype=np.int32)])
        ends = table < 0
        self.table = (np.where(ends, root, table).astype(np.int32) * SYMBOLS + ends).astype(np.int32).reshape(-1)
        others.sort()
        self.keys = np.array([-1, *(k for k, _ in others)], dtype=np.int64)
        self.targets = np.array([-1, *(to for _, to in others)], dtype=np.int32)

    def step(self, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The table entries that lead on from entries ``at`` by one letter each."""
        symbols = self.symbol[letters]
        found = self.table[(at & -SYMBOLS) + symbols]
        other = np.flatnonzero(symbols == OTHER)
        if len(other):
            own = letters[other].astype(np.int64)
            root = self._listed(own)
            inner = self._listed((at[other] // SYMBOLS).astype(np.int64) << 21 | own)
            found[other] = np.where(inner >= 0, inner, np.where(root >= 0, root, self.start)) * SYMBOLS + (inner < 0)
        return found

    def _listed(self, keys: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.keys, keys, side="right") - 1
        return np.where(self.keys[k] == keys, self.targets[k], -1)


class Parser:
    """Cross-parses texts against the automaton of each language."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.automata = [Language(samples[k]) for k in self.languages]

    def entropy(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per letter of every text (rows) under every language (columns), and the letters."""
        letters = _letters(codes)
        keep = letters > 0
        after = np.zeros(len(keep), dtype=bool)
        after[1:] = keep[:-1]
        after[offsets[:-1][offsets[:-1] < len(keep)]] = False
        kept = np.flatnonzero(keep | after)
        spaced = letters[kept]
        first = np.searchsorted(kept, offsets)
        sizes = np.diff(first)
        stretches = -(-sizes // STRETCH)
        row = np.repeat(np.arange(len(sizes)), stretches)
        start = first[row] + STRETCH * (np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
        length = np.minimum(STRETCH, first[row + 1] - start)
        order = np.argsort(-length, kind="stable")
        start, length, row = start[order], length[order], row[order]
        # live[t]: how many stretches, longest first, reach beyond place t.
        live = np.searchsorted(-length, -np.arange(STRETCH), side="left")
        out = np.zeros((len(sizes), len(self.languages)))
        columns = [spaced[start[: live[t]] + t] for t in range(STRETCH) if live[t]]
        for k, language in enumerate(self.automata):
            state = np.full(len(start), language.start * SYMBOLS, dtype=np.int32)
            phrases = np.zeros(len(start), dtype=np.int32)
            for column in columns:
                n = len(column)
                step = language.step(state[:n], column)
                state[:n] = step
                phrases[:n] += step & 1
            total = np.bincount(row, weights=phrases, minlength=len(sizes))
            literals = np.diff(np.concatenate([[0], np.cumsum(language.strange[spaced])])[first])
            out[:, k] = (total * language.bits + literals * (LITERAL_BITS - language.bits)) / np.maximum(sizes, 1)
        return out, np.diff(np.concatenate([[0], np.cumsum(keep)])[offsets])


def _share(sizes: list[int], total: int) -> int:
    """The longest stretch that may be taken of each text so that all give at most ``total``."""
    for k, size in enumerate(ordered := sorted(sizes)):
        share = total // (len(ordered) - k)
        if size > share:
            return share
        total -= size
    return max(sizes)


def learn(docs: DataFrame, folds: int = 5, held_out: int = 0) -> dict[str, str]:
    """A bounded sample of text for each language, from labelled texts outside the held-out fold.

    Copies count once. Distinct texts are chosen by a ranking that is cut in
    every task before rows are shuffled by language; then only of them a stretch
    is read, from a place that the hash gives. The letters are dealt evenly: what
    short texts leave goes to the longer ones, so no text makes the sample alone.
    """
    labelled = docs.where("doc_id is not null and lang is not null and text is not null").where(fold("doc_id", folds) != held_out)
    labelled = labelled.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    distinct = labelled.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.max(F.char_length("text")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = distinct.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS).drop("rank").collect()
    sizes: dict[str, list[int]] = {}
    for row in chosen:
        sizes.setdefault(row["lang"], []).append(row["n"])
    shares = {lang: _share(own, SAMPLE_LETTERS) for lang, own in sizes.items()}
    wanted = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["lang"], r["h"], shares[r["lang"]]) for r in chosen], "doc_id long, lang string, h long, share int"
    )
    texts = labelled.join(F.broadcast(wanted), ["doc_id", "lang", "h"])
    start = F.pmod("h", F.greatest(F.char_length("text") - F.col("share"), F.lit(0)) + 1) + 1
    rows = texts.select("lang", "h", F.substring("text", start.cast("int"), F.col("share")).alias("text")).distinct().collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return {lang: " ".join(own) for lang, own in samples.items()}


def languages(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Predicts the language of every whole text.

    ``docs`` has doc_id, text and lang; other columns are ignored and rows
    without a doc_id are left out; repeated rows are predicted each. A text is
    parsed greedily into the longest phrases that a language's sample contains;
    phrases times the bits that point to one, over the number of letters, is its
    entropy under that language, and the smallest wins (ties: the first by
    name). A text without letters, or all texts if nothing is labelled, are
    ``und`` with score 0.

    Returns doc_id, held_out, lang_pred, score: how much smaller the entropy is
    than under the next language, as a share of it, on a scale where 0 is a tie
    and a tenth of the bits is nearly 1; and bits, the entropy per letter.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang").where("doc_id is not null")
    samples = learn(docs, folds, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most SAMPLE_LETTERS for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for part, data, offsets in text_batches(batches):
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
            begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            n = part.num_rows
            if parser.languages:
                bits, letters = parser.entropy(codes, begins)
                best = bits.argmin(axis=1)
                ordered = np.sort(bits, axis=1)
                least = ordered[:, 0]
                score = np.tanh(20 * (1 - least / np.maximum(ordered[:, 1], 1e-9))) if bits.shape[1] > 1 else np.ones(n)
            known = (letters > 0) if parser.languages else np.zeros(n, dtype=bool)
            names = [parser.languages[best[i]] if known[i] else "und" for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(names, pa.string()),
                    pa.array(np.where(known, score, 0.0) if parser.languages else np.zeros(n)),
                    pa.array(np.where(known, least, 0.0) if parser.languages else np.zeros(n)),
                ],
                names=["doc_id", "lang_pred", "score", "bits"],
            )

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")
    return found.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score", "bits")


_PARSERS: dict[int, Parser] = {}


def _parser(samples: dict[str, str]) -> Parser:
    """One per worker process and sample."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(samples)
    return _PARSERS[key]
