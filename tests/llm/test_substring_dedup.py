"""Removal of repeated windows against brute force."""

import random
import re

import numpy as np

from itemloom.llm.recompression import Sequences, long_symbols, window_anchors
from itemloom.llm.substring_dedup import remove_repeats
from itemloom.llm.words import mix


def brute(pairs, width=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in pairs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()}


def test_given_documents(documents):
    pairs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert result(remove_repeats(documents)) == brute(pairs)


def test_passages_runs_and_special_rows(table):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 3)
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 40, 70, 300)]
    pairs = []
    for i in range(80):
        parts = [[word() for _ in range(rng.randrange(0, 60))]]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p))
            parts += [p[a : a + rng.randrange(5, len(p) + 5)], [word() for _ in range(rng.randrange(0, 30))]]
        pairs.append((i * 3, " \n".join(" ".join(p) for p in parts)))
    pairs += [(1000, "the " * 100), (1001, "the " * 50), (1002, "x " + "the " * 13 + "y"), (1003, None), (1004, ""), (1005, " \t ")]
    pairs += [(2000, "é" * 30 + " " + " ".join(passages[5])), (2001, " ".join(f"long{i}" for i in range(40_000))), (2002, " ".join(f"long{i}" for i in range(10, 40_000)))]
    assert result(remove_repeats(table(pairs))) == brute(pairs)


def test_repeated_rows_missing_ids_and_empty_tables(table):
    text = " ".join(str(i) for i in range(20))
    rows = remove_repeats(table([(1, text), (1, text), (1, "other"), (None, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in rows) == [(1, 1, 0), (1, 20, 0), (1, 20, 0), (2, 20, 20)]
    assert remove_repeats(table([])).collect() == []


def test_equal_windows_are_found_by_equal_symbols():
    rng = np.random.default_rng(2)
    window = rng.integers(0, 9, 13)
    texts = [np.concatenate([rng.integers(0, 9, k), window, rng.integers(0, 9, k)]) for k in (0, 1, 2, 5, 30)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = mix(np.concatenate(texts).astype(np.uint64))
    for rounds in (1, 2, 3):
        at, row, name = window_anchors(words, first, 13, rounds, Sequences(words, words))
        place = {(r, a - first[r]): n for a, r, n in zip(at, row, name)}
        assert len({place[i, k] for i, k in enumerate((0, 1, 2, 5, 30))}) == 1


def test_long_symbols_agree_inside_copies():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 1000, 500)
    texts = [np.concatenate([rng.integers(0, 1000, k), core, rng.integers(0, 1000, k)]) for k in (3, 17)]
    row = np.repeat([0, 1], [len(t) for t in texts])
    symbols = long_symbols(mix(np.concatenate(texts).astype(np.uint64)), row, 8)
    shared = set(symbols.name[symbols.row == 0]) & set(symbols.name[symbols.row == 1])
    assert sum((symbols.end - symbols.start)[(symbols.row == 0) & np.isin(symbols.name, list(shared))]) > 400
