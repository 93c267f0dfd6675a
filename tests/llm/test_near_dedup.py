"""Near duplicates against all pairs by brute force."""

import itertools
import random
import re

import numpy as np

from itemloom.llm.components import components
from itemloom.llm.near_dedup import near_duplicates
from itemloom.llm.similarity_sketch import EMPTY, fast_similarity_sketch
from itemloom.llm.words import mix


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(pairs, width, percent=80):
    sets = {i: shingles(t, width) for i, t in pairs}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            group[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_given_documents(spark, documents):
    pairs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert result(near_duplicates(documents, width=4)) == brute(pairs, 4)


def test_chains_of_edits_and_special_rows(table):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    pairs, text = [], list(base)
    for i in range(60):  # a chain: neighbours are alike, the ends are not
        text = list(text)
        text[rng.randrange(len(text))] = rng.choice(words)
        pairs.append((1000 - i, " ".join(text)))
    for i in range(60):  # a star: many different edits of one text
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        pairs.append((2000 + i, " ".join(own)))
    pairs += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "x " * 5000), (8, "X " * 5000)]
    got = result(near_duplicates(table(pairs), width=4))
    assert got == brute(pairs, 4)
    assert got[1] == (0, 1, True) and got[5][1] == 4 and got[8][1] == 7


def test_repeated_rows_missing_ids_and_empty_tables(table):
    got = near_duplicates(table([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B C D E")])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(table([])).collect() == []


def test_sketch_fills_every_bin_and_estimates_similarity():
    rng = np.random.default_rng(1)
    a = mix(np.arange(1000, dtype=np.uint64))
    for share in (0.5, 0.8):
        n = round(1000 * share)
        b = np.concatenate([a[:n], mix(rng.integers(1 << 40, 1 << 60, 1000 - n).astype(np.uint64))])
        both = fast_similarity_sketch(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2, 1024)
        assert abs((both[0] == both[1]).mean() - n / (2000 - n)) < 0.06
    few = fast_similarity_sketch(a[:1], np.zeros(1, dtype=np.int64), 2, 160)
    assert (few[0] != EMPTY).all() and (few[1] == EMPTY).all()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    assert found == {i: 0 for i in range(201)} | {400: 400, 500: 400}
