"""Language identification and toxicity: held-out accuracy, and parts against brute force."""

import random
import zlib

import numpy as np
import pytest

from itemloom.llm import toxicity as tox
from itemloom.llm.language_id import LITERAL_BITS, SAMPLE_LETTERS, Parser, languages, learn, suffix_automaton
from itemloom.llm.toxicity import DRIFT, maximal_segments, toxicity

LARGER = "/root/testdata/sf0.01"


def test_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1, 1, 1, 3]
    rows = suffix_automaton(text)

    def accepts(word):
        state = 0
        for c in word:
            if c not in rows[state]:
                return False
            state = rows[state][c]
        return True

    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    rng = random.Random(1)
    for _ in range(3000):
        word = tuple(rng.choice((1, 2, 3)) for _ in range(rng.randrange(1, 6)))
        assert accepts(word) == (word in inside)


def test_phrases_are_counted_as_by_hand():
    parser = Parser({"x": "abcab", "y": "zzzzz"})
    codes = np.frombuffer("Abc, abz?".encode("utf-32-le"), dtype=np.uint32)
    bits, letters = parser.entropy(codes, np.array([0, len(codes)]))
    # under x, "abc ab" is: abc | blank | ab, then z: unknown even to the root, a phrase of its own
    assert letters.tolist() == [6]
    assert bits[0, 0] < bits[0, 1]


def phrases(sample, text):
    """Greedy longest phrases of spaced letters, in stretches of 256, and the letters that no phrase has."""
    fold = lambda x: " ".join("".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in x).split())
    sample, text, n = fold(sample), fold(text), 0
    for k in range(0, len(text), 256):
        part, at = text[k : k + 256], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + size
    return n, sum(c != " " and c not in sample for c in text)


def test_phrases_against_brute_force_in_any_script():
    """More letters than an automaton has columns, and letters beyond the basic plane."""
    rng = random.Random(3)
    scripts = ["".join(map(chr, range(0x4E00, 0x4E00 + 150))), "abcdefgh", "".join(map(chr, range(0x20000, 0x20050))) + "xy", "αβγδεζη"]
    samples = {str(i): "".join(rng.choice(s + "  ") for _ in range(2000)) for i, s in enumerate(scripts)}
    parser = Parser(samples)
    for n in range(60):
        text = "a" + "".join(rng.choice(rng.choice(scripts) + " 1😀") for _ in range(rng.randrange(600))) + rng.choice(list(samples.values()))[: rng.randrange(500)]
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        bits, letters = parser.entropy(codes, np.array([0, len(codes)]))
        spaced = len(" ".join("".join(c if c.isalpha() else " " for c in text).split())) + (not text[-1].isalpha())
        for k, sample in enumerate(samples.values()):
            n_phrases, literals = phrases(sample, text)
            own = parser.automata[k].bits
            # A blank behind the last letter may be one phrase more.
            assert abs(bits[0, k] * spaced - n_phrases * own - literals * (LITERAL_BITS - own)) <= 1.01 * own
        assert letters[0] == sum(c.isalpha() for c in text)


def test_languages_of_other_scripts(table):
    chinese = [(i, "".join(chr(0x4E00 + (i * 7 + k * k) % 900) for k in range(80))) for i in range(1, 40)]
    japanese = [(100 + i, "".join(chr(0x3042 + (i * 5 + k * k) % 80) for k in range(80))) for i in range(1, 40)]
    rows = table(chinese, "zh").union(table(japanese, "ja")).union(table([(200 + i, "plain words of a language") for i in range(5)], "en"))
    found = {r["doc_id"]: r["lang_pred"] for r in languages(rows.union(table([(300, "😀🎉👍"), (301, "\U00020000\U00020001")], None))).collect()}
    assert all(found[i] == ("zh" if i < 100 else "ja" if i < 200 else "en") for i in found if i < 300)
    assert found[300] == "und" and found[301] != "und"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = languages(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_languages_of_special_rows(table):
    rows = [(1, "aaa bbb aaa ab", ), (2, "aab aab bba")]
    docs = table(rows, "aa").union(table([(4, "xyz zzy xyz"), (6, "zyx xxz")], "zz"))
    docs = docs.union(table([(10, None), (11, ""), (12, "12 34!"), (13, "XYZ xyz"), (13, "XYZ xyz"), (None, "aaa"), (14, "aab " * 40_000)], None))
    found = sorted((r["doc_id"], r["lang_pred"], r["score"] > 0) for r in languages(docs).collect())
    assert found[4:] == [(10, "und", False), (11, "und", False), (12, "und", False), (13, "zz", True), (13, "zz", True), (14, "aa", True)]
    assert {r["lang_pred"] for r in languages(table([(1, "abc")], None)).collect()} == {"und"}
    assert languages(table([])).collect() == []


def test_segments_of_very_many_hits_in_linear_time():
    import time

    places = np.arange(200_000) * 40
    start = time.perf_counter()
    assert len(maximal_segments(places, np.full(len(places), 1.0))) == len(places)
    assert time.perf_counter() - start < 2


def test_samples_are_made_of_many_texts(table):
    copies = [(1000 * k + i, f"copied {k * 'y'}") for k in range(3) for i in range(150)]
    long = [(10_000 + k, f"{chr(97 + k)} " * 100_000) for k in range(20)]
    samples = learn(table(copies, "copies").union(table(long, "long")).union(table([(1, "short"), (6, "brief")], "short")))
    assert sorted(samples["copies"].split()) == sorted(["copied"] * 3 + ["y", "yy"])
    outside = {chr(97 + k) for k in range(20) if zlib.crc32(str(10_000 + k).encode()) % 5}
    assert set(samples["long"].split()) == outside and len(outside) > 10
    assert 0.99 * SAMPLE_LETTERS < len(samples["long"]) < 1.01 * SAMPLE_LETTERS
    assert set(samples["short"].split()) <= {"short", "brief"}


def brute_segments(scores):
    """By definition: the best segment, then the same to its left and right."""
    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (top is None or total > top[2] + 1e-9):
                    top = (i, j, total)
        return [] if top is None else best(a, top[0]) + [top] + best(top[1] + 1, b)

    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice((DRIFT, DRIFT, DRIFT, rng.random() * 2 + 0.01)) for _ in range(40)]
    hits = np.array([i for i, s in enumerate(scores) if s > 0], dtype=np.int64)
    found = maximal_segments(hits, np.array([scores[i] for i in hits]))
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in brute_segments(scores)]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    bad = [r for r in held if known[r["doc_id"]] == 1]
    assert sum(r["predicted"] for r in bad) >= 0.75 * len(bad)
    clean = [r for r in held if known[r["doc_id"]] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.005 * len(clean)


def test_toxicity_of_special_rows(spark, table):
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}q" for i in range(20) for j in range(20)]
    pairs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            text[rng.randrange(40)] = "slurword"
        pairs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0), 9))
    pairs += [(1000, None), (1001, ""), (1002, "SLURWORD here"), (1003, "wabq " * 50_000), (1003, "again"), (None, "slurword")]
    marks = spark.createDataFrame([*labels, (None, 1, 9), (5, None, 9), (7, 0, 9)], "doc_id long, toxic int, text int")
    rows = toxicity(table(pairs), marks).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 605
    assert all(by[i]["predicted"] == int(i % 4 == 0) for i in range(600))
    assert [by[i]["predicted"] for i in (1000, 1001, 1002, 1003)] == [0, 0, 1, 0]
    assert by[1002]["segments"][0]["first"] == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity(table(pairs), none).collect()} == {(0.0, 0)}
    assert toxicity(table([]), marks).collect() == []
    assert tox.MAX_FEATURES > 0


def test_toxic_passages_are_all_found(spark, table):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}q" for i in range(20) for j in range(20)]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pairs = [(i, filler(20) + (" slurword " if i % 4 == 0 else " ") + filler(20)) for i in range(600)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    pairs += [(1000, "slurword " + filler(60) + " slurword " + filler(60) + " slurword"), (1001, filler(120))]
    by = {r["doc_id"]: r for r in toxicity(table(pairs), marks).collect()}
    assert [(s["first"], s["last"]) for s in by[1000]["segments"]] == [(0, 0), (61, 61), (122, 122)]
    assert by[1001]["segments"] == [] and all(by[i]["predicted"] == int(i % 4 == 0) for i in range(600))
