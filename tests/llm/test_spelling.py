"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from itemloom.llm.queries import op12_spelling
from itemloom.llm.spelling import Acceptors, letter_runs, near_words, spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deletions(words):
    """Words by what is left when one place is taken out, or left out: near words share one."""
    found = {}
    for w in words:
        for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            found.setdefault(k, set()).add(w)
    return found


def expected(counts, ratio=10):
    near = {w: set() for w in counts}
    for group in deletions(counts).values():
        for a, b in combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b and counts[b] >= ratio * counts[w] else None for w, b in best.items()}
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def random_words(seed, alphabet, longest, n):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize(("alphabet", "longest", "n"), [("ab", 6, 120), ("aé", 9, 400), ("abcdefgh", 4, 400), ("a", 30, 30)])
@pytest.mark.parametrize("part_words", [1 << 14, 3])
def test_every_near_pair_comes_once(spark, alphabet, longest, n, part_words):
    words = random_words(n, alphabet, longest, n)
    rows = near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long"), part_words).collect()
    assert all(r["n"] == words.index(r["word"]) and r["near_n"] == words.index(r["near"]) for r in rows)
    assert Counter(frozenset((r["word"], r["near"])) for r in rows) == Counter(frozenset(p) for p in combinations(words, 2) if one_edit(*p))


def test_acceptors_are_minimal():
    machine = Acceptors()
    p = machine.minimised(["tap", "taps", "top", "tops"])
    assert len(machine.final) == 5 and machine.minimised(["top", "tops", "tap", "taps"][::-1][2:]) is not None
    assert machine.minimised(["tap", "taps", "top", "tops"]) == p
    assert sorted(machine.common(p, p)) == ["tap", "taps", "top", "tops"]
    assert machine.common(machine.minimised([""]), machine.minimised(["", "a"])) == [""]


def test_forms_and_roots(spark):
    counts = {"abcdefg": 5000, "abcdefh": 400, "abcdfh": 3, "abcdefi": 499, "bcdefg": 500, "bcdef": 50, "bcde": 4, "zzzzzzz": 2, "abcdxfg": 5000, "qbcdefg": 5000, "pbcdefg": 5000}
    rows = [(w, n, 1) for w, n in counts.items()] + [("bcdef", 0, 1), (None, 5, 1), ("nothing", None, 1), ("rareone", 1, 1)]
    found = spelling_variants(spark.createDataFrame(rows, "word string, n long, root int"), min_letters=3)
    assert {tuple(r) for r in found.collect()} == expected(counts)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(empty).collect() == []


@pytest.mark.parametrize("part_words", [1 << 14, 5])
def test_long_words_and_chains(spark, part_words):
    rng = random.Random(8)
    long = "".join(rng.choice("abc") for _ in range(3000))
    counts = {long: 10**6, long[:1500] + long[1501:]: 10, long + "a": 10**7, "a" * 2000: 3, "a" * 2001: 40, "ab" * 900: 2, "ab" * 900 + "a": 2}
    word = "chainedword"
    for k in range(9):
        counts[word] = 2 * 10 ** (8 - k)
        word = word[:k] + "z" + word[k + 1 :]
    found = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), part_words=part_words)
    assert {tuple(r) for r in found.collect()} == expected(counts)


def test_runs(table):
    pairs = [(1, "Straße ÀÉÎõüÿß naïveté x1abcdefgh-ABCDEFGHI"), (2, None), (3, ""), (None, "nobodys"), (1, "nobodys nobodys"), (4, "short runs only"), (5, "日本語abcdefg😀")]
    found = letter_runs(table(pairs), "A-Za-zÀ-ÿ", 7).collect()
    assert Counter(map(tuple, found)) == Counter([(1, "ÀÉÎõüÿß"), (1, "naïveté"), (1, "abcdefgh"), (1, "abcdefghi"), (None, "nobodys"), (1, "nobodys"), (1, "nobodys"), (5, "abcdefg")])


def test_query(spark, sf_dir, documents):
    counts, lower = Counter(), {c: c + 32 for c in range(65, 91)}
    for r in documents.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert {tuple(r) for r in op12_spelling(spark, sf_dir).collect()} == expected(counts)
