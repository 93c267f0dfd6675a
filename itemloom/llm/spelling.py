"""Spelling variants by finite-state composition.

Two words are near if one edit of one letter makes one the other: if the
composition of the vocabulary's acceptor, a one-edit transducer and the
acceptor again accepts the pair. The composed machine is cut by its initial
states, so that its parts are worked on apart: a part takes the words with one
beginning and one end, between which the edit has to be. A word stands in four
parts, with the edit in its first or second half, as the shorter or the longer
word; crowded parts are cut in halves again, down to a single letter. In a part,
the acceptors of what lies between are minimised, and the composition is
walked from its initial state.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.writer import stage

#: Words of one part; more are cut again. Parts of which the edit has one letter are bounded by the alphabet.
PART_WORDS = 1 << 14

#: A part is crowded only if it has more than one in this many rows, which bounds the list of crowded ones.
MAX_CROWDED = 1 << 16

#: States kept by a task; beyond, the next part starts without any.
MAX_STATES = 1 << 19

_PAIRS = "word string, n long, near string, near_n long"


class Acceptors:
    """Minimised acceptors of sets of words. States with equal rests are one state, also of different sets."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(dict(arcs))
        return found

    def minimised(self, words: list[str]) -> int:
        """Initial state of the acceptor of sorted distinct words."""
        path: list[list] = [[False, []]]
        last = ""
        for word in [*words, ""]:  # the empty one completes what is left
            # The last word's states beyond what both have in common are complete.
            same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            while len(path) > same + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, arcs)))
            path += ([False, []] for _ in word[same:])
            last = word
            if word or words[:1] == [""]:
                path[-1][0] = True
        return self._state(*path[0])

    def common(self, p: int, q: int, without: str = "") -> list[str]:
        """Words that both states accept; none that begins with the letter ``without``."""
        out: list[str] = []
        path: list[str] = []
        stack = [(p, q, 0, "")]
        while stack:
            p, q, depth, letter = stack.pop()
            if depth:
                path[depth - 1 :] = [letter]
            if self.final[p] and self.final[q]:
                out.append("".join(path[:depth]))
            fewer, more = self.arcs[p], self.arcs[q]
            if len(fewer) > len(more):
                fewer, more = more, fewer
            for c, t in fewer.items():
                if c in more and (depth or c != without):
                    stack.append((t, more[c], depth + 1, c))
        return out

    def one_edit(self, p: int, r: int, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs of words of p with another letter at one place, and of a word of p
        and one of r (-1: none) with a letter more. Of the places where that
        letter can be inserted the last counts; ``at_end`` allows the very end.
        """
        path: list[str] = []
        stack = [(p, r, 0, "")]
        while stack:
            p, r, depth, letter = stack.pop()
            if depth:
                path[depth - 1 :] = [letter]
            own = self.arcs[p]
            if len(own) > 1:
                arcs = list(own.items())
                for i, (a, s) in enumerate(arcs):
                    for b, t in arcs[i + 1 :]:
                        for rest in self.common(s, t):
                            head = "".join(path[:depth])
                            yield head + a + rest, head + b + rest
            longer = self.arcs[r] if r >= 0 else {}
            for b, t in longer.items():
                for rest in self.common(p, t, without=b):
                    if rest or at_end:
                        head = "".join(path[:depth])
                        yield head + rest, head + b + rest
            for c, t in own.items():
                if longer or len(own) > 1 or self.arcs[t]:
                    stack.append((t, longer.get(c, -1), depth + 1, c))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the parts of a task, whose rows come sorted by part."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    machine, out = Acceptors(), []
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, group in groupby(rows, key=itemgetter(0)):
        group = list(group)
        if len(group) == 1:
            continue
        parts = defaultdict(lambda: ({}, {}))
        for _, word, n, base, low, high in group:
            cut = len(word) - (base - high)
            parts[base, low, high, word[:low], word[cut:]][len(word) - base][word[low:cut]] = n
        for (base, _, high, head, tail), (own, longer) in parts.items():
            if not own or len(own) + len(longer) < 2:
                continue
            if len(machine.final) > MAX_STATES:
                machine = Acceptors()
            p = machine.minimised(sorted(own))
            r = machine.minimised(sorted(longer)) if longer else -1
            for a, b in machine.one_edit(p, r, high == base):
                out.append((head + a + tail, own[a], head + b + tail, own[b] if len(a) == len(b) else longer[b]))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row with the edit in the first and in the second half of its interval."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
    whole = F.array(F.struct("low", "high"))
    cut = rows.withColumn("half", F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(whole)))
    return cut.select("word", "n", "base", "half.low", "half.high")


def _part() -> Column:
    """Number of the part of a row: what comes before and after the interval of the edit."""
    return F.expr("xxhash64(base, low, high, left(word, low), right(word, base - high))")


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n, near, near_n) of all pairs of different words one edit apart, each once.

    ``words`` has distinct words and their numbers n. A crowded part is cut again
    until it has at most ``part_words`` rows, or about one in 65,536 of all if
    that is more, or one letter for the edit; so a part fits a task, whatever
    the words have in common.
    """
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("base")).where("base >= 0")
    rows = _halved(rows.select("*", F.lit(0).alias("low"), F.col("base").alias("high")))
    total = 4 * words.count()
    most = max(part_words, total // MAX_CROWDED)
    slots = 16 * (total // most + 1)
    done = []
    while True:
        rows = rows.withColumn("part", _part()).withColumn("slot", F.pmod("part", F.lit(slots)))
        # Parts are counted together in a bounded number of slots, so one that is not crowded may be cut, too.
        crowded = rows.where("high - low > 1").groupBy("slot").agg(F.count(F.lit(1)).alias("rows"))
        crowded = stage(crowded.where(F.col("rows") > most).select("slot", F.lit(True).alias("crowded")), "spelling-crowded")
        if crowded.isEmpty():
            done.append(rows.drop("slot"))
            break
        marked = rows.join(F.broadcast(crowded), "slot", "left")
        again = F.col("crowded").isNotNull() & (F.col("high") - F.col("low") > 1)
        done.append(marked.where(~again).drop("slot", "crowded"))
        rows = _halved(marked.where(again))
    parts = reduce(DataFrame.unionByName, done).select("part", "word", "n", "base", "low", "high")
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(_composed, _PAIRS)


def _roots(links: DataFrame, hops: int) -> DataFrame:
    """(word, root) of the words with a form: where ``hops`` forms after each other lead, by doubling."""
    roots, reach = links.select("word", F.col("form").alias("root")), 1
    while reach < hops:
        roots = stage(roots, "spelling-roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
        reach *= 2
    return roots


def spelling_variants(
    words: DataFrame, min_letters: int = 7, min_count: int = 2, ratio: int = 10, part_words: int = PART_WORDS
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary.

    ``words`` has words and their numbers n; rows of one word are added up, and
    those without a word or a number count nothing. A word has at least
    ``min_letters`` code points and ``min_count`` occurrences. Its form is its
    near word of largest n, of equal ones the smallest in code-point order, if
    that has at least ``ratio`` times its occurrences. An empty vocabulary has no
    rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio has to be 2 or more")
    counted = words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n"))
    counted = stage(counted.where(F.col("n") >= min_count), "spelling-words")
    pairs = near_words(counted, part_words)
    one, two = F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    sides = pairs.select(F.inline(F.array(one, two)))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = -F.col("best.less") >= F.col("n") * ratio
    links = stage(
        counted.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-links",
    )
    with_form = links.where("form is not null")
    # Each form has ``ratio`` times the occurrences of the word before, which bounds the steps.
    low, high = with_form.agg(F.min("n"), F.max("form_n")).first()
    hops = 0
    while low and low * ratio ** (hops + 1) <= high:
        hops += 1
    found = links.join(_roots(with_form, hops), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def letter_runs(docs: DataFrame, letters: str, at_least: int) -> DataFrame:
    """(doc_id, run) of the maximal runs of ``letters`` (a class of a regular
    expression) of whole texts that have ``at_least`` of them; A-Z become a-z.
    A missing text has none."""
    found = F.regexp_extract_all("text", F.lit(f"[{letters}]{{{at_least},}}"), F.lit(0))
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
