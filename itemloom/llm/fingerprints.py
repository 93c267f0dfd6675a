"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

DataFrame functions only; there is no Python code on the executors.

A table is a sorted array of cells that are not empty. A digest is an entry in
three cells; a cell is the sum of the numbers and the exclusive or of the keys
and checks of its entries, so tables are made, subtracted and peeled by sorting
entries and adding up runs, in n log n steps for a text of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.writer import stage

#: Cells of each of the three subtables of a level of a fingerprint, and levels.
CELLS, LEVELS = 8, 21
#: Cells of a subtable of a larger table, for each digest of both sides.
TRIES = (0.5, 2, 8)
#: Peeling rounds; a round removes every digest that is alone in a cell.
ROUNDS = 24
#: A paragraph is cut behind one word in so many, but finer in the first words
#: of a text: (words, one in), then one in CUT; and after so many words anyway.
HEAD, CUT, LONGEST = ((8, 2), (16, 4), (32, 8)), 16, 64
#: A word with the blanks before it, an ideograph, or a line break. Together they
#: are the whole text. A very long word is several.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
WORD = rf"[^\S\n]*(?:[{_ALONE}]|[^\s{_ALONE}]{{1,32}})|[^\S\n]+|\n"
#: The same words, found faster: scripts are looked up for characters from U+0E00
#: on only, as those below belong to none of these, and nothing is tried twice.
_WORD = (
    rf"[ \t\x0B\f\r]*+(?:[\x00-\x08\x0E-\x1F!-\x{{DFF}}[^\s{_ALONE}]]{{1,32}}+|[\x{{E00}}-\x{{10FFFF}}&&[{_ALONE}]])"
    r"|[ \t\x0B\f\r]++|\n"
)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, not once per use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marked(values: Column, marked) -> Column:
    """Places, from 0, of the values for which ``marked(value, place)`` is true."""
    return F.filter(F.transform(values, lambda v, i: F.when(marked(v, i), i)), lambda i: i.isNotNull())


def _per_run(values: Column, key, use) -> Column:
    """``use(start, length)`` for each run of neighbours with one key."""
    starts = _marked(values, lambda v, i: (i == 0) | (key(v) != key(F.get(values, i - 1))))
    return _let(
        starts, lambda s: F.transform(s, lambda p, k: use(p, F.coalesce(F.get(s, k + 1), F.size(values)) - p))
    )


def _ends(word: Column, place: Column) -> Column:
    h = F.xxhash64(word, F.lit(11))
    one_in = F.lit(CUT)
    for words, n in reversed(HEAD):
        one_in = F.when(place < words, F.lit(n)).otherwise(one_in)
    return (word == "\n") | (F.pmod(h, one_in) == 0)


def paragraph_digests(text: Column) -> Column:
    """Sorted 64-bit digests of the paragraphs of a text.

    A paragraph is a line or, in longer ones, a stretch that ends with a hashed
    word, so an edit changes few of them whatever the lengths of lines. Equal
    paragraphs differ by how many came before. An empty text has none.
    """

    def paragraphs(words: Column) -> Column:
        ends = _marked(words, lambda w, i: _ends(w, i) | (i + 1 == F.size(words)))

        def stretches(end: Column) -> Column:
            def between(e: Column, k: Column) -> Column:
                start = F.coalesce(F.get(end, k - 1) + 1, F.lit(0))
                piece = lambda s: F.xxhash64(F.slice(words, s + 1, F.least(F.lit(LONGEST), e + 1 - s)))
                return F.transform(F.sequence(start, e, F.lit(LONGEST)), piece)

            return F.flatten(F.transform(end, between))

        return F.sort_array(_let(ends, stretches))

    def numbered(own: Column) -> Column:
        copies = lambda p, n: F.transform(F.sequence(F.lit(1), n), lambda j: F.xxhash64(F.get(own, p), j))
        return F.sort_array(F.flatten(_per_run(own, lambda d: d, copies)))

    return _let(_let(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), paragraphs), numbered)


def level(digest: Column) -> Column:
    """Level of a digest in a fingerprint: half of all are in level 0, a quarter in 1, ..."""
    lowest = lambda h: F.least(F.bit_count(h.bitwiseAND(-h) - 1), F.lit(LEVELS - 1))
    return _let(F.xxhash64(digest, F.lit(7)), lowest)


def _in_levels(digest: Column) -> Column:
    """Cells of a digest in a fingerprint."""
    place = lambda first, t: (first + t * CELLS + F.pmod(F.xxhash64(digest, F.lit(1000 + t)), F.lit(CELLS))).cast("long")
    return _let(level(digest) * (3 * CELLS), lambda first: F.array(*[place(first, t) for t in range(3)]))


def _in_table(cells: Column, seed: int):
    """Cells of a digest in one large table of three subtables."""
    return lambda digest: F.array(*[t * cells + F.pmod(F.xxhash64(digest, F.lit(seed + t)), cells) for t in range(3)])


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(3)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(digests: Column, n: Column, places) -> Column:
    def three(d: Column) -> Column:
        entry = lambda at, check: F.struct(at.alias("at"), n.alias("n"), d.alias("key"), check.alias("check"))
        return _let(_check(d), lambda check: F.transform(places(d), lambda at: entry(at, check)))

    return F.flatten(F.transform(digests, three))


def _cells(entries: Column) -> Column:
    """Entries of equal cells added up; cells that become empty are left out."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

    def add(a: Column, e: Column) -> Column:
        return F.struct(
            e["at"].alias("at"),
            (a["n"] + e["n"]).alias("n"),
            a["key"].bitwiseXOR(e["key"]).alias("key"),
            a["check"].bitwiseXOR(e["check"]).alias("check"),
        )

    def added(s: Column) -> Column:
        def sums(starts: Column) -> Column:
            def run(p: Column, k: Column) -> Column:
                return F.when(F.get(starts, k + 1) == p + 1, F.get(s, p)).otherwise(
                    F.aggregate(F.slice(s, p + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - p), zero, add)
                )

            return F.transform(starts, run)

        def starts(at: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i) != F.get(at, i - 1)))

        return F.when(F.size(s) > 0, _let(_let(s["at"], starts), sums)).otherwise(s)

    return F.filter(_let(F.sort_array(entries), added), lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))


def sketch(digests: Column) -> Column:
    """The fingerprint of digests: array<struct<at, n, key, check>>, sorted by cell."""
    return _cells(_entries(digests, F.lit(1), _in_levels))


def subtract(a: Column, b: Column) -> Column:
    less = F.transform(b, lambda c: F.struct(c["at"].alias("at"), (-c["n"]).alias("n"), c["key"].alias("key"), c["check"].alias("check")))
    return _cells(F.concat(a, less))


def peel(difference: Column, places) -> Column:
    """struct<cells, only_a, only_b>: digests recovered from a subtracted table,
    and the cells that are left, none if all digests are recovered."""

    def turn(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"]))
        side = lambda cells, n: F.array_distinct(F.transform(F.filter(cells, lambda c: c["n"] == n), lambda c: c["key"]))
        found = _let(alone, lambda cells: F.struct(side(cells, 1).alias("a"), side(cells, -1).alias("b")))

        def remove(new: Column) -> Column:
            gone = F.concat(_entries(new["a"], F.lit(-1), places), _entries(new["b"], F.lit(1), places))
            more = F.size(new["a"]) + F.size(new["b"]) > 0
            return F.struct(
                F.when(more, _cells(F.concat(state["cells"], gone))).otherwise(state["cells"]).alias("cells"),
                F.concat(state["only_a"], new["a"]).alias("only_a"),
                F.concat(state["only_b"], new["b"]).alias("only_b"),
                more.alias("more"),
            )

        return F.when(state["more"], _let(found, remove)).otherwise(state)

    none = F.array().cast("array<bigint>")
    start = F.struct(difference.alias("cells"), none.alias("only_a"), none.alias("only_b"), (F.size(difference) > 0).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _whole(peeled: Column) -> Column:
    """The digests that a table recovered, or NULL where some are left in it."""
    return _let(peeled, lambda s: F.when(F.size(s["cells"]) == 0, F.struct(s["only_a"].alias("only_a"), s["only_b"].alias("only_b"))))


def _failed(peeled: Column) -> Column:
    """The highest level of two fingerprints that is not recovered, or -1."""
    return F.coalesce(F.array_max(F.transform(peeled["cells"], lambda c: F.floor(c["at"] / (3 * CELLS)))), F.lit(-1))


def differing(a: Column, b: Column, peeled: Column) -> Column:
    """struct<only_a, only_b> of the digests of two documents.

    ``peeled`` is what their fingerprints gave. Where that is not all, one
    larger table after the other is made of the digests in the levels up to the
    last one that is not recovered, without those that are. NULL if the last
    one fails, too.
    """

    def larger(rest: Column) -> Column:
        def table(times: float, seed: int) -> Column:
            def recovered(cells: Column) -> Column:
                places = _in_table(cells, seed)
                return _whole(peel(_cells(F.concat(_entries(rest["a"], F.lit(1), places), _entries(rest["b"], F.lit(-1), places))), places))

            return _let((F.ceil((F.size(rest["a"]) + F.size(rest["b"])) * F.lit(times)) + 16).cast("long"), recovered)

        both = lambda more: F.when(
            more.isNotNull(), F.struct(*[F.concat(peeled[s], more[s]).alias(s) for s in ("only_a", "only_b")])
        )
        return _let(F.coalesce(*[table(times, 2000 + 10 * k) for k, times in enumerate(TRIES)]), both)

    def rest(failed: Column) -> Column:
        left = lambda own, found: F.filter(F.array_except(own, found), lambda d: level(d) <= failed)
        return F.struct(left(a, peeled["only_a"]).alias("a"), left(b, peeled["only_b"]).alias("b"))

    return F.coalesce(_whole(peeled), _let(_let(_failed(peeled), rest), larger))


def likeness(a: Column, b: Column, peeled: Column) -> Column:
    """Likeness of two fingerprints, from what their difference gives by peeling.

    It is the common share of all digests, exact where every digest that differs
    is recovered. Else the levels above the last one that is not recovered are a
    sample of the digests, by a hash, of both sides alike, and the share is
    theirs. Where they are empty, it is the share of equal cells.
    """

    def share(first: Column) -> Column:
        size = lambda cells: F.aggregate(F.filter(cells, lambda c: c["at"] >= first * (3 * CELLS)), F.lit(0), lambda n, c: n + c["n"]) / 3
        apart = F.size(F.filter(F.concat(peeled["only_a"], peeled["only_b"]), lambda d: level(d) >= first))
        cells = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
        return _let(
            F.struct((size(a) + size(b)).alias("both"), apart.alias("apart")),
            lambda v: F.when(v["both"] > 0, (v["both"] - v["apart"]) / (v["both"] + v["apart"]))
            .when(F.size(F.concat(a, b)) == 0, F.lit(1.0))
            .otherwise(cells),
        )

    return _let(_failed(peeled) + 1, share)


def as_text(cells: Column) -> Column:
    """A fingerprint as text: cell, number, key and check of each cell in hexadecimal digits."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", *[F.hex(c[f].cast("long")) for f in ("at", "n", "key", "check")])), " ")


def _worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns whose expressions later steps do not work out again."""
    step = df.select("*", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("step"))
    return step.select(*df.columns, "step.*")


def _next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, next_id): the next larger id, and the smallest after the largest.

    Ids are range partitioned and compared with their neighbours inside a
    range; one row per range tells where the next one begins.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n_chars"))
    ids = stage(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    heads = ids.groupBy("part").agg(F.min("doc_id").alias("head"))
    first = F.lit(ids.agg(F.min("doc_id")).first()[0]).cast("long")
    ranges = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("after"))
    found = ids.withColumn("inside", inside).join(F.broadcast(ranges), "part")
    return found.select("doc_id", "n_chars", F.coalesce("inside", "after", first).alias("next_id"))


def fingerprints(docs: DataFrame, recover: Sequence[str] = ("edited",)) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``docs`` has doc_id and text; other columns are ignored and rows without a
    doc_id are left out. A missing text is an empty one, which has no paragraph;
    two empty texts have likeness 1. The edited text has its last floor(n/4)
    characters replaced by the first as many of the next document in ascending
    doc_id order. A row that repeats a doc_id is fingerprinted as it is; where
    the next doc_id is repeated, its smallest beginning counts.

    Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited and near_next (functions of the two fingerprints alone), and for
    each of ``recover`` ("edited", "next") the digests that differ, with larger
    tables where the fingerprints do not give all (edited_difference,
    next_difference). Texts and their digests are shuffled by doc_id once; what
    goes to the document before is a quarter of its length and the digests.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # Digests go along with the texts in the one shuffle of them, for a document itself and for the one before.
    docs = docs.withColumn("digests", paragraph_digests(F.col("text")))
    before = _next_ids(docs).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("previous"), F.col("n_chars").alias("n_previous"))
    sent = docs.join(before.hint("shuffle_hash"), "doc_id").select(
        F.col("previous").alias("doc_id"),
        F.struct(
            F.substring("text", F.lit(1), F.floor(F.col("n_previous") / 4).cast("int")).alias("head"),
            F.col("digests"),
        ).alias("next"),
    )
    sent = sent.groupBy("doc_id").agg(F.min("next").alias("next"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.head", F.lit(1), quarter))

    rows = docs.join(sent.hint("shuffle_hash"), "doc_id")
    rows = _worked_out(rows, edited=edited).withColumn("n_chars", n.cast("long"))
    sets = {"own": F.col("digests"), "other": paragraph_digests(F.col("edited")), "following": F.col("next.digests")}
    rows = _worked_out(rows, **sets).drop("text", "next", "digests")
    rows = _worked_out(rows, **{f"cells_{c}": sketch(F.col(c)) for c in ("own", "other", "following")})
    sides = {"edited": "other", "next": "following"}
    own = F.col("cells_own")
    rows = _worked_out(rows, **{f"peeled_{k}": peel(subtract(own, F.col(f"cells_{c}")), _in_levels) for k, c in sides.items()})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        as_text(own).alias("fingerprint"),
        as_text(F.col("cells_other")).alias("edited_fingerprint"),
        *[likeness(own, F.col(f"cells_{c}"), F.col(f"peeled_{k}")).alias(f"near_{k}") for k, c in sides.items()],
        *[differing(F.col("own"), F.col(sides[k]), F.col(f"peeled_{k}")).alias(f"{k}_difference") for k in recover],
    )
