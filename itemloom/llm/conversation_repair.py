"""Repair of conversations by iterative-deepening A*.

The cheapest edits turn a conversation into an optional system turn and
alternating user and assistant turns. The search goes depth first through the
edits in ASCII order, under a cost bound that is raised to the least exceeded
value until a path is found; states that failed with a budget are not tried
again with as much or less. So the first path found is the answer.

A conversation is searched in blocks of 16 rows, for each state before and
behind a block; a conversation of several blocks, whatever its length, chains
their results in one pass that holds a few bytes per block. Only a letter per
row goes into the search; texts stay in Spark's tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.scale import hot_key_join, number_within
from ..sources.writer import stage

#: Rows searched together.
BLOCK = 16

#: States: nothing yet, after system, after user, after assistant. What may come next, and what an edit makes.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
MADE = ["u", "u", "a", "u"]
ACCEPTED = (0, 3)

#: A row's letter: four for each of the initials s, u, a and any other; of these no fault, blank, duplicate, truncated.
INITIALS = "sua"
LETTERS = "ABCDEFGHIJKLMNOP"

DELETE, INSERT, REROLE, UNENDED = 2, 5, 1, 5

_NOT_SPACE = r"[^\x20\x09-\x0D]"
_BLOCK = "conv_id {0}, block long, paths array<string>, costs array<long>, illegal long, first string, last string, single boolean"


def _row(letter: str) -> tuple[str, bool, bool]:
    """Initial, whether the row has to be deleted, whether it has no end."""
    kind, fault = divmod(LETTERS.index(letter), 4)
    return (INITIALS + "-")[kind], fault in (1, 2), fault == 3


@lru_cache(maxsize=1 << 16)
def cheapest(letters: str, entry: int, leave: int | None) -> tuple[int, str] | None:
    """Cost and path of the ASCII-least cheapest edits of some rows, or None.

    The path starts in state ``entry`` and ends in ``leave``, with a row's edit
    as its last one, or (None) where a conversation may end. A path has two
    letters for each edit: D, I, K or R, and the initial of the turn, - if none.
    """
    if leave is not None and leave < 2 and (entry > 1 or entry > leave):
        return None  # nothing leads back
    if leave == 1 and entry == 0 and not any(_row(x)[:2] == ("s", False) for x in letters):
        return None
    rows = [_row(x) for x in letters]
    n, least = len(rows), [0]
    for initial, forced, unended in reversed(rows):
        least.append(least[-1] + (DELETE if forced or unended else REROLE if initial == "-" else 0))
    least.reverse()
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []
    over = 0

    def reaches(i: int, state: int, budget: int) -> bool:
        nonlocal over
        if least[i] > budget:
            over = min(over, least[i] - budget)
            return False
        if i == n and (state in ACCEPTED if leave is None else state == leave):
            return True
        if failed.get((i, state), -1) >= budget:
            return False
        made = MADE[state]
        moves = []
        if i < n:
            initial, forced, unended = rows[i]
            extra = UNENDED if unended else 0
            moves.append(("D-", i + 1, state, DELETE))
        if i < n or leave is None:
            moves.append((f"I{made}", i, NEXT[state][made], INSERT))
        if i < n and not forced:
            if initial in NEXT[state]:
                moves.append((f"K{initial}", i + 1, NEXT[state][initial], extra))
            moves.append((f"R{made}", i + 1, NEXT[state][made], REROLE + extra))
        for step, j, then, cost in moves:
            path.append(step)
            if reaches(j, then, budget - cost):
                return True
            path.pop()
        failed[i, state] = budget
        return False

    bound = least[0]
    while True:
        over = 1 << 60
        if reaches(0, entry, bound):
            return bound, "".join(path)
        bound += over
        failed.clear()


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of each block: one for each pair of states before (only the first, in the first block) and behind it."""
    for batch in batches:
        out = []
        for block, letters, last in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            found = [
                cheapest(letters, q, None if last else e) if (q == 0 or block) and (e == 0 or not last) else None
                for q in range(4) for e in range(4)
            ]
            initials = [_row(x)[0] for x in letters]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            out.append(([x and x[1] for x in found], [x and x[0] for x in found], illegal, initials[0], initials[-1], last and not block))
        paths, costs, illegal, first, last, single = zip(*out) if out else [()] * 6
        columns = [batch.column(0), batch.column(1), pa.array(paths, pa.list_(pa.string())), pa.array(costs, pa.list_(pa.int64())),
                   pa.array(illegal, pa.int64()), pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(single, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "paths", "costs", "illegal", "first", "last", "single"])


def _chained(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The state before and behind each block on the best path of its conversation.

    For each state behind a block, the cheapest path to it is kept, of equal
    ones the ASCII-least. Two paths to one block's end never begin with one
    another, as each ends with the edit of the last row: so their order is that
    of the paths to the block before, then that of the paths in the block.
    """
    names = ["conv_id", "block", "pick", "cost"]
    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4))))
    for conv, blocks in groupby(rows, key=itemgetter(0)):
        best, back, first = {0: (0, 0)}, bytearray(), None
        for _, block, paths, costs in blocks:
            first = block if first is None else first
            ways = {}
            for e in range(4):
                found = [(cost + costs[4 * q + e], rank, paths[4 * q + e], q) for q, (cost, rank) in best.items() if costs[4 * q + e] is not None]
                if found:
                    ways[e] = min(found)
            order = sorted(ways, key=lambda e: ways[e][1:3])
            best = {e: (ways[e][0], order.index(e)) for e in ways}
            back += bytes(ways[e][3] if e in ways else 0 for e in range(4))
        picks, state = bytearray(len(back) // 4), 0
        for k in range(len(picks) - 1, -1, -1):
            before = back[4 * k + state]
            picks[k], state = 4 * before + state, before
        for k in range(0, len(picks), 50_000):
            part = list(picks[k : k + 50_000])
            columns = [pa.array([conv] * len(part), kind), pa.array(range(first + k, first + k + len(part)), pa.int64()),
                       pa.array(part, pa.int64()), pa.array([best[0][0] if k + i == 0 else 0 for i in range(len(part))], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, size, letter) of every row, by its initial and its first fault."""
    seen = rows.select(
        "conv_id", "turn", "place", "size", "role", F.sha2("text", 256).alias("words"),
        F.rlike("text", F.lit(_NOT_SPACE)).alias("filled"),
        F.regexp_extract("text", f"({_NOT_SPACE})[\\x20\\x09-\\x0D]*\\z", 1).rlike("[.!?]").alias("ended"),
    )
    firsts = seen.groupBy("conv_id", "role", "words").agg(F.min("place").alias("place_first"), F.count(F.lit(1)).alias("copies"))
    marked = hot_key_join(seen, stage(firsts, "repair-firsts"), ["conv_id", "role", "words"], ["place_first"], "copies")
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    known = F.when((initial > 0) & (F.length("role") > 0), initial - 1).otherwise(3)
    fault = F.when(~F.col("filled"), 1).when(F.col("place") > F.col("place_first"), 2).when(~F.col("ended"), 3).otherwise(0)
    return marked.select("conv_id", "turn", "place", "size", F.substring(F.lit(LETTERS), known * 4 + fault + 1, F.lit(1)).alias("letter"))


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations of (conv_id, turn, role, text).

    Returns two tables. The audit has (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit) of every conversation with rows; the
    repaired turns are (conv_id, place, step, edit, role, text): place counts
    the rows they come from, step the turns made before that row. Rows go by
    turn, missing ones first, then by role and text (by its first 256 characters,
    then a hash). A missing role or text counts as one space; repeated rows are
    duplicates; a missing conv_id is a conversation like any other. Without rows
    both tables are empty. Other columns are not read.
    """
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    rows = rows.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.substring("text", 1, 256).asc(), F.xxhash64("text").asc()]
    rows = stage(number_within(rows, ["conv_id"], order, "place", size="size", name="repair-ordered"), "repair-rows")
    faults = stage(_faults(rows), "repair-faults")
    block = F.floor((F.col("place") - 1) / BLOCK)
    sorted_letters = F.array_sort(F.collect_list(F.struct("place", "letter")))
    blocks = faults.groupBy("conv_id", block.alias("block")).agg(
        F.array_join(F.transform(sorted_letters, lambda x: x["letter"]), "").alias("letters"),
        (F.max("place") == F.max("size")).alias("is_last"),
    )
    searched = stage(blocks.mapInArrow(_searched, _BLOCK.format(kind.simpleString())), "repair-blocks")
    several = searched.where("not single").select("conv_id", "block", "paths", "costs")
    chained = several.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        lambda b: _chained(b, arrow), f"conv_id {kind.simpleString()}, block long, pick long, cost long"
    )
    ends = ["illegal", "first", "last"]
    chosen = null_safe_join(searched.where("not single"), chained, ["conv_id", "block"], "inner")
    chosen = chosen.select("conv_id", "block", F.get("paths", F.col("pick")).alias("path"), "cost", *ends)
    alone = searched.where("single").select("conv_id", "block", F.get("paths", F.lit(0)).alias("path"), F.get("costs", F.lit(0)).alias("cost"), *ends)
    paths = stage(alone.unionByName(chosen), "repair-paths")
    return _audit(faults, paths), _turns(rows, paths)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which missing values are equal; the left ones stay."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])


def _audit(faults: DataFrame, paths: DataFrame) -> DataFrame:
    letter = F.instr(F.lit(LETTERS), F.col("letter")) - 1
    counts = faults.groupBy("conv_id").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0))).alias("span"),
        *[F.count_if(letter % 4 == k).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
    )
    turns = faults.where("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    # A block and the one before it, by its number.
    seam = paths.select("conv_id", (F.col("block") + 1).alias("block"), F.col("last").alias("before"))
    joined = null_safe_join(paths, seam, ["conv_id", "block"], "left")
    unlike = F.col("before").isNotNull() & ~F.concat("before", "first").isin("su", "ua", "au")
    steps = F.array_sort(F.collect_list(F.struct("block", F.regexp_replace("path", "(.).", "$1").alias("edits"))))
    edits = joined.groupBy("conv_id").agg(
        (F.sum("illegal") + F.count_if(unlike)).alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(steps, lambda x: x["edits"]), "").alias("audit"),
    )
    found = null_safe_join(null_safe_join(counts, turns, ["conv_id"], "left"), edits, ["conv_id"], "left")
    gaps = (F.col("span") - F.coalesce("turns", F.lit(0))).cast("long").alias("gaps")
    return found.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _turns(rows: DataFrame, paths: DataFrame) -> DataFrame:
    # A row's edit with what is inserted before it; what is inserted at the end stands alone.
    units = F.regexp_extract_all("path", F.lit("(?:I.)*[DKR].|(?:I.)+$"), F.lit(0))
    units = paths.select("conv_id", "block", F.posexplode(units).alias("at", "unit"))
    units = units.select("conv_id", (F.col("block") * BLOCK + F.col("at") + 1).alias("place"), "unit")
    own = rows.select("conv_id", "place", F.col("role").alias("own_role"), F.col("text").alias("own_text"))
    steps = F.posexplode(F.regexp_extract_all("unit", F.lit(".."), F.lit(0))).alias("step", "move")
    moves = null_safe_join(units, own, ["conv_id", "place"], "left").select("conv_id", "place", "own_role", "own_text", steps)
    edit, made = F.substring("move", 1, 1), F.substring("move", 2, 1)
    name = F.when(made == "u", "user").otherwise("assistant")
    return moves.where(edit != "D").select(
        "conv_id", "place", "step", edit.alias("edit"),
        F.when(edit == "K", F.col("own_role")).otherwise(name).alias("role"),
        F.when(edit == "I", "").otherwise(F.col("own_text")).alias("text"),
    )


def turn_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the turns of each conversation, ``role:text`` joined by line breaks.

    One task reads the turns of a conversation one after the other and holds none.
    """
    kind = turns.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for conv, lines in groupby(rows, key=itemgetter(0)):
            digest, gap = hashlib.sha256(), b""
            for _, line in lines:
                digest.update(gap + line.encode())
                gap = b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([digest.hexdigest()])], names=["conv_id", "sha256"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    lines = ordered.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(run, f"conv_id {kind.simpleString()}, sha256 string")
