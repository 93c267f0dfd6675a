"""Repair of conversations against all shortest paths."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from itemloom.llm.conversation_repair import BLOCK, LETTERS, NEXT, cheapest, repair_conversations, turn_hashes
from itemloom.llm.queries import damaged, op13_conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """(faults, cost, audit, repaired) of ordered (role, text) rows, by Dijkstra over (cost, audit)."""
    seen, faults = set(), []
    for role, text in rows:
        stripped = text.strip(SPACE)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, turns = heapq.heappop(queue)
        if (i, state) in done:
            continue
        if i == len(rows) and state in (0, 3):
            return faults, cost, audit, turns
        done.add((i, state))
        for c, t in NEXT[state].items():
            name = {"u": "user", "a": "assistant"}.get(c)
            if name:
                heapq.heappush(queue, (cost + 5, audit + "I", i, t, (*turns, (name, ""))))
            if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                role, text = rows[i]
                more = 5 if faults[i] else 0
                if role[:1] == c:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, t, (*turns, (role, text))))
                if name:
                    heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, t, (*turns, (name, text))))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, turns))


def by_hand(rows):
    """Everything that the operator says of one conversation of (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, cost, audit, turns = plain([r[1:] for r in rows])
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{x}" for r, x in turns)
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def letters_of(rows):
    return "".join(LETTERS["sua-".index(r[0]) * 4 + k] for r, k in rows)


def test_search_finds_the_least_path():
    rng = random.Random(2)
    for n in range(400):
        rows = [(rng.choice("suua-"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 9))]
        # Texts that have the faults: a duplicate is made of the letter before it.
        texts, plain_rows = itertools.count(), []
        for role, fault in rows:
            if fault == 2 and plain_rows and any(r == role and x.endswith(".") for r, x in plain_rows):
                plain_rows.append(next((r, x) for r, x in plain_rows if r == role and x.endswith(".")))
            else:
                plain_rows.append((role, ["t{}.", "", "t{}.", "t{}"][fault].format(next(texts))))
        faults, cost, audit, _ = plain(plain_rows)
        found = cheapest(letters_of([(r, ["", "blank", "duplicate", "truncated"].index(f)) for (r, _), f in zip(plain_rows, faults)]), 0, None)
        assert (found[0], found[1][::2]) == (cost, audit)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice([f"text {rng.randint(0, 9)}.", "good day!", "no end", "", None, " \n", "end? \t", f"{turn} turns."])
            out.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    return out


@pytest.mark.parametrize(("n", "longest"), [(150, 8), (12, 90)])
def test_conversations(spark, n, longest):
    given = conversations(n, n, longest)
    given += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Yes."), (77_000, None, "user", "a."), (77_000, None, "user", "a.")]
    rows = spark.createDataFrame([(*r, "x", 1, 2) for r in given], "conv_id long, turn long, role string, text string, place string, size long, cost int")
    audit, turns = repair_conversations(rows)
    hashes = {r["conv_id"]: r["sha256"] for r in turn_hashes(turns).collect()}
    found = {r["conv_id"]: (*tuple(r)[1:], hashes.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in audit.collect()}
    groups = defaultdict(list)
    for conv, *row in given:
        groups[conv].append(row)
    assert found == {conv: by_hand(rows) for conv, rows in groups.items()}


def test_long_conversation_of_one_kind(spark):
    """One conversation of many blocks in which every role is wrong."""
    given = [("all", i, "user", f"word {i}.") for i in range(40 * BLOCK + 3)] + [("ends", 0, "user", "a.")]
    audit, turns = repair_conversations(spark.createDataFrame(given, "conv_id string, turn int, role string, text string"))
    found = {r["conv_id"]: r for r in audit.collect()}
    assert tuple(found["all"])[1:] == by_hand([r[1:] for r in given[:-1]])[:-1]
    assert (found["ends"]["cost"], found["ends"]["audit"]) == (2, "D")
    assert turns.where("conv_id = 'ends'").count() == 0
    assert turns.where("conv_id = 'all'").orderBy("place", "step").select("role").first()[0] == "user"


def test_empty(spark):
    audit, turns = repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert audit.collect() == [] and turns.collect() == [] and turn_hashes(turns).collect() == []


def hurt(conv, turn, role, text):
    k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
    return [] if k == 0 else [row, row] if k == 3 else [row]


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]] += hurt(*r)
    return {conv: by_hand(rows) if rows else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, rows in groups.items()}


def test_damage(spark):
    given = conversations(5, 60, 9)
    found = defaultdict(list)
    for r in damaged(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")).collect():
        found[r[0]].append(tuple(r)[1:])
    key = lambda r: (r[0] is None, r)
    wanted = defaultdict(list)
    for r in given:
        wanted[r[0]] += hurt(*r)
    assert {k: sorted(v, key=lambda r: tuple(map(str, r))) for k, v in found.items()} == {k: sorted(v, key=lambda r: tuple(map(str, r))) for k, v in wanted.items() if v}


def test_query(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in op13_conversation_repair(spark, sf_dir).collect()}
    assert found == expected([tuple(r) for r in given])
