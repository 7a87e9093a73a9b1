"""Repair of conversations against shortest paths over all edits, and against its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from foliant.llm import conversation_repair as c
from foliant.llm.conversation_sql import REPAIR

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest_by_search(rows, entry, exits):
    """Dijkstra's search over (row, state) by (cost, audit)."""
    heap, done = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in exits:
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 3, audit + "I", i, c.TURN[state]))
        if i < len(rows):
            letter, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if not gone:
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, c.TURN[state]))
                if letter in c.FOLLOWS[state]:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, c.FOLLOWS[state][letter]))
    return None


def some_rows(rng, n):
    return tuple((rng.choice("suauax "), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n))


def test_branch_and_bound_is_optimal():
    rng = random.Random(1)
    for _ in range(3000):
        rows = some_rows(rng, rng.randint(0, 9))
        entry, exits = rng.randrange(4), rng.choice([c.DONE, *[frozenset((s,)) for s in range(4)]])
        assert c.cheapest(rows, entry, exits) == cheapest_by_search(rows, entry, exits), (rows, entry, exits)
    for letters in ("u" * 128, "a" * 128, "s" * 128, "x" * 128, "uusa" * 32):
        rows = tuple((x, False, i % 3 == 0) for i, x in enumerate(letters))
        assert c.cheapest(rows, c.START, c.DONE) == cheapest_by_search(rows, c.START, c.DONE)


def table():
    rng, rows = random.Random(2), []
    texts = ["Yes.", "No!", "Why?", "an end without", "", " \t\n", "Twice. ", None, "é😀.", "Yes."]
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(texts) if rng.random() < 0.5 else f"Turn {turn} of {conv}."))
    return rows + [(70, 0, "user", "x" * 200_000 + ".")] + rows[:3]


def plain(rows):
    """Every conversation's result, straight from the rules."""
    groups = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        own = groups.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        shape = tuple((role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(own, faults))
        cost, audit = cheapest_by_search(shape, c.START, c.DONE)
        state, i, kept = c.START, 0, []
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[i][1:]
            i += edit != "I"
            if edit != "D":
                state = c.FOLLOWS[state][role[:1]] if edit == "K" else c.TURN[state]
                kept.append(f"{role if edit == 'K' else c.ROLE[state]}:{text}")
        turns = [r[0] for r in own if r[0] is not None]
        pairs = [x[0] + y[0] for x, y in zip(shape, shape[1:])]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in c.LEGAL for p in pairs), cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return found


@pytest.mark.parametrize("block", [3, 128])
def test_repair_against_the_rules_and_sql(spark, block):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fault", "2 AS dropped_", "'x' AS audit")
    # The length of a block is set where the rows are read.
    damaged = c.damage(df.repartition(3))
    known = c.with_faults(damaged)
    found = {}
    state, now = None, object()
    for r in sorted(known.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0)):
        if r.conv_id != now:
            state, now = found.setdefault(r.conv_id, c._Conversation()), r.conv_id
        if not r.dropped:
            state.rows and len(state.rows) == block and state._search([frozenset((s,)) for s in range(4)])
            state.add(r.turn, r.role, r.text, r.fault)
    want = plain(rows)
    assert {k: s.result() for k, s in found.items()} == want
    whole = c.repair(damaged).collect()
    assert {r.conv_id: tuple(r)[1:] for r in whole} == want and len(whole) == len(want)
    db = duckdb.connect()
    frame = df.select("conv_id", "turn", "role", "text").toArrow()
    db.register("conversations", frame)
    assert {r[0]: tuple(r[1:]) for r in db.execute(REPAIR).fetchall()} == want


def test_a_long_conversation_and_none(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Text {i}.") for i in range(3000)]
    damaged = c.damage(spark.createDataFrame(rows, SCHEMA))
    (found,) = c.repair(damaged).collect()
    assert tuple(found)[1:] == plain(rows)[1]
    assert c.repair(c.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_dropped_rows_alone(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (found,) = c.repair(c.damage(spark.createDataFrame([(5, turn, "user", "Gone.")], SCHEMA))).collect()
    assert tuple(found) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
