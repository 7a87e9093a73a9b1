"""Repair of the structure of conversations.

A repaired conversation is empty, or alternates user and assistant after at most one system turn.
Edits keep, relabel, delete or insert turns. The cheapest ones are found by depth-first branch and
bound: an explicit stack of prefixes, for every row the least the rest can cost whatever the roles
are, the best whole repair so far as a pair (cost, audit), and for every (row, state) the best prefix
that reached it, so that a worse one is cut. Nothing is left on the stack when the search ends,
which proves the incumbent.

Rows meet once, partitioned by conversation and sorted by turn, and are read as a stream. A long
conversation is searched in blocks of ``BLOCK`` rows, from every state a block can be entered in to
every state it can be left in; the best ways to reach the four states are carried from block to block,
each with the hash of its text so far. So a task holds one block, however long a conversation is,
besides its audit, which the result has as one cell anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows searched at a time.
BLOCK = 128
# Solved blocks that a task remembers by their shape.
REMEMBERED = 1 << 16
# What an edit costs, and what an unfinished turn adds that is not deleted.
RELABEL, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
# States: nothing yet, after system, after user, after assistant. What may follow each of them.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
# The state a relabelled or inserted turn leads to, and its role.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
DONE = frozenset((START, ASSISTANT))
LEGAL = {"su", "ua", "au"}

SPACE = r"\x20\x09-\x0D"

RESULT = T.StructType([
    T.StructField("gaps", T.LongType()), T.StructField("blank", T.LongType()),
    T.StructField("duplicate", T.LongType()), T.StructField("truncated", T.LongType()),
    T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()),
    T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
])


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in, by a hash of conversation and turn.

    Of twenty hash values, 0 drops a row, 1 empties its text, 2 takes its full stops, question and
    exclamation marks, 3 repeats it, 4 makes its role user. NULL roles and texts, and NULLs in the
    hashed key, count as one space. Dropped rows stay, with ``dropped`` true, so that every
    conversation is still known.
    """
    def key(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(key("text"), "[.!?]", "")).otherwise(key("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(key("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("dropped"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``, the first of blank, duplicate and truncated that a row has, else NULL.

    A duplicate has the role and text of a row before it. Rows are ordered by turn, NULL first,
    then by role and text. The rows of a conversation end up together, in that order.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(order[0])
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    unfinished = F.col("text").rlike(f"[^{SPACE}.!?][{SPACE}]*\\z")
    fault = F.when(blank, "blank").when(F.col("_seen"), "duplicate").when(unfinished, "truncated")
    return (
        rows.repartition("conv_id").withColumn("_seen", F.row_number().over(same) > 1)
        .sortWithinPartitions("conv_id", *order, "_seen")
        .withColumn("fault", fault).drop("_seen")
    )


def cheapest(rows: tuple[tuple[str, bool, bool], ...], entry: int, exits: frozenset) -> tuple[int, str] | None:
    """The cheapest edits from state ``entry`` to one of ``exits`` as (cost, audit), ASCII-least of ties.

    Of every row: its role's initial, whether it has to go, and whether it is unfinished. The audit
    has the initials of Keep, Relabel (written R), Delete and Insert in order.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        letter, must_go, unfinished = rows[i]
        stay = (0 if letter in ("s", "u", "a") else RELABEL) + UNFINISHED * unfinished
        rest[i] = rest[i + 1] + (DELETE if must_go else min(DELETE, stay))
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best is not None:
            bound = cost + rest[i]
            if bound > best[0] or (bound == best[0] and audit > best[1][:len(audit)]):
                continue
        known = reached.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n and state in exits and (best is None or (cost, audit) < best):
            best = (cost, audit)
        # The last pushed is searched first: keep before relabel and delete, insert at the end.
        stack.append((i, TURN[state], cost + INSERT, audit + "I"))
        if i == n:
            continue
        letter, must_go, unfinished = rows[i]
        extra = UNFINISHED * unfinished
        stack.append((i + 1, state, cost + DELETE, audit + "D"))
        if not must_go:
            stack.append((i + 1, TURN[state], cost + RELABEL + extra, audit + "R"))
            if letter in FOLLOWS[state]:
                stack.append((i + 1, FOLLOWS[state][letter], cost + extra, audit + "K"))
    return best


def _apply(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[str]:
    """The repaired turns as ``role:text``."""
    i = 0
    for edit in audit:
        if edit == "D":
            i += 1
        elif edit == "K":
            role, text = rows[i]
            state, i = FOLLOWS[state][role[:1]], i + 1
            yield f"{role}:{text}"
        else:
            state = TURN[state]
            if edit == "R":
                text, i = rows[i][1], i + 1
            else:
                text = ""
            yield f"{ROLE[state]}:{text}"


class _Conversation:
    """Counts of one conversation, and the best ways so far to every state.

    ``solved`` are the blocks that the task has met, by shape and ends.
    """

    def __init__(self, solved: dict | None = None):
        self.solved = {} if solved is None else solved
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None
        self.ways = {START: (0, "", hashlib.sha256(), False)}
        self.rows: list[tuple[str, str]] = []
        self.shape: list[tuple[str, bool, bool]] = []

    def add(self, turn, role, text, fault) -> None:
        if len(self.rows) == BLOCK:
            self._search([frozenset((state,)) for state in range(4)])
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if fault is not None:
            self.counts[fault] += 1
        letter = role[:1]
        if self.initial is not None and self.initial + letter not in LEGAL:
            self.illegal += 1
        self.initial = letter
        self.rows.append((role, text))
        self.shape.append((letter, fault in ("blank", "duplicate"), fault == "truncated"))

    def _search(self, exits: list[frozenset]) -> None:
        shape, ways = tuple(self.shape), {}
        for leave in exits:
            found = []
            for entry, (cost, audit, _, _) in self.ways.items():
                if (shape, entry, leave) not in self.solved:
                    if len(self.solved) >= REMEMBERED:
                        self.solved.clear()
                    self.solved[shape, entry, leave] = cheapest(shape, entry, leave)
                more = self.solved[shape, entry, leave]
                if more is not None:
                    found.append((cost + more[0], audit + more[1], entry, more[1]))
            if not found:
                continue
            cost, audit, entry, own = min(found)
            digest, some = self.ways[entry][2].copy(), self.ways[entry][3]
            for turn in _apply(own, entry, self.rows):
                digest.update((b"\n" if some else b"") + turn.encode())
                some = True
            ways[min(leave)] = (cost, audit, digest, some)
        self.ways, self.rows, self.shape = ways, [], []

    def result(self) -> tuple:
        self._search([DONE])
        (cost, audit, digest, _), = self.ways.values()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.counts.values(), self.illegal, cost, audit, digest.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    current, now, known, solved = None, None, False, {}
    for batch in batches:
        done = []
        for conv, turn, role, text, dropped, fault in zip(*[c.to_pylist() for c in batch.columns]):
            if not known or conv != now:
                if known:
                    done.append((now, *current.result()))
                current, now, known = _Conversation(solved), conv, True
            if not dropped:
                current.add(turn, role, text, fault)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if known:
        done = [(now, *current.result())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and, if rows may be missing, ``dropped``;
    other columns are left out. Returns ``conv_id``, ``gaps`` (turns missing between the first and
    the last), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours whose roles do not
    follow each other), ``cost``, ``audit`` and ``repaired_sha256``.

    NULL is a conversation of its own; NULL turns come first and count for no gap; NULL roles and
    texts are one space. A role that begins with neither s, u nor a can only be relabelled or
    deleted. A conversation with dropped rows alone has zeros, an empty audit and the hash of
    nothing. Repeated rows are duplicates. No rows give no rows.
    """
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    one = {name: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("role", "text")}
    known = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one["role"].alias("role"),
                        one["text"].alias("text"), "dropped")
    schema = T.StructType([T.StructField("conv_id", known.schema["conv_id"].dataType), *RESULT.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _repaired(batches, to_arrow_schema(schema))

    return with_faults(known).mapInArrow(run, schema)
