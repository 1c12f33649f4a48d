"""Conversation structure repair: the cheapest edits, by a dynamic programme over streamed turns.

Rows are dealt by conversation and sorted from the last turn to the first.  One pass per task
carries, across Arrow batches, the least cost of what follows for each of the four states a
repaired conversation can be in; each row leaves one byte of backpointers (two bits a state).
The rows and backpointers of a conversation wait for its first turn, on disk beyond
``SPILL_BYTES``; then the edits are read off from the first turn to the last.  A task's memory
does not grow with a conversation.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPILL_BYTES = 4 << 20
BATCH_ROWS = 4096
# Fixed values of the contract: white space, sentence ends and the costs of the edits.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.  Nothing
# and a complete pair may end a conversation.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_AFTER = (USER, USER, ASSISTANT, USER)  # the state that the one role missing leads to
_ROLE = ("user", "user", "assistant", "user")
_LETTERS = "DIKR"  # in ASCII order, so the first that attains the least cost is the least audit
_AT_END = (0, 2 * INSERT, INSERT, 0)

_EDITS = "conv string, place long, edit string, turn string, role string, text string, was string, fault string, cost int"
_DIGEST = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")


def spaced(column: str) -> Column:
    """A column as text; a null is one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: the first that holds of blank, duplicate (role and text seen
    earlier in the conversation) and truncated, else null.  Dealt by conversation."""
    bare = F.rtrim("text", F.lit(SPACE))
    seen = Window.partitionBy("conv_id", F.xxhash64("role", "text"), "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return rows.repartition("conv_id").withColumn(
        "fault", F.when(bare == "", "blank").when(F.row_number().over(seen) > 1, "duplicate")
        .when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated"))


@lru_cache(maxsize=None)
def _step(after: tuple, initial: str, fault: str | None) -> tuple[tuple, int, int]:
    """Costs before a row (less their minimum), that minimum, and the row's backpointers.

    ``after`` are the costs after it, less their minimum: two inserts lead from any state to any
    that goes on, so they differ by ten at most, and few distinct steps exist.
    """
    extra = CUT_OFF if fault == "truncated" else 0
    options = [{"D": DELETE + after[q]} for q in range(4)]
    if fault not in ("blank", "duplicate"):
        for q in range(4):
            options[q]["R"] = REROLE + extra + after[_AFTER[q]]
            if (q, initial) in _KEEP:
                options[q]["K"] = extra + after[_KEEP[q, initial]]
    costs = [min(o.values()) for o in options]
    for _ in range(3):
        costs = [min(costs[q], INSERT + costs[_AFTER[q]]) for q in range(4)]
    pointers = 0
    for q in range(4):
        options[q]["I"] = INSERT + costs[_AFTER[q]]
        pointers |= next(k for k, x in enumerate(_LETTERS) if options[q].get(x) == costs[q]) << 2 * q
    low = min(costs)
    return tuple(c - low for c in costs), low, pointers


class _Conversation:
    """The rows of one conversation read so far, last turn first, and the costs before them."""

    def __init__(self):
        self.costs, self.least = _AT_END, 0
        self.parts, self.held, self.file = [], 0, None

    def add(self, rows: list[tuple]) -> None:
        pointers = bytearray()
        for _, role, text, fault in rows:
            self.costs, low, pointer = _step(self.costs, role[:1], fault)
            self.least += low
            pointers.append(pointer)
            self.held += 128 + 4 * len(role) + 4 * len(text)
        self.parts.append((rows, bytes(pointers)))
        if self.held > SPILL_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            for k, part in enumerate(self.parts):
                if isinstance(part, tuple):
                    self.parts[k] = self.file.seek(0, 2)
                    pickle.dump(part, self.file, protocol=pickle.HIGHEST_PROTOCOL)
            self.held = 0

    def rows(self) -> Iterator[tuple]:
        """The rows from the first turn on, each with its backpointers."""
        for part in reversed(self.parts):
            if not isinstance(part, tuple):
                self.file.seek(part)
                part = pickle.load(self.file)
            yield from zip(reversed(part[0]), reversed(part[1]))
        if self.file:
            self.file.close()

    def edits(self) -> Iterator[tuple]:
        """(edit, turn, role, text, role before, fault, cost) of each edit in order."""
        state = EMPTY
        for (turn, role, text, fault), pointers in self.rows():
            extra = CUT_OFF if fault == "truncated" else 0
            while (letter := _LETTERS[pointers >> 2 * state & 3]) == "I":
                yield "I", None, _ROLE[state], "", None, None, INSERT
                state = _AFTER[state]
            if letter == "D":
                yield "D", turn, None, None, role, fault, DELETE
            elif letter == "K":
                yield "K", turn, role, text, role, fault, extra
                state = _KEEP[state, role[:1]]
            else:
                yield "R", turn, _ROLE[state], text, role, fault, REROLE + extra
                state = _AFTER[state]
        while state in (SYSTEM, USER):
            yield "I", None, _ROLE[state], "", None, None, INSERT
            state = _AFTER[state]


def _runs(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[str | None, list[tuple]]]:
    """(conversation, its rows) for each stretch of rows of one conversation within a batch."""
    for batch in batches:
        convs, rows = batch["conv"].tolist(), list(zip(*(batch[n].tolist() for n in names)))
        a = 0
        for b in range(1, len(rows) + 1):
            if b == len(rows) or convs[b] != convs[a]:
                yield convs[a], rows[a:b]
                a = b


def _frames(rows: Iterator[tuple], columns: str) -> Iterator[pd.DataFrame]:
    names, out, size = [c.split()[0] for c in columns.split(", ")], [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(out) == BATCH_ROWS or size > SPILL_BYTES:
            yield pd.DataFrame(out, columns=names, dtype=object)
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=names, dtype=object)


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def finished(conv, told: _Conversation):
        for place, edit in enumerate(told.edits()):
            yield (conv, place, *edit)

    def edits():
        now, told = None, None
        for conv, rows in _runs(batches, ["turn", "role", "text", "fault"]):
            if told is not None and conv != now:
                yield from finished(now, told)
                told = None
            now, told = conv, told or _Conversation()
            told.add(rows)
        if told is not None:
            yield from finished(now, told)

    return _frames(edits(), _EDITS)


def _streamed(rows: DataFrame) -> DataFrame:
    rows = faults(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text")))
    ordered = rows.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"),
                                       (F.col("fault") == "duplicate").desc_nulls_last())
    # Ids travel as text: pandas would turn longs beside nulls into doubles.
    ordered = ordered.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "fault")
    return ordered.mapInPandas(_repair, _EDITS)


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits that give every conversation of ``rows(conv_id, turn, role, text)`` the
    role initials ``(s?(ua)+)?``: ``conv_id, place, edit, turn, role, text, was, fault, cost``.

    One row per edit, ``place`` counting from 0 within the conversation: Keep, Rerole (to user or
    assistant, cost 1), Delete (2; always for a blank or duplicate row), Insert (an empty text,
    5).  A truncated row that stays adds 5.  Of the cheapest edits, those whose initials come
    first in ASCII order are taken.  ``role`` and ``text`` are null for a deleted row, ``was`` is
    the row's role before (null for an inserted one); ``fault`` is as in ``faults``.

    A conversation's rows come by turn (nulls first), equal turns by role and text.  A null role
    or text is one space, so such a text is blank; rows without conv_id are one conversation;
    repeated rows are rows of their own.  Other columns are ignored; an empty table gives no
    rows.  conv_id keeps its type.
    """
    kind = rows.schema["conv_id"].dataType
    return _streamed(rows).select(F.col("conv").cast(kind).alias("conv_id"), "place", "edit", F.col("turn").cast("long").alias("turn"),
                                  "role", "text", "was", "fault", "cost")


class _Digest:
    """Figures of one conversation, from its edits in order.  The repaired text is hashed as it
    passes; the audit holds one character an edit."""

    def __init__(self):
        self.count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.initial = None
        self.audit, self.hash, self.started = [], hashlib.sha256(), False

    def add(self, edits: list[tuple]) -> None:
        for edit, turn, role, text, was, fault, cost in edits:
            self.audit.append(edit)
            self.cost += cost
            if role is not None:
                self.hash.update((("\n" if self.started else "") + f"{role}:{text}").encode())
                self.started = True
            if was is None:
                continue
            if fault is not None:
                self.count[fault] += 1
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.audit = ["".join(self.audit)]

    def row(self) -> tuple:
        gaps = int(self.last) - int(self.first) + 1 - self.turns if self.turns else 0
        return (gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        now, told = None, None
        for conv, edits in _runs(batches, ["edit", "turn", "role", "text", "was", "fault", "cost"]):
            if told is not None and conv != now:
                yield now, *told.row()
                told = None
            now, told = conv, told or _Digest()
            told.add(edits)
        if told is not None:
            yield now, *told.row()

    return _frames(rows(), _DIGEST)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``: the figures of its faults and of ``repair``'s edits,
    the edits' initials and the SHA-256 of the repaired ``role:text`` lines.  The edits are
    digested in the stream that makes them, without a further shuffle."""
    kind = rows.schema["conv_id"].dataType
    return _streamed(rows).mapInPandas(_digests, _DIGEST).select(
        F.col("conv").cast(kind).alias("conv_id"), *[F.col(c.split()[0]) for c in _DIGEST.split(", ")[1:]])


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` as the audit's test of its own repair: a row's crc32 decides whether it
    is dropped (0), emptied (1), loses its sentence ends (2), is repeated (3) or said by the user (4)."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ENDS, "")).otherwise(spaced("text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.where("kind != 0").select(
        "conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(True), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_")).drop("_")


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """``audits`` of the damaged rows, for every original conversation: one that lost all its rows
    has zeros, an empty audit and the hash of an empty text."""
    ids = conversations.select("conv_id").distinct()
    found = audits(damaged(conversations)).withColumnRenamed("conv_id", "_found")
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["_found"]), "left").drop("_found")
    counts = [c for c in found.columns if c not in ("_found", "audit", "repaired_sha256")]
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
