"""Least-cost repair of damaged conversations by A* on the edit lattice.

A conversation's rows are edited in order until the initials of their roles read (s?(ua)+)?. Keep costs nothing, Rerole
to user or assistant 2, Delete 3 and Insert of an empty user or assistant turn 2; blank and duplicate rows must be
deleted, a truncated row that stays adds 1. A node of the lattice is (rows done, last initial put out). The heuristic is
a suffix sum: 3 for each row that has to go and 1 for each truncated row still ahead, which is charged whether it stays
or goes; it never overestimates and falls by no more than an edge costs. Nodes leave the queue by (cost + heuristic,
audit), the audit being the initials of the edits so far, so that the first goal taken has the least cost and, of those,
the ASCII-least audit: of two paths to a node with the same cost the lesser audit stays lesser whatever follows.

Spark's part: texts are reduced to digests and faults in the JVM, rows equal in all of it are counted together, and the
first place of a role and text in a conversation comes from a pre-aggregated grouping. Each conversation's small rows
meet in order in one stream, in which it takes one byte a row; conversations over `window` rows are searched in windows,
for which the least cost behind each cut is known beforehand. Texts are dealt once, sorted together with the edits, and
hashed as they pass, so a task holds one text at a time. A conversation's SHA-256 is a sequential sum and has to pass
through one task; nothing else of it does.

Defined cases: null conv_id is a conversation of its own; null role and null text are one space, and in the damage key
null conv_id and null turn as well; rows sort by turn (nulls first), then role, then SHA-256 of the text; repeated rows
are duplicates; a role that doesn't begin with s, u or a fits nowhere and is reroled or deleted; a text of any length is
taken whole; columns other than the four are not carried; an empty table gives an empty result; a conversation without
rows has an empty repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE

#: Fixed costs of the edits.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Codes of a row: its role's initial (0 none, 1 s, 2 u, 3 a), plus these for its fault.
CUT, GONE = 4, 8
INITIAL = {"s": 1, "u": 2, "a": 3}
#: The state behind a role put out: 0 nothing yet, 1 s, 2 u, 3 a. What may follow each.
FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
GOALS = (0, 3)
ROLES = {2: "user", 3: "assistant"}
FAR = 1 << 60


@dataclass(frozen=True)
class RepairParams:
    #: rows searched at once
    window: int = 2048


def _edits(code: int, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, next state) of the edits that use up a row."""
    yield DELETE, "D", state
    if code < GONE:
        late = TRUNCATED if code & CUT else 0
        for after in FOLLOWS[state]:
            if after == code & 3:
                yield late, "K", after
            if after in ROLES:
                yield REROLE + late, "R", after


def _behind(codes: bytes, costs: list[int]) -> list[int]:
    """Least cost to the end from each state before codes, given those behind them; insertions lead, none trail."""
    for code in reversed(codes):
        now = [min(cost + costs[after] for cost, _, after in _edits(code, s)) for s in range(4)]
        for _ in range(2):  # more than two insertions in a row never pay
            now = [min(now[s], *(INSERT + now[t] for t in FOLLOWS[s] if t in ROLES)) for s in range(4)]
        costs = now
    return costs


def _search(codes: bytes, state: int, costs: list[int], last: bool) -> tuple[int, str, int]:
    """A*: (cost with what lies behind, audit, state) of the cheapest way through codes; trailing insertions if last."""
    ahead = [0] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if codes[i] >= GONE else TRUNCATED if codes[i] & CUT else 0)
    least = min(costs)
    queue, closed = [(ahead[0] + least, "", 0, state, 0)], set()
    while True:
        _, audit, i, s, cost = heappop(queue)
        if i > len(codes):
            return cost, audit, s
        if (i, s) in closed:
            continue
        closed.add((i, s))
        if i == len(codes):
            if costs[s] < FAR:
                heappush(queue, (cost + costs[s], audit, i + 1, s, cost + costs[s]))
            if not last:
                continue
        else:
            for more, initial, after in _edits(codes[i], s):
                heappush(queue, (cost + more + ahead[i + 1] + least, audit + initial, i + 1, after, cost + more))
        for after in FOLLOWS[s]:
            if after in ROLES:
                heappush(queue, (cost + INSERT + ahead[i] + least, audit + "I", i, after, cost + INSERT))


def repair(codes: bytes, window: int = RepairParams.window) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows with these codes."""
    goal = [0 if s in GOALS else FAR for s in range(4)]
    parts = [codes[i : i + window] for i in range(0, len(codes), window)] or [b""]
    # with nothing left, an open s or u is closed by insertions
    done = [0, 2 * INSERT, INSERT, 0]
    behind = [done]
    for part in parts[:0:-1]:
        behind.append(_behind(part, behind[-1]))
    total, state, audits = 0, 0, []
    for part in parts:
        costs = behind.pop()
        last = not behind
        cost, audit, state = _search(part, state, goal if last else costs, last)
        total += cost - (0 if last else costs[state])
        audits.append(audit)
    return total, "".join(audits)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage, by crc32(conv_id:turn) % 20: dropped, emptied, cut, repeated, made the user's, or left."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _code(role: Column, blank: Column, truncated: Column) -> Column:
    initial = F.lit(0)
    for letter, n in INITIAL.items():
        initial = F.when(F.substring(role, 1, 1) == letter, n).otherwise(initial)
    return initial + F.when(blank, GONE).when(truncated, CUT).otherwise(0)


def _light(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, code, n, first): the distinct rows of each conversation, with their number.

    first tells whether no earlier row has the role and text. A conversation without rows keeps one row with n = 0.
    """
    end = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACE}*\z", 1)
    there = F.col("copies") > 0
    of = lambda c: F.when(there, c)
    key = rows.select(
        "conv_id",
        of(F.col("turn")).alias("turn"),
        of(F.col("role")).alias("role"),
        of(F.unhex(F.sha2("text", 256))).alias("digest"),
        of(_code(F.col("role"), end == "", ~end.isin(".", "!", "?")).cast("byte")).alias("code"),
        F.col("copies").cast("long").alias("n"),
    )
    distinct = key.groupBy("conv_id", "turn", "role", "digest", "code").agg(F.sum("n").alias("n"))
    said = distinct.where("n > 0").groupBy("conv_id", "role", "digest")
    said = said.agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("__first"))
    said = said.where("__n > 1").select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"), "__first")
    met = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d"))
    first = F.col("__first").isNull() | F.struct(F.col("turn").isNotNull(), "turn").eqNullSafe(F.col("__first"))
    return distinct.join(said, met, "left").select(*distinct.columns, first.alias("first"))


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ORDER = ("conv_id", "last", "turn", "role", "digest", "kind")


class _Conversation:
    """What one conversation's stream adds up to: a byte a row, and counts."""

    def __init__(self):
        self.codes, self.sizes = bytearray(), []
        self.turns: list = [None, None, 0]
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = self.turn = None

    def add(self, turn, code: int, n: int, first: bool) -> None:
        initial = code & 3
        for before, after, times in ((self.before, initial, 1), (initial, initial, n - 1)):
            if before is not None and (before, after) not in ((1, 2), (2, 3), (3, 2)):
                self.illegal += times
        self.before = initial
        if turn is not None and turn != self.turn:
            low, _, count = self.turns
            self.turns, self.turn = [turn if low is None else low, turn, count + 1], turn
        if code >= GONE:
            self.blank += n
            self.codes += bytes([code]) * n
        else:
            kept = int(first)
            self.duplicate += n - kept
            self.truncated += kept if code & CUT else 0
            self.codes += bytes([code]) * kept + bytes([initial + GONE]) * (n - kept)
        self.sizes.append(n)

    def result(self, window: int) -> tuple[dict, str, list[str]]:
        """Counts, audit, and the audit's share of each distinct row; insertions go with the row they precede."""
        cost, audit = repair(bytes(self.codes), window)
        low, high, count = self.turns
        gaps = high - low + 1 - count if count else 0
        shares, at = [], 0
        for size in self.sizes:
            start = at
            while size:
                size -= audit[at] != "I"
                at += 1
            shares.append(audit[start:at])
        if shares:
            shares[-1] += audit[at:]
        told = dict(zip(STATS, (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)))
        return told, audit, shares


#: The rows that pass the second stream: kind 0 edits of the text behind them, 1 a text, 2 a conversation's counts.
_PLAN = [("last", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("kind", pa.int32()), ("said", pa.string())]


def _plans(light: DataFrame, window: int) -> DataFrame:
    conv_id = light.schema["conv_id"].dataType.simpleString()
    stats = ", ".join(f"{s} long" for s in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, keys = None, None, []

        def rows(batch_schema) -> Iterator[pa.RecordBatch]:
            told, audit, shares = now.result(window)
            schema = pa.schema([batch_schema.field("conv_id"), *_PLAN, *((s, pa.int64()) for s in STATS)])
            step = 10_000
            for i in range(0, len(keys), step):
                part = [dict(conv_id=of, last=False, turn=t, role=r, digest=d, kind=0, said=s) for (t, r, d), s in zip(keys[i : i + step], shares[i : i + step])]
                yield pa.RecordBatch.from_pylist(part, schema)
            yield pa.RecordBatch.from_pylist([dict(conv_id=of, last=True, kind=2, said=audit, **told)], schema)

        for b in batches:
            for c, turn, role, digest, code, n, first in zip(*(b.column(b.schema.get_field_index(f)).to_pylist() for f in ("conv_id", "turn", "role", "digest", "code", "n", "first"))):
                if now is None or c != of:
                    if now is not None:
                        yield from rows(b.schema)
                    now, of, keys = _Conversation(), c, []
                if n:
                    now.add(turn, code, n, first)
                    keys.append((turn, role, digest))
        if now is not None:
            yield from rows(b.schema)

    sorted_ = light.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    plan = "last boolean, turn long, role string, digest binary, kind int, said string"
    return sorted_.mapInArrow(run, f"conv_id {conv_id}, {plan}, {stats}")


def _hashed(stream: DataFrame) -> DataFrame:
    """One row a conversation, from edits, texts and counts in order."""
    conv_id = stream.schema["conv_id"].dataType.simpleString()
    stats = ", ".join(f"{s} long" for s in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, started, state, edits, turns = hashlib.sha256(), False, 0, "", 0

        def out(role: str, text: str) -> None:
            nonlocal started, state, turns
            total.update((("\n" if started else "") + role + ":" + text).encode())
            started, turns = True, turns + 1
            state = INITIAL[role[0]]

        for b in batches:
            done = []
            kinds, roles, said = (b.column(b.schema.get_field_index(f)).to_pylist() for f in ("kind", "role", "said"))
            for i, (kind, role, text) in enumerate(zip(kinds, roles, said)):
                if kind == 0:
                    edits = text
                elif kind == 1:  # further copies of the text find no edits left
                    for e in edits:
                        given = "assistant" if state == 2 else "user"
                        if e == "K":
                            out(role, text)
                        elif e != "D":
                            out(given, text if e == "R" else "")
                    edits = ""
                else:
                    done.append((i, total.hexdigest(), turns))
                    total, started, state, turns = hashlib.sha256(), False, 0, 0
            if done:
                rows = b.take(pa.array([i for i, _, _ in done]))
                kept = [rows.column(rows.schema.get_field_index(f)) for f in ("conv_id", *STATS, "said")]
                new = [pa.array([h for _, h, _ in done]), pa.array([n for _, _, n in done], pa.int64())]
                yield pa.RecordBatch.from_arrays(kept + new, ["conv_id", *STATS, "audit", "repaired_sha256", "repaired_turns"])

    return stream.mapInArrow(run, f"conv_id {conv_id}, {stats}, audit string, repaired_sha256 string, repaired_turns long")


def repair_conversations(rows: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired_turns.

    rows has conv_id, turn, role, text and copies, the number of times a row stands (0: its conversation alone is known).
    """
    rows = rows.withColumn("turn", F.col("turn").cast("long"))
    plans = _plans(_light(rows), params.window)
    texts = rows.where("copies > 0").select(
        "conv_id", F.lit(False).alias("last"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).alias("kind"), F.col("text").alias("said")
    )
    stream = plans.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*ORDER)
    return _hashed(stream)
