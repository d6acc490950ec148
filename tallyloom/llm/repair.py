"""Structure repair of conversations: the cheapest edits that make the roles alternate.

A conversation is well formed if its roles' initials are ``s?(ua)+`` or nothing. Edits, in
ASCII order of their letters: D deletes a row (4; the only way for blank and duplicate
rows), I inserts an empty user or assistant row (3), K keeps a row, R gives a row the other
legal role (3); a row that ends without ``.!?`` and is not deleted adds 3.

Iterative-deepening A*: a depth-first search tries edits in ASCII order within a bound of
the cost; the bound is what the first failure says is least. States (rows consumed, role
expected) that failed are kept in a transposition table with the cost that their best
continuation still needs at least, and are not entered again below it. The bound never
passes the optimum, so the first path that is accepted is the cheapest one and, of those,
the ASCII-least.

On Spark: equal rows of a conversation are one row with a count; whether a row repeats an
earlier one is a minimum per (conversation, role, text), joined back with the turn in the
key. A range sort brings a conversation's rows together without one task per conversation.
A task cuts its sorted rows at conversations and at ``ROWS`` rows or ``CHARACTERS``.
Conversations that begin and end inside a task are done there. Of the others every stretch is searched from
each role state to each, side by side. Stretches then meet by conversation, sorted, and are
passed through one at a time: backwards four costs are carried, forwards one state and a running hash.
Two choices of edits for a stretch never are one another's prefix (the last edit takes the
last row), so the least stretch by stretch is the least as a whole.

Cases: a NULL conv_id, turn, role or text counts as one space; rows without a turn come
first; rows of one turn come in the order of role, then text. A conversation without rows
after damage has zeros and an empty audit. A role whose first letter is none of s, u, a (also an empty
role) is never kept. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyloom.llm.tables import partitions
from tallyloom.session import cut_lineage

#: Rows and characters of one stretch of a conversation.
ROWS, CHARACTERS = 64, 1 << 20
#: Conversations' patterns whose repair a worker remembers.
REMEMBERED = 1 << 15

DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_ENDLESS = 1 << 60

# States: nothing yet; after s; after u; after a. What is expected next, and the state after it.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_ROLE = {"u": "user", "a": "assistant"}
_NEXT = {START: ("u", AFTER_U), AFTER_S: ("u", AFTER_U), AFTER_U: ("a", AFTER_A), AFTER_A: ("u", AFTER_U)}
_ACCEPTED = (START, AFTER_A)
_NOT_SPACE = re.compile(r"[^ \t-\r]")


class Step(NamedTuple):
    """One row of the search: its role's initial, its fault, and how many further copies must go."""

    initial: str
    fault: int
    copies: int = 0


def kept_state(state: int, initial: str) -> int | None:
    """The state after keeping a row, or None where its role may not stand."""
    if initial == "s":
        return AFTER_S if state == START else None
    expected, after = _NEXT[state]
    return after if initial == expected else None


class Search:
    """Cheapest edits of rows from any state, to one state or, with ``goal`` None, to an accepted one."""

    def __init__(self, steps: tuple[Step, ...], goal: int | None):
        self.steps, self.goal = steps, goal
        forced = [
            DELETE * s.copies + (DELETE if s.fault in (BLANK, DUPLICATE) else min(DELETE, CUT_OFF) if s.fault == TRUNCATED else 0)
            for s in steps
        ]
        #: What rows from each place on cost whatever is chosen.
        self.ahead = [0] * (len(steps) + 1)
        for at in range(len(steps) - 1, -1, -1):
            self.ahead[at] = self.ahead[at + 1] + forced[at]
        #: Failed states: the cost that an accepting continuation has at least.
        self.failed: dict[tuple[int, int], int] = {}

    def least(self, at: int, state: int) -> int:
        return self.failed.get((at, state), self.ahead[at])

    def _done(self, at: int, state: int) -> bool:
        if at < len(self.steps):
            return False
        return state in _ACCEPTED if self.goal is None else state == self.goal

    def _edits(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, place, state) in ASCII order. After the last row only a whole conversation inserts."""
        more = at < len(self.steps)
        expected, after = _NEXT[state]
        if more:
            step = self.steps[at]
            extra = DELETE * step.copies
            yield "D", DELETE + extra, at + 1, state
        if more or self.goal is None:
            yield "I", INSERT, at, after
        if more and step.fault not in (BLANK, DUPLICATE):
            extra += CUT_OFF if step.fault == TRUNCATED else 0
            kept = kept_state(state, step.initial)
            if kept is not None:
                yield "K", extra, at + 1, kept
            yield "R", REROLE + extra, at + 1, after

    def run(self, state: int) -> tuple[int, str] | None:
        """(cost, letters), copies' deletions included; None if no edits lead to the goal."""
        if self.goal is not None and not _reachable(state, self.goal, self.steps):
            return None
        while True:
            bound = self.least(0, state)
            path = self._within(state, bound)
            if path is not None:
                return bound, path

    def _within(self, state: int, bound: int) -> str | None:
        """The ASCII-least path of at most ``bound``; raises the failed states' costs otherwise."""
        # Of each open state: its place and state, the cost left, its edits, and the least a failed edit needs.
        letters: list[str] = []
        stack = [[0, state, bound, self._edits(0, state), _ENDLESS]]
        if self._done(0, state):
            return ""
        while stack:
            top = stack[-1]
            at, now, left = top[:3]
            for letter, cost, place, after in top[3]:
                need = cost + self.least(place, after)
                if need > left:
                    top[4] = min(top[4], need)
                    continue
                letters.append(letter + "D" * self.steps[at].copies if place > at else letter)
                if self._done(place, after):
                    return "".join(letters)
                stack.append([place, after, left - cost, self._edits(place, after), _ENDLESS])
                break
            else:
                self.failed[at, now] = max(self.least(at, now), top[4], left + 1)
                stack.pop()
                if stack:
                    letters.pop()
                    above = stack[-1]
                    above[4] = min(above[4], above[2] - left + self.failed[at, now])
        return None


def _reachable(state: int, goal: int, steps: tuple[Step, ...]) -> bool:
    """Whether some edits of the rows lead from state to goal at all."""
    if goal == START:
        return state == START
    if goal == AFTER_S:
        keeps_s = any(s.initial == "s" and s.fault not in (BLANK, DUPLICATE) for s in steps)
        return state == AFTER_S or (state == START and keeps_s)
    return True


@lru_cache(maxsize=REMEMBERED)
def repair(steps: tuple[Step, ...]) -> tuple[int, str]:
    """Cost and letters of a whole conversation's cheapest edits."""
    return Search(steps, None).run(START)


def repaired_rows(letters: str, rows: list[tuple[str, str, int]], state: int = START) -> tuple[list[str], int]:
    """``role:text`` of the rows (role, text, copies) after the edits, and the state they end in."""
    out, at = [], iter(rows)
    skip = 0
    for letter in letters:
        expected, after = _NEXT[state]
        if letter == "I":
            out.append(f"{_ROLE[expected]}:")
            state = after
        elif skip:
            skip -= 1
        else:
            role, text, skip = next(at)
            if letter == "K":
                state = kept_state(state, role[:1])
                out.append(f"{role}:{text}")
            elif letter == "R":
                out.append(f"{_ROLE[expected]}:{text}")
                state = after
    return out, state


def fault_of(text: str, repeats: bool) -> int:
    last = _NOT_SPACE.search(text[::-1])
    if last is None:
        return BLANK
    if repeats:
        return DUPLICATE
    return FINE if last.group() in ".!?" else TRUNCATED


# Damage


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations with their planted faults; 0 copies of dropped rows."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


# Stretches of sorted rows


_PIECE = (
    "conv_id long, piece long, whole boolean, blank long, duplicate long, truncated long, illegal long, "
    "first_turn long, last_turn long, turns long, cost long, audit string, digest string, "
    "first_initial string, last_initial string, costs array<long>, ranks array<int>, audits array<string>, "
    "roles array<string>, texts array<string>, copies array<long>"
)
_PIECE_NAMES = [c.split(" ")[0] for c in _PIECE.split(", ")]


class _Stretch:
    """Rows of one conversation in order; so many of them at most, and one beyond so many characters."""

    def __init__(self, conv_id: int | None, first: bool, most_rows: int, most_characters: int):
        self.conv_id, self.first = conv_id, first
        self.most_rows, self.most_characters = most_rows, most_characters
        self.rows: list[tuple[str, str, int]] = []
        self.steps: list[Step] = []
        self.turns: list[int | None] = []
        self.characters = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, repeats: bool) -> None:
        self.rows.append((role, text, copies - 1))
        self.steps.append(Step(role[:1], fault_of(text, repeats), copies - 1))
        self.turns.append(turn)
        self.characters += len(text)

    def full(self) -> bool:
        return len(self.rows) >= self.most_rows or self.characters >= self.most_characters

    def row(self, piece: int, whole: bool) -> dict:
        out = dict.fromkeys(_PIECE_NAMES)
        steps = tuple(self.steps)
        initials = [i for s in steps for i in (s.initial,) * min(2, s.copies + 1)]
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t in self.turns if t is not None]
        # A copy has its row's fault if that is blank, and repeats it otherwise.
        count = lambda fault: sum(s.fault == fault for s in steps)
        copies = lambda blank: sum(s.copies for s in steps if (s.fault == BLANK) == blank)
        out |= {
            "conv_id": self.conv_id,
            "piece": piece,
            "whole": whole,
            "blank": count(BLANK) + copies(True),
            "duplicate": count(DUPLICATE) + copies(False),
            "truncated": count(TRUNCATED),
            "illegal": pairs + sum(max(0, s.copies - 1) for s in steps),
            "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None,
            "turns": len(set(turns)),
        }
        if whole:
            cost, letters = repair(steps)
            lines, _ = repaired_rows(letters, self.rows)
            return out | {"cost": cost, "audit": letters, "digest": _sha256("\n".join(lines))}
        costs, audits = [], []
        for goal in range(4):
            search = Search(steps, goal)
            for state in range(4):
                found = search.run(state)
                costs.append(_ENDLESS if found is None else found[0])
                audits.append(None if found is None else found[1])
        by_state = lambda x: [x[4 * goal + state] for state in range(4) for goal in range(4)]
        costs, audits = by_state(costs), by_state(audits)
        # The place of each goal's letters among those from the same state.
        ranks = [sum(o is not None and a is not None and o < a for o in audits[k - k % 4 : k - k % 4 + 4]) for k, a in enumerate(audits)]
        return out | {
            "first_initial": initials[0],
            "last_initial": initials[-1],
            "costs": costs,
            "ranks": ranks,
            "audits": audits,
            "roles": [r for r, _, _ in self.rows],
            "texts": [t for _, t, _ in self.rows],
            "copies": [c for _, _, c in self.rows],
        }


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _pieces(ordered: DataFrame, most_rows: int, most_characters: int) -> DataFrame:
    """Rows sorted by conversation, cut into stretches; ``piece`` grows with the order."""
    schema = _arrow_schema(_PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 40, 0
        now: _Stretch | None = None
        first_of_task = True
        out: list[dict] = []
        size = 0
        for batch in batches:
            columns = ("conv_id", "turn", "role", "text", "copies", "repeats")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for conv_id, turn, role, text, copies, repeats in zip(*(part.column(c).to_pylist() for c in columns)):
                    other = now is not None and conv_id != now.conv_id
                    if now is not None and (other or now.full()):
                        # Rows before the task's first or after its last conversation may be elsewhere.
                        size += now.characters
                        out.append(now.row(base + made, whole=other and now.first and not first_of_task))
                        made += 1
                        first_of_task = first_of_task and not other
                        now = _Stretch(conv_id, other, most_rows, most_characters)
                        if len(out) >= 256 or size >= CHARACTERS:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                    if now is None:
                        now = _Stretch(conv_id, True, most_rows, most_characters)
                    now.add(turn, role, text, copies, repeats)
        if now is not None:
            out.append(now.row(base + made, whole=False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(cut, _PIECE)


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


# Conversations in several stretches


def _plans(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, goals): of each stretch, the state to end in for each state to start in."""

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conversation, ahead = False, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for conv_id, piece, costs, ranks in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "costs", "ranks"))):
                if not started or conv_id != conversation:
                    # After the last row: what is inserted until the roles are complete.
                    started, conversation, ahead = True, conv_id, [0, 2 * INSERT, INSERT, 0]
                goals = [min(range(4), key=lambda g: (costs[4 * s + g] + ahead[g], ranks[4 * s + g])) for s in range(4)]
                ahead = [min(_ENDLESS, costs[4 * s + g] + ahead[g]) for s, g in enumerate(goals)]
                rows.append((conv_id, piece, goals))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                names=["conv_id", "piece", "goals"],
            )

    return (
        pieces.select("conv_id", "piece", "costs", "ranks")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("piece").desc())
        .mapInArrow(backwards, "conv_id long, piece long, goals array<int>")
    )


_RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


class _Joined:
    """A conversation whose stretches pass one after the other."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state = conv_id, START
        self.totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0)
        self.first_turn = self.last_turn = self.last_initial = None
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def _hash(self, lines: list[str]) -> None:
        for line in lines:
            self.hash.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
            self.lines += 1

    def add(self, row: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            self.totals[name] += row[name]
        if self.last_initial is not None and self.last_initial + row["first_initial"] not in ("su", "ua", "au"):
            self.totals["illegal"] += 1
        self.last_initial = row["last_initial"]
        if row["first_turn"] is not None:
            self.totals["turns"] -= row["first_turn"] == self.last_turn
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]
        goal = row["goals"][self.state]
        letters = row["audits"][4 * self.state + goal]
        self.totals["cost"] += row["costs"][4 * self.state + goal]
        lines, self.state = repaired_rows(letters, list(zip(row["roles"], row["texts"], row["copies"])), self.state)
        self.audit.append(letters)
        self._hash(lines)

    def result(self) -> dict:
        while self.state not in _ACCEPTED:
            expected, self.state = _NEXT[self.state]
            self.totals["cost"] += INSERT
            self.audit.append("I")
            self._hash([f"{_ROLE[expected]}:"])
        turns = self.totals.pop("turns")
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - turns
        return self.totals | {
            "conv_id": self.conv_id,
            "gaps": gaps,
            "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


def _joined(pieces: DataFrame) -> DataFrame:
    """Results of conversations in several stretches; a task holds one stretch at a time."""
    schema = _arrow_schema(_RESULT)

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                if now is None or row["conv_id"] != now.conv_id:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([now.result()], schema=schema)
                    now = _Joined(row["conv_id"])
                now.add(row)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], schema=schema)

    # NULL-safe: conversations without an id are one.
    plans = _plans(pieces).select(F.col("conv_id").alias("planned"), F.col("piece").alias("of_piece"), "goals")
    return (
        pieces.join(plans, (F.col("piece") == F.col("of_piece")) & F.col("conv_id").eqNullSafe(F.col("planned")))
        .drop("planned", "of_piece")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "piece")
        .mapInArrow(forwards, _RESULT)
    )


def repair_conversations(rows: DataFrame, most_rows: int = ROWS, most_characters: int = CHARACTERS) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows, one row per conversation.

    ``rows`` has conv_id, turn, role, text and copies (how often the row stands there, one
    beside the other; 0: not at all, but the conversation counts). Returns conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Conversations are
    cut at ``most_rows`` rows or ``most_characters``; results do not depend on the cuts.
    """
    spark = rows.sparkSession
    known = rows.select("conv_id").distinct()
    shown = lambda c: F.coalesce(F.col(c), F.lit(" "))
    # Plain equalities, so that the fold's partitioning serves the join: NULLs are told by a flag.
    keys = ["no_conv", "conv", "has_turn", "in_turn", "role", "digest"]
    keyed = rows.filter(F.col("copies") > 0).select(
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).alias("in_turn"),
        shown("role").alias("role"),
        F.unhex(F.sha2(shown("text"), 256)).alias("digest"),
        shown("text").alias("text"),
        "copies",
    )
    distinct = keyed.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    # The earliest row of each text in a conversation, found without the texts; one without a turn
    # comes first. The turn is in the join's key, so a text that very many rows share is spread.
    least = F.min(F.struct("has_turn", "in_turn")).alias("least")
    firsts = (
        keyed.groupBy("no_conv", "conv", "role", "digest")
        .agg(least)
        .select("no_conv", "conv", "least.has_turn", "least.in_turn", "role", "digest", F.lit(True).alias("first"))
    )
    marked = distinct.join(firsts, keys, "left").select(
        F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"),
        F.when(F.col("has_turn"), F.col("in_turn")).alias("turn"),
        "role",
        "text",
        "copies",
        F.col("first").isNull().alias("repeats"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ordered = marked.repartitionByRange(partitions(spark), *order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    pieces = cut_lineage(_pieces(ordered, most_rows, most_characters))
    whole = pieces.filter("whole").select(
        "conv_id",
        F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        "audit",
        F.col("digest").alias("repaired_sha256"),
    )
    found = whole.unionByName(_joined(pieces.filter(~F.col("whole"))))
    zero = F.lit(0).cast("long")
    result = found.withColumnRenamed("conv_id", "c")
    return known.join(result, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id",
        *(F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_sha256(""))).alias("repaired_sha256"),
    )


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Repairs of the damaged conversations (conv_id, turn, role, text)."""
    return repair_conversations(damaged(conversations))
