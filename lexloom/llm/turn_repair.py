"""Conversation structure repair with one suffix-shared automaton over all conversations.

A conversation is a row of turns. Every row gets one letter: its role's initial and its first
fault. The letters of a conversation are its signature; all distinct signatures are put into
one suffix-shared graph, read from the end: signatures with equal endings share the nodes of
that ending. A node holds, for each state of the role grammar ``(s?(ua)+)?``, the cheapest cost
from there to the end and the first edit of the cheapest repair. Each node is worked out once,
however many conversations hold it. Nodes whose costs differ by a constant only are one class,
so there are a few dozen classes and the step from one class to the next is looked up.

Signatures are dealt by ranges of their reversed text and sorted, so a task walks its part of
the graph in order and keeps one path of it: memory is the longest signature, one byte and two
numbers a row. A node on the border of two ranges is worked out twice.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3, the only one for blank and
duplicate rows), Insert an empty user or assistant row (2); a truncated row that is not deleted
adds 1. Of repairs of equal cost the one whose initials are ASCII-least is taken. Two edits that
compete in a state have different initials, so the first one decides.

Rows of one conversation are sorted by Spark and streamed: a conversation of any length spills
to disk and is never held whole, but its rows go through one task, as its hash must.

Defined cases: null role or text is one blank; rows are ordered by turn (nulls first), then
role, then text; repeated rows are rows, all but the first are duplicates; rows without a
conv_id are one conversation; an initial other than s, u and a (or none) can only be reroled or
deleted; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm import arrays as ar

#: Grammar states: nothing yet, after s, after u, after a. Only the first and the last may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STEP = (USER, USER, ASSISTANT, USER)
KEEPS = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60

#: White space as the contracts name it.
BLANKS = " \t\n\x0b\x0c\r"
#: Letters: initial (o: any other) times fault (none, truncated, duplicate, blank).
INITIALS, FAULTS = "suao", ("", "truncated", "duplicate", "blank")
_LETTERS = "suaoSUAOdddddddd"
#: Signatures that a task hands on at a time.
ROWS_OUT = 2048


def ordered(rows: DataFrame) -> DataFrame:
    """c, at (from 1), t, r, x and kind of every row; kind is initial + 4 * fault."""
    slim = rows.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.coalesce("role", F.lit(" ")).alias("r"), F.coalesce("text", F.lit(" ")).alias("x")
    ).repartition("c")
    same = Window.partitionBy("c", "r", "x").orderBy(F.col("t").asc_nulls_first())
    place = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "r", "x")
    bare = F.rtrim(F.col("x"), F.lit(BLANKS))
    fault = F.when(bare == "", 3).when(F.col("nth") > 1, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.substring("r", 1, 1)
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    seen = slim.withColumn("nth", F.row_number().over(same))
    return seen.select("c", F.row_number().over(place).alias("at"), "t", "r", "x", (first + 4 * fault).alias("kind"))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Pieces of batches that belong to one conversation, each with a mark where one begins.

    A conversation begins at its row numbered 1.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column("at").to_numpy()
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(at == 1), [len(at)]])).tolist()
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(low, high - low), at[low] == 1


class _Facts:
    """Counts and signature of one conversation, filled piece by piece."""

    def __init__(self, c):
        self.c, self.letters, self.kinds, self.turns, self.pairs = c, [], np.zeros(16, np.int64), [None, None, 0], np.zeros((4, 4), np.int64)
        self.last_turn = self.last_kind = None

    def add(self, kind: np.ndarray, turn: np.ndarray) -> None:
        self.kinds += np.bincount(kind, minlength=16)
        self.letters.append(_LETTER_CODES[kind].tobytes())
        initial = kind % 4
        before = initial if self.last_kind is None else np.concatenate([[self.last_kind], initial])
        np.add.at(self.pairs, (before[:-1], before[1:]), 1)
        self.last_kind = initial[-1]
        if len(turn):
            low, high, n = self.turns
            n += int((turn[1:] != turn[:-1]).sum()) + (turn[0] != self.last_turn)
            self.turns = [int(turn[0]) if low is None else low, int(turn[-1]), n]
            self.last_turn = turn[-1]

    def row(self) -> tuple:
        low, high, n = self.turns
        legal = self.pairs[0, 1] + self.pairs[1, 2] + self.pairs[2, 1]
        faults = self.kinds.reshape(4, 4).sum(axis=1).tolist()
        gaps = 0 if low is None else high - low + 1 - int(n)
        return (self.c, b"".join(self.letters).decode(), gaps, faults[3], faults[2], faults[1], int(self.pairs.sum() - legal))


_LETTER_CODES = np.frombuffer(_LETTERS.encode(), np.uint8)
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def signatures(placed: DataFrame) -> DataFrame:
    """Signature and counts of every conversation of ``ordered`` rows."""
    kind = placed.schema["c"].dataType.simpleString()
    names = ["c", "signature", *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for part, begins in _by_conversation(batches):
            if begins:
                if now:
                    done.append(now.row())
                now = _Facts(part.column("c")[0].as_py())
            now.add(part.column("kind").to_numpy(), part.column("t").drop_null().to_numpy())
            if len(done) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(zip(*done), types)], names)
                done = []
        done += [now.row()] if now else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(zip(*done), types)], names)

    types = [_arrow(placed, "c"), pa.string(), *[pa.int64()] * 5]
    slim = placed.select("c", "at", F.col("t").cast("long").alias("t"), F.col("kind")).repartition("c").sortWithinPartitions("c", "at")
    return slim.mapInArrow(run, f"c {kind}, signature string, " + ", ".join(f"{n} long" for n in _COUNTS))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


class Automaton:
    """Classes of nodes by their costs-to-go, and the steps between them."""

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}

    @staticmethod
    def _settled(direct: list[tuple[int, str]]) -> tuple[tuple[int, ...], str]:
        """Costs and first edits of the four states once inserts are weighed against ``direct``."""
        got = list(direct)
        for state in (USER, ASSISTANT):
            got[state] = min(direct[state], (direct[STEP[state]][0] + INSERT, "I"))
        for state in (EMPTY, SYSTEM):
            got[state] = min(direct[state], (got[USER][0] + INSERT, "I"))
        return tuple(c for c, _ in got), "".join(e for _, e in got)

    def end(self) -> tuple[tuple[int, ...], str]:
        return self._settled([(0, "."), (NEVER, "."), (NEVER, "."), (0, ".")])

    def before(self, costs: tuple[int, ...], letter: str) -> tuple[tuple[int, ...], int, str]:
        """Costs above the least one, that least one, and first edits of the node before ``costs``."""
        got = self.steps.get((costs, letter))
        if got is None:
            late = TRUNCATED if letter.isupper() else 0
            direct = []
            for state in range(4):
                choices = [(DELETE + costs[state], "D")]
                if letter != "d":
                    choices.append((REROLE + late + costs[STEP[state]], "R"))
                    if state in KEEPS[letter.lower()]:
                        choices.append((late + costs[KEEPS[letter.lower()][state]], "K"))
                direct.append(min(choices))
            found, edits = self._settled(direct)
            least = min(found)
            got = self.steps[costs, letter] = tuple(c - least for c in found), least, edits
        return got


class Path:
    """The path of one reversed signature through the graph; the next one reuses what it shares."""

    def __init__(self):
        self.automaton = Automaton()
        costs, edits = self.automaton.end()
        self.text, self.nodes, self.sums = "", [(costs, edits)], array("q", [0])
        self.built = 0

    def move(self, text: str) -> None:
        """Go to the node of ``text`` (a reversed signature)."""
        low, high = 0, min(len(text), len(self.text))
        while low < high:  # longest common beginning
            mid = (low + high + 1) // 2
            low, high = (mid, high) if text[low:mid] == self.text[low:mid] else (low, mid - 1)
        del self.nodes[low + 1:], self.sums[low + 1:]
        for letter in text[low:]:
            costs, least, edits = self.automaton.before(self.nodes[-1][0], letter)
            self.nodes.append((costs, edits))
            self.sums.append(self.sums[-1] + least)
            self.built += 1
        self.text = text

    def best(self) -> tuple[int, str]:
        """Cost and edit initials of the cheapest repair from the last node reached."""
        at, state, out = len(self.nodes) - 1, EMPTY, []
        cost = self.sums[at] + self.nodes[at][0][state]
        while True:
            edit = self.nodes[at][1][state]
            if edit == ".":
                return cost, "".join(out)
            out.append(edit)
            if edit != "D":
                state = KEEPS[self.text[at - 1].lower()][state] if edit == "K" else STEP[state]
            at -= edit != "I"


def audits(found: DataFrame) -> DataFrame:
    """signature, cost and audit of every distinct signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()
        for batch in batches:
            texts, costs, edits = batch.column("reversed").to_pylist(), [], []
            for text in texts:
                path.move(text)
                cost, audit = path.best()
                costs.append(cost)
                edits.append(audit)
            yield pa.RecordBatch.from_arrays([pa.array([t[::-1] for t in texts], pa.string()), pa.array(costs, pa.int64()), pa.array(edits, pa.string())], ["signature", "cost", "audit"])

    distinct = found.select(F.reverse("signature").alias("reversed")).distinct()
    return distinct.repartitionByRange("reversed").sortWithinPartitions("reversed").mapInArrow(run, "signature string, cost long, audit string")


class _Walk:
    """Applies one audit to the rows of its conversation as they come."""

    def __init__(self, audit: str, out):
        self.audit, self.at, self.turn, self.out = audit, 0, 0, out

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put("I", ("user", "assistant")[self.turn], "")

    def _put(self, edit: str, role: str, text: str) -> None:
        self.out(edit, role, text)
        self.turn = {"u": 1, "a": 0, "s": 0}[role[0]]
        self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
        else:
            self._put(edit, role if edit == "K" else ("user", "assistant")[self.turn], text)

    def end(self) -> None:
        self._inserts()


def _joined(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """Ordered rows by conversation; the first one carries the audit."""
    plans = facts.select(F.col("c").alias("c_"), "audit")
    both = placed.join(plans, placed["c"].eqNullSafe(plans["c_"]))
    slim = both.select("c", "at", "r", "x", F.when(F.col("at") == 1, F.col("audit")).alias("audit"))
    return slim.repartition("c").sortWithinPartitions("c", "at")


def facts_of(placed: DataFrame) -> DataFrame:
    """c, counts, cost and audit of every conversation of ``ordered`` rows; written, as it is read again."""
    found = session.save(signatures(placed), "signatures")
    plans = session.save(audits(found), "audits")
    return session.save(found.join(plans, "signature").drop("signature"), "repairs")


def repaired(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of every repaired conversation: c, seq (from 0), edit (K, R or I), role, text."""
    kind = _arrow(placed, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        walk, c, seq = None, None, 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal seq
            rows.append((c, seq, edit, role, text))
            seq += 1

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                types = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["c", "seq", "edit", "role", "text"])
                rows.clear()

        for part, begins in _by_conversation(batches):
            if begins:
                if walk:
                    walk.end()
                c, seq = part.column("c")[0].as_py(), 0
                walk = _Walk(part.column("audit")[0].as_py(), put)
            for role, text in zip(part.column("r").to_pylist(), part.column("x").to_pylist()):
                walk.row(role, text)
            yield from out()
        if walk:
            walk.end()
        yield from out()

    ar.small_batches(placed.sparkSession)
    return _joined(placed, facts).mapInArrow(run, f"c {placed.schema['c'].dataType.simpleString()}, seq long, edit string, role string, text string")


def digests(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """c and the SHA-256 of the repaired rows, ``role:text`` joined by newlines; texts are streamed through the hash."""
    kind = _arrow(placed, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        walk, c, sha, empty = None, None, None, True

        def put(edit: str, role: str, text: str) -> None:
            nonlocal empty
            sha.update(b"" if empty else b"\n")
            sha.update(f"{role}:{text}".encode())
            empty = False

        def out() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), (kind, pa.string()))], ["c", "sha256"])
                done.clear()

        for part, begins in _by_conversation(batches):
            if begins:
                if walk:
                    walk.end()
                    done.append((c, sha.hexdigest()))
                c, sha, empty = part.column("c")[0].as_py(), hashlib.sha256(), True
                walk = _Walk(part.column("audit")[0].as_py(), put)
            for role, text in zip(part.column("r").to_pylist(), part.column("x").to_pylist()):
                walk.row(role, text)
            if len(done) >= ROWS_OUT:
                yield from out()
        if walk:
            walk.end()
            done.append((c, sha.hexdigest()))
        yield from out()

    ar.small_batches(placed.sparkSession)
    return _joined(placed, facts).mapInArrow(run, f"c {placed.schema['c'].dataType.simpleString()}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as a fixed rule spoils them by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's.
    """
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    by = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    kept = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), by.alias("by")).where("by <> 0")
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("by") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("by") == 3, 2).otherwise(1))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")
