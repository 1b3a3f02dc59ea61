"""Conversation structure repair: each distinct signature of roles and faults is solved once, and its edits are replayed.

A conversation's rows, in order of turn (nulls first), role and MD5 of the text, become characters of a signature: the
role's initial (s, u, a or another) and the row's first fault, of blank, duplicate (role and text seen earlier) and truncated
(the last character that isn't white space is none of ``.!?``). Signatures are cut into parts of ``PART`` rows at most, so a
conversation may hold any share of the rows until its edits are joined.

Every distinct part is solved by memoised recursion over (row, state, inserts just made): for each state before it (nothing
yet, after system, after user, after assistant) and each state after it the cheapest edits, of these the ASCII-least. Two
different edit strings of a part never begin with each other, as inserts stand before a row and each row has one other
letter; so strings are compared within the part where they differ, and parts are chained with a cost and a rank a state.

Edits: K keep (0), R rerole to user or assistant (1), D delete (2; blank and duplicate rows must go), I insert an empty user
or assistant row (5); a truncated row that stays costs 5 more. Role initials of what is left match ``(s?(ua)+)?``.

A conversation's edits are one string, a byte a row, and its repaired rows are replayed in order by one task, row by row.

Defined cases: null roles and texts are one space; null turns come first; a null conversation id is a conversation of its
own; rows of the same turn follow role and MD5; equal rows are duplicates of the first of them; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_package

PART = 128
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a kept row of an initial leads from a state, and the state that a new or re-roled row leads to.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What it costs to end in a state, and the inserts for it.
END = ((0, ""), (10, "II"), (5, "I"), (0, ""))
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
ORDER = ["turn", "role", "digest", "rid"]
#: Signature characters: sound rows by initial, truncated ones in upper case, rows that must go by their initial's number.
SOUND, CUT, GONE = "suax", "SUAX", "1234"
LEGAL = ("su", "ua", "au")
PARTS = "conv string, turn long, role string, digest string, rid long, signature string"
SOLVED = "signature string, illegal long, costs array<long>, audits array<string>"
AUDITS = "conv string, illegal long, cost long, audit string"
REPAIRED = "conv string, place long, edit string, turn long, role string, text string"


def prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest)"""
    given = rows.select(F.col(f"`{conv}`").cast("string").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *(F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    return given.withColumn("digest", F.md5("text"))


def flagged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, rid, fault) of prepared rows; texts stay where they are. Written, so ``rid`` is settled."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    last = F.substring(trimmed, -1, 1)
    fault = F.when(trimmed == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    light = materialise(rows.select("conv", "turn", "role", "digest", F.monotonically_increasing_id().alias("rid"), fault.alias("fault")), "repair-rows")
    same = light.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.count("*").alias("n"), F.min(F.struct("turn", "rid")).alias("first")).where("n > 1")
    met = light.join(same, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("first").isNotNull() & (F.col("first.rid") != F.col("rid"))
    return met.select("conv", *ORDER, F.when(F.col("fault") == "blank", "blank").when(again, "duplicate").otherwise(F.col("fault")).alias("fault"))


def counts(flags: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated)"""
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    return flags.groupBy("conv").agg(gaps.alias("gaps"), *(F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")))


def mark() -> Column:
    """The signature's character of a row."""
    at = F.coalesce(F.nullif(F.instr(F.lit(SOUND[:3]), F.substring("role", 1, 1)), F.lit(0)), F.lit(4))
    at = F.when(F.col("role") == "", 4).otherwise(at)
    letters = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE)).when(F.col("fault") == "truncated", F.lit(CUT)).otherwise(F.lit(SOUND))
    return F.substring(letters, at, F.lit(1))


def parts(flags: DataFrame) -> DataFrame:
    """(conv, the order of the part's first row, signature): neighbouring rows of a conversation, ``PART`` of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, marks, done = None, [], []
        for batch in batches:
            for *at, letter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head is None or at[0] != head[0] or len(marks) == PART:
                    if head:
                        done.append((*head, "".join(marks)))
                    head, marks = at, []
                marks.append(letter)
            if done:
                yield batch_of(done, PARTS)
                done = []
        if head:
            yield batch_of([(*head, "".join(marks))], PARTS)

    dealt = flags.select("conv", *ORDER, mark().alias("letter"))
    return dealt.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER).mapInArrow(run, PARTS)


_ARROW = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(values), _ARROW[kind]) for values, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def solve(signature: str) -> list[list[tuple[int, str] | None]]:
    """By state before and after a part: the least cost and its ASCII-least edits, None where there are none."""

    @cache
    def best(i: int, state: int, inserted: int) -> tuple:
        if i == len(signature):  # inserts stand before a row, or at the conversation's end
            return tuple((0, "") if after == state and not inserted else None for after in STATES)
        letter = signature[i]
        ways = [("D", 0, best(i + 1, state, 0))]
        if letter not in GONE:
            extra = TRUNCATED if letter in CUT else 0
            kept = KEEP[state].get(letter.lower())
            if kept is not None:
                ways.append(("K", extra, best(i + 1, kept, 0)))
            ways.append(("R", extra, best(i + 1, NEXT[state], 0)))
        if inserted < 2:  # a third one would lead back to where the first one was made
            ways.append(("I", 0, best(i, NEXT[state], inserted + 1)))
        return tuple(min(((COST[edit] + extra + rest[after][0], edit + rest[after][1]) for edit, extra, rest in ways if rest[after]), default=None) for after in STATES)

    return [list(best(0, state, 0)) for state in STATES]


def initials(signature: str) -> str:
    return signature.lower().translate(str.maketrans(GONE, SOUND))


def illegal_pairs(letters: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False))


def solved(cut: DataFrame) -> DataFrame:
    """Each distinct signature with its illegal neighbours, costs and edits, by 4 * state before + state after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for signature in batch.column(0).to_pylist():
                table = [x for row in solve(signature) for x in row]
                rows.append((signature, illegal_pairs(initials(signature)), [x and x[0] for x in table], [x and x[1] for x in table]))
            if rows:
                yield batch_of(rows, SOLVED)

    return cut.select("signature").distinct().mapInArrow(run, SOLVED)


class Chain:
    """The parts of one conversation, taken in order: a cost, a rank and the edits so far for each state."""

    def __init__(self) -> None:
        self.states = {START: (0, 0, None)}
        self.illegal, self.last = 0, ""

    def add(self, signature: str, illegal: int, costs: list[int | None], audits: list[str | None]) -> None:
        found = {}
        for after in STATES:
            ways = [(cost + costs[4 * s + after], rank, audits[4 * s + after], s) for s, (cost, rank, _) in self.states.items() if costs[4 * s + after] is not None]
            if ways:
                found[after] = min(ways)
        order = sorted(found, key=lambda after: found[after][1:3])
        self.states = {after: (found[after][0], order.index(after), (self.states[found[after][3]][2], found[after][2])) for after in found}
        letters = initials(signature)
        self.illegal += illegal + (self.last != "" and self.last + letters[0] not in LEGAL)
        self.last = letters[-1]

    def result(self) -> tuple[int, int, str]:
        cost, _, state = min((cost + END[s][0], rank, s) for s, (cost, rank, _) in self.states.items())
        pieces, link = [END[state][1]], self.states[state][2]
        while link:
            link, piece = link
            pieces.append(piece)
        return self.illegal, cost, "".join(reversed(pieces))


def audits(cut: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit) from the parts and the solved signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chain = None, None
        for batch in batches:
            rows = []
            for of, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chain is None or of != conv:
                    if chain:
                        rows.append((conv, *chain.result()))
                    conv, chain = of, Chain()
                chain.add(*part)
            if rows:
                yield batch_of(rows, AUDITS)
        if chain:
            yield batch_of([(conv, *chain.result())], AUDITS)

    met = cut.join(answers, "signature").repartition("conv").sortWithinPartitions("conv", *ORDER)
    return met.select("conv", "signature", "illegal", "costs", "audits").mapInArrow(run, AUDITS)


def replay(edits: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(place, edit, turn, role, text) that the edits leave of rows (turn, role, text)."""
    state, place = START, 0
    for edit in edits:
        turn, role, text = (None, "", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = KEEP[state][role[0]] if edit == "K" else NEXT[state]
        yield place, edit, turn, role if edit == "K" else ROLE[state], text
        place += 1


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, place, edit, turn, role, text): prepared rows after their conversations' edits. All rows of a conversation
    follow each other in one partition, in order of ``place``; without a conversation's edits its rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        done, size, stream = [], 0, every()
        row = next(stream, None)
        while row:
            conv, audit = row[0], row[1]
            row = next(stream, None)

            def own() -> Iterator[tuple]:
                nonlocal row
                while row and row[0] == conv and row[1] is None:
                    current, row = row, next(stream, None)
                    yield current[2:]

            if audit is None:
                continue
            for out in replay(audit, own()):
                done.append((conv, *out))
                size += len(out[-1]) + 64
                if size > 1 << 20:
                    yield batch_of(done, REPAIRED)
                    done, size = [], 0
        if done:
            yield batch_of(done, REPAIRED)

    texts = rows.select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "digest", F.lit(1).alias("kind"))
    heads = edits.select("conv", "audit", F.lit(0).alias("kind"))
    both = texts.unionByName(heads, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")
    return both.select("conv", "audit", "turn", "role", "text").mapInArrow(run, REPAIRED)


def repair(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired): by conversation its gaps, faults, illegal neighbours, cost and edits; and the repaired rows.

    Conversation ids are strings in both.
    """
    ship_package(rows.sparkSession)
    given = prepared(rows, conv, turn, role, text)
    flags = materialise(flagged(given), "repair-flags")
    cut = materialise(parts(flags), "repair-parts")
    edits = materialise(audits(cut, materialise(solved(cut), "repair-solved")), "repair-audits")
    report = counts(flags).withColumnRenamed("conv", "c").join(edits, F.col("c").eqNullSafe(F.col("conv"))).drop("c")
    return report, repaired(given, edits)
