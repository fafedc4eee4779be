"""Repairs the structure of conversations by weighted CYK parsing over intervals of their turns.

A sound conversation's role initials are ``(s?(ua)+)?``: nothing, or a system turn or none and then pairs of user and
assistant. The repair grammar in Chomsky normal form has a symbol ``X[p,q]`` for each pair of places in that pattern (see
``PLACES``): it derives the intervals of turns that lead, once edited, from p to q. Its rules are ``X[p,q] -> X[p,r] X[r,q]``
and, for a single turn, the edits

* Keep (cost 0, and 5 more for a truncated turn), Rerole to user or assistant (1, and 5 more for a truncated turn),
* Delete (2; the only edit for a blank or repeated turn), Insert an empty user or assistant turn beside it (5).

The cell of an interval holds, for each symbol, the least cost and, of its derivations, the one whose edits' initials come
first in ASCII order (``audit``). Single turns are closed under insertions. Intervals are combined bottom-up by length: two
neighbours of equal length become one as soon as both are there, and the rest is joined from the right at the end. One split
of an interval is enough, since its two parts may end at any place: derivations regroup freely. The least audit of a whole
is made of the least audits of its parts, since of two audits of an interval at one cost neither begins with the other.

A turn's first fault counts: blank (nothing but 0x20 and 0x09-0x0D), duplicate (same role and text as an earlier turn of the
conversation), truncated (its last other character is not one of ``.!?``).

Turns of a conversation are ordered by turn (nulls first), then role and text. Nulls in ``conv_id``, ``role`` and ``text`` are
allowed: a null role or text is one space, rows without a conversation are one conversation, listed as null. A role without
a first letter of s, u or a fits no place, so it is reroled or deleted. Repeated rows are duplicates. Other columns are
ignored; an empty table gives no rows.

Repeats are found by a window over (conversation, digest of role and text), so that a long conversation's copies of one turn
share a task, not all of its turns. The parse then streams a conversation's turns in order through one task. It holds one
cell for each power of two, whose audits have a letter per turn, but no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
PLACES = START, OPENED, ASKED, ANSWERED = range(4)
ENDS = (START, ANSWERED)
#: Where a turn leads, by its initial.
STEPS = {"s": {START: OPENED}, "u": {START: ASKED, OPENED: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
FINE, BLANK, DUPLICATE, CUT = range(4)  # a turn's first fault
_BLANKS = r"[\x20\x09-\x0D]"

Cell = dict[tuple[int, int], tuple[int, str]]


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: what a checksum of ``conv_id:turn`` does to each row, nulls as one space.

    Of twenty remainders 0 drops the row (no copies), 1 empties the text, 2 takes its ``.!?`` out, 3 repeats it, and 4 makes
    it a user's.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    harm = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"),
    )


def with_faults(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, fault)`` with one row per copy. A row without copies stays as one with a null fault, so
    that its conversation is not lost."""
    copies = turns.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    digest = F.sha2(F.concat(F.col("role"), F.lit("\n"), F.col("text")), 256)
    earlier = Window.partitionBy("conv_id", F.col("copies") > 0, digest).orderBy(F.col("turn").asc_nulls_first(), "_copy")
    end = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){_BLANKS}*\z", 1)
    fault = (
        F.when(F.col("copies") == 0, None)
        .when(end == "", BLANK)
        .when(F.row_number().over(earlier) > 1, DUPLICATE)
        .when(end.isin(".", "!", "?"), FINE)
        .otherwise(CUT)
    )
    return copies.select("conv_id", "turn", "role", "text", fault.alias("fault"))


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring intervals: every rule X[p,q] -> X[p,r] X[r,q], the least (cost, audit) of each symbol."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in PLACES:
            if (other := right.get((r, q))) is not None:
                made = (cost + other[0], audit + other[1])
                if (p, q) not in out or made < out[p, q]:
                    out[p, q] = made
    return out


def _inserted() -> Cell:
    """The closure of insertions beside no turn at all: the shortest way between two places."""
    none: Cell = {(p, p): (0, "") for p in PLACES}
    one: Cell = {(p, q): (INSERT, "I") for initial in "ua" for p, q in STEPS[initial].items()}
    closed = none
    while True:
        wider = {**combine(closed, one), **none}
        for symbol, cell in closed.items():
            wider[symbol] = min(cell, wider.get(symbol, cell))
        if wider == closed:
            return closed
        closed = wider


INSERTED = _inserted()


@lru_cache
def leaf(initial: str, fault: int) -> Cell:
    """The cell of one turn, insertions beside it included."""
    edits: Cell = {(p, p): (DELETE, "D") for p in PLACES}
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for letter in "ua":
            for step in STEPS[letter].items():
                edits[step] = (REROLE + more, "R")
        for step in STEPS.get(initial, {}).items():
            edits[step] = (KEEP + more, "K")
    return combine(combine(INSERTED, edits), INSERTED)


class Parse:
    """The cells of the turns so far: a stack of (length, cell), each longer than the next."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cell]] = []

    def add(self, initial: str, fault: int) -> None:
        self.spans.append((1, leaf(initial, fault)))
        while len(self.spans) > 1 and self.spans[-2][0] == self.spans[-1][0]:
            (n, left), (m, right) = self.spans[-2:]
            self.spans[-2:] = [(n + m, combine(left, right))]

    def best(self) -> tuple[int, str]:
        """Cost and audit of the cheapest repair; nothing costs nothing."""
        whole: Cell = INSERTED if not self.spans else self.spans[-1][1]
        for _, left in reversed(self.spans[:-1]):
            whole = combine(left, whole)
        return min(whole[START, end] for end in ENDS if (START, end) in whole)


_REPORT = {
    "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string",
}


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from turns sorted by conversation and place."""
    done: list[tuple] = []
    first, current = True, None

    def close() -> None:
        cost, audit = parse.best()
        gaps = turns[1] - turns[0] + 1 - distinct if turns else 0
        done.append((current, gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, cost, audit))

    def send() -> pa.RecordBatch:
        kinds = [pa.int64()] * (len(_REPORT)) + [pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)] if done else [pa.array([], k) for k in kinds]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *_REPORT])

    for batch in batches:
        for conv, turn, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault"))):
            if first or conv != current:
                if not first:
                    close()
                first, current = False, conv
                parse, faults, illegal, before, turns, distinct = Parse(), [0] * 4, 0, None, [], 0
            if fault is None:
                continue
            parse.add(role[:1], fault)
            faults[fault] += 1
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            if turn is not None:
                distinct += not turns or turn != turns[1]
                turns = [turns[0], turn] if turns else [turn, turn]
        if done:
            yield send()
    if not first:
        close()
        yield send()


def _in_order(rows: DataFrame, *first: Column) -> DataFrame:
    # Each conversation is in one partition, its turns in order.
    order = [F.col("conv_id"), *first, F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def parse(turns: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` for every conversation of ``with_faults``.

    ``gaps`` are the missing numbers between the least and the largest turn, ``illegal`` the neighbours whose initials are not
    su, ua or au, and ``audit`` has the initials of the edits in order.
    """
    ordered = _in_order(turns).select("conv_id", "turn", "role", "fault")
    return ordered.mapInArrow(_reports, "conv_id long, " + ", ".join(f"{n} {t}" for n, t in _REPORT.items()))


def edited(initials_and_rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of each turn that stays, from a conversation's rows and its audit."""
    place = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(initials_and_rows)
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if place == ASKED else "user"
        place = STEPS[role[:1]][place]
        yield edit, role, text


def _pairs(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Turns in order, each conversation opened by a row with its audit."""
    rows = turns.where("fault is not null").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    null = F.lit(None)
    heads = reports.select("conv_id", null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), "audit")
    return _in_order(rows.unionByName(heads), F.col("audit").isNull())


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, Iterator[tuple[str, str]]]]:
    """Each conversation with its audit and an iterator over its rows, which is used up before the next one comes."""
    cells = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))))
    head = next(cells, None)
    while head is not None:
        follower: list = [None]

        def own() -> Iterator[tuple[str, str]]:
            for row in cells:
                if row[1] is not None:
                    follower[0] = row
                    return
                yield row[2], row[3]

        rows = own()
        yield head[0], head[1], rows
        for _ in rows:  # none is left but where the caller stopped early
            pass
        head = follower[0]


def repaired(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the turns that ``parse`` leaves or inserts, numbered from 0.

    A conversation of which nothing is left has no rows.
    """
    names = ["conv_id", "place", "edit", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        held, size = [], 0
        for conv, audit, rows in _conversations(batches):
            for place, (edit, role, text) in enumerate(edited(rows, audit)):
                held.append((conv, place, edit, role, text))
                size += 64 + len(text)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return _pairs(turns, reports).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of every conversation: the repaired turns as ``role:text``, joined by line ends."""

    def run(batches):
        found = []
        for conv, audit, rows in _conversations(batches):
            digest, joint = hashlib.sha256(), ""
            for _, role, text in edited(rows, audit):
                digest.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            found.append((conv, digest.hexdigest()))
            if len(found) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])

    return _pairs(turns, reports).mapInArrow(run, "conv_id long, repaired_sha256 string")
