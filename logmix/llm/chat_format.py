"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags.

A template names each role's marks and whether its text is learned, and which role may follow which. Conversations are
dealt by id and sorted by turn, so a task streams through them with one state each: memory does not follow the length of a
conversation, of which one may hold a third of all rows. Every turn becomes a list of segments ``(text, loss)``; a
conversation's formatted text is its segments end to end. Segments under the loss mask hold the text of the turn alone.

Control strings inside texts are escaped: a backslash doubles, and ``\\.`` parts a control string after its first
character, so no text can look like a mark, and unescaping gives the text back.

Rows without an order (equal turns, repeated rows) are sorted by role and text and are turns of their own; a null turn comes
first. A null text or role is empty. Turns out of order and unknown roles are formatted too, with ``valid`` false, so no
text is lost. Rows without an id make one conversation. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    before: str
    after: str
    loss: bool = False


def _roles() -> dict[str, Marks]:
    return {
        "system": Marks("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Marks("[INST] ", " [/INST]"),
        "assistant": Marks(" ", " </s>", loss=True),
    }


def _order() -> dict[str, tuple[str, ...]]:
    return {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@dataclass(frozen=True)
class Template:
    opening: str = "<s>"
    roles: Mapping[str, Marks] = field(default_factory=_roles)
    #: An unknown role is written between these, before its text and ``other_after``.
    other_before: tuple[str, str] = ("<<ROLE ", ">> ")
    other_after: str = " <</ROLE>>"
    #: From the role before ("" at the start) to those that may follow.
    order: Mapping[str, tuple[str, ...]] = field(default_factory=_order)


# What the marks above are made of: the first character, and the rest that makes it a control string.
CONTROL = r"(<)(/?s>|</?SYS>>|<ROLE |</ROLE>>)|(\[)(/?INST\])"
_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\3\\.\2\4", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def write_turn(template: Template, state: str, role: str, text: str, first: bool) -> tuple[bool, list[tuple[str, bool]]]:
    """Whether the turn may follow ``state``, and its segments."""
    valid = role in template.order.get(state, ()) and role in template.roles
    marks = template.roles.get(role)
    if marks is None:
        a, b = template.other_before
        # No ">>" may be left in the name, since that ends it.
        marks = Marks(a + escape(role).replace(">", ">\\.") + b, template.other_after)
    before = (template.opening if first else "") + marks.before
    return valid, [(before, False), (escape(text), marks.loss), (marks.after, False)]


def read_turn(template: Template, piece: str, first: bool) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if first:
        if not piece.startswith(template.opening):
            raise ValueError("a conversation must begin with the opening mark")
        piece = piece[len(template.opening) :]
    a, b = template.other_before
    if piece.startswith(a):
        role, _, rest = piece[len(a) :].partition(b)
        return unescape(role), unescape(rest[: len(rest) - len(template.other_after)])
    # Longer marks first: a blank alone is also a mark.
    for role, marks in sorted(template.roles.items(), key=lambda x: -len(x[1].before)):
        if piece.startswith(marks.before) and piece.endswith(marks.after):
            return role, unescape(piece[len(marks.before) : len(piece) - len(marks.after)])
    raise ValueError(f"no mark of the template at {piece[:40]!r}")


_SEGMENTS = "array<struct<text: string, loss: boolean>>"
_ARROW_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, position, valid, segments)``: one row per row of ``rows`` (conv_id, turn, role, text)."""
    dealt = (
        rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches):
        current, state, position = object(), "", 0
        for batch in batches:
            valid, segments, positions = [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != current:
                    current, state, position = conv, "", 0
                good, made = write_turn(template, state, role, text, position == 0)
                valid.append(good)
                segments.append([{"text": t, "loss": x} for t, x in made])
                positions.append(position)
                state, position = role, position + 1
            columns = [batch.column("conv_id"), pa.array(positions, pa.int64()), pa.array(valid, pa.bool_()), pa.array(segments, _ARROW_SEGMENTS)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "position", "valid", "segments"])

    return dealt.mapInArrow(run, f"conv_id long, position long, valid boolean, segments {_SEGMENTS}")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


class _Digest:
    """What is known of one conversation while its turns pass by."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid = True

    def add(self, template: Template, valid: bool, segments: list[dict]) -> None:
        piece = "".join(s["text"] for s in segments)
        role, text = read_turn(template, piece, self.n == 0)
        self.turns.update(f"{role}\n{text}\n".encode())
        for s in segments:
            if s["loss"]:
                learned = unescape(s["text"])
                self.loss_chars += len(learned)
                self.loss.update(learned.encode())
        self.n, self.chars, self.valid = self.n + 1, self.chars + len(piece), self.valid and valid

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from the segments alone: turns, their digest, what is learned, the length."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    names = [part.split(" ")[0] for part in _DIGEST.split(", ")]

    def run(batches):
        current = None
        for batch in batches:
            done = []
            for conv, valid, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "valid", "segments")), strict=True):
                if current is None or conv != current.conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv)
                current.add(template, valid, segments)
            if done:
                yield _table(done, names)
        if current is not None:
            yield _table([current.row()], names)

    return dealt.mapInArrow(run, _DIGEST)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names)
