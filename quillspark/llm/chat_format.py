"""Chat formatting from a declarative template.

A finite-state machine over roles checks the order of turns. Each turn becomes three text segments: a control string
that opens it, its escaped text, and a control string that closes it; only texts of trained roles carry loss. Segments
of a conversation joined in order are the formatted text, from which ``Reader`` gives the turns back.

Escaping puts a backslash before every backslash and inside every control string of a text, after its first
character, so that no control string is left in it; dropping one backslash from each such place undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._rows import batches_of, rows


@dataclass(frozen=True)
class Template:
    """Markers by role, marker pair of any other role (its name goes between the first two), trained roles, and the
    machine: for each state (the last role, or start) the roles that may follow, and the states that may be last."""

    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "tool": ("<tool>", "</tool>")})
    other: tuple[str, str, str] = ("<|", "|>", "<|/|>")
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    last: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({*self.other, *(m for pair in self.markers.values() for m in pair)}, key=lambda c: (-len(c), c))


class Writer:
    def __init__(self, template: Template):
        self.template = template
        self.inside = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls))

    def escape(self, text: str) -> str:
        return self.inside.sub(lambda m: m[0] + "\\", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, carries loss) of one turn."""
        if role in self.template.markers:
            opens, closes = self.template.markers[role]
        else:
            opens, closes = self.template.other[0] + self.escape(role) + self.template.other[1], self.template.other[2]
        return [(opens, False), (self.escape(text), role in self.template.trained), (closes, False)]


def unescape(text: str) -> str:
    """Of two backslashes one stays, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


class Reader:
    """Turns of formatted text, as it comes."""

    def __init__(self, template: Template):
        self.template, self.rest = template, ""
        self.role_of = {opens: role for role, (opens, _) in template.markers.items()}

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while (turn := self._take()) is not None:
            yield turn

    def _take(self) -> tuple[str, str] | None:
        for opens, role in self.role_of.items():
            if self.rest.startswith(opens):
                return self._until(len(opens), self.template.markers[role][1], role)
        opens, middle, closes = self.template.other
        if self.rest.startswith(opens) and (at := self.rest.find(middle, len(opens))) >= 0:
            return self._until(at + len(middle), closes, unescape(self.rest[len(opens) : at]))
        return None

    def _until(self, start: int, closes: str, role: str) -> tuple[str, str] | None:
        end = self.rest.find(closes, start)
        if end < 0:
            return None
        text, self.rest = self.rest[start:end], self.rest[end + len(closes) :]
        return role, unescape(text)


SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("seg_no", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("start", pa.int64()), ("in_order", pa.bool_()), ("may_end", pa.bool_())]
)
DDL = "conv_id long, seg_no long, turn_no long, role string, text string, loss boolean, start long, in_order boolean, may_end boolean"


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations, each conversation's in order and in one partition.

    Takes ``conv_id, turn, role, text``. Turns sort by turn, then role, then text, nulls first, so ties and repeated
    rows have one order and all stay. Null roles and texts are empty; null ids are one conversation of their own.
    ``in_order`` tells whether the machine has accepted all roles so far, ``may_end`` whether it could stop there;
    a conversation out of order is formatted all the same. Segments stream: no conversation is held whole, whatever its
    turns; it is written by one task, as its digests need its turns in order. Other columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(template)

        def out():
            conv, first = None, True
            for now, _, role, text in rows(batches):
                if first or now != conv:
                    conv, first, state, ok, seg, turn, start = now, False, "start", True, 0, 0, 0
                role, text = role or "", text or ""
                ok, state = ok and role in template.follows.get(state, ()), role
                for part, loss in writer.segments(role, text):
                    yield conv, seg, turn, role, part, loss, start, ok, ok and state in template.last
                    seg, start = seg + 1, start + len(part)
                turn += 1

        yield from batches_of(SEGMENTS, out())

    columns = ["conv_id", "turn", "role", "text"]
    sent = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return sent.repartition("conv_id").sortWithinPartitions(*columns).mapInArrow(run, DDL)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted text holds, for each conversation: counts and digests of the turns and of the text with loss.

    Takes the result of ``format_conversations`` as it comes: a conversation's segments in order in one partition.
    """
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            conv, state = None, None
            for now, text, loss, may_end in rows(batches):
                if state is None or now != conv:
                    if state is not None:
                        yield conv, *state.result()
                    conv, state = now, _Digest(template)
                state.add(text, loss, may_end)
            if state is not None:
                yield conv, *state.result()

        yield from batches_of(schema, out())

    return segments.select("conv_id", "text", "loss", "may_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


class _Digest:
    def __init__(self, template: Template):
        self.reader, self.turns, self.loss = Reader(template), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid = False

    def add(self, text: str, loss: bool, may_end: bool) -> None:
        self.chars, self.valid = self.chars + len(text), may_end
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8"))
        for role, plain in self.reader.feed(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{plain}\n".encode())

    def result(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid
