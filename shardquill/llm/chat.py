"""Chat formatting: a declarative template, a finite-state machine over roles, segments with loss flags, and a reader.

Rows are dealt by conversation, sorted by turn and streamed: a task holds one turn and one machine state at a time,
never a conversation. A digest over a whole conversation is sequential by its nature, so one conversation stays in one
task, which streams it in constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow


@dataclass(frozen=True)
class Template:
    """Markers, the roles that are trained on, and the machine: state -> role -> next state.

    Control strings (the markers and ``reserved``) begin with a character that appears nowhere else in any of them, and
    hold no backslash; so none can arise across the edge of an escaped text. Inside a text a backslash is doubled, and
    ``\\.`` follows the first character of each control string, which :meth:`unescape` takes back exactly.
    """

    open: str = "<|turn|>"
    role_end: str = "\n"
    close: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    machine: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        controls = (self.open, self.close, *self.reserved)
        firsts = {c[0] for c in controls}
        if any("\\" in c or firsts & set(c[1:]) for c in controls):
            raise ValueError("a control string's first character may appear nowhere else in one, and no backslash at all")

    def pattern(self) -> re.Pattern:
        return re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in (self.open, self.close, *self.reserved)))

    def escape(self, text: str, pattern: re.Pattern) -> str:
        return pattern.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\.", text)

    def escape_role(self, role: str, pattern: re.Pattern) -> str:
        return self.escape(role, pattern).replace(self.role_end, "\\n")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: {".": "", "n": self.role_end}.get(m[1], m[1]), text, flags=re.S)


SEGMENTS = "conv_id bigint, seq bigint, segment string, loss boolean, state string"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, status string"


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Three segments a turn (head, text, end), in order within each partition, with a loss flag and the machine's state.

    Turns are taken by turn number, then role and text; null roles and texts count as empty, null turns come first and
    null conv_ids are one conversation; repeated rows are turns of their own. ``state`` is ``invalid`` from the first
    role that the machine does not allow in its state on; such conversations are formatted nevertheless. An empty table
    gives no segments.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, last, state, seq = template.pattern(), object(), template.start, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != last:
                    last, state, seq = conv, template.start, 0
                state = template.machine.get(state, {}).get(role, "invalid")
                head = template.open + template.escape_role(role, pattern) + template.role_end
                for segment, loss in ((head, False), (template.escape(text, pattern), role in template.loss_roles), (template.close, False)):
                    for column, value in zip(out, (conv, seq, segment, loss, state), strict=True):
                        column.append(value)
                    seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["conv_id", "seq", "segment", "loss", "state"])

    return map_arrow(rows, run, SEGMENTS)


def read_back(formatted: DataFrame, template: Template = Template(), in_order: bool = False) -> DataFrame:
    """Turns recovered from the segments' text alone, as digests for each conversation.

    The markers are parsed out of the concatenated text; only the loss flags are taken from beside it. ``status`` is
    ``ok``, ``incomplete`` (ends in a state that does not accept) or ``invalid``. ``in_order``: the segments come
    straight from :func:`segments`, so each partition holds whole conversations in order.
    """
    rows = formatted.select("conv_id", "seq", "segment", "loss", "state")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = None, object()
        for batch in batches:
            done = []
            for conv, _, segment, loss, state in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if reader is None or conv != last:
                    done += [reader.result()] if reader else []
                    reader, last = _Reader(conv, template), conv
                reader.take(segment, loss, state)
            yield _results(done)
        yield _results([reader.result()] if reader else [])

    return map_arrow(rows, run, READ)


class _Reader:
    def __init__(self, conv, template: Template):
        self.conv, self.template, self.buffer, self.state = conv, template, "", ""
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def take(self, segment: str, loss: bool, state: str) -> None:
        t = self.template
        self.chars += len(segment)
        self.state = state
        self.buffer += segment
        if loss:
            text = t.unescape(segment)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        if segment != t.close:
            return
        while (end := self.buffer.find(t.close)) >= 0:
            turn, self.buffer = self.buffer[:end], self.buffer[end + len(t.close) :]
            if not turn.startswith(t.open):
                raise ValueError(f"conversation {self.conv}: a turn without its mark")
            role, _, body = turn[len(t.open) :].partition(t.role_end)
            self.turns.update(f"{t.unescape(role)}\n{t.unescape(body)}\n".encode())
            self.n += 1

    def result(self) -> tuple:
        status = "invalid" if self.state == "invalid" else "ok" if self.state in self.template.accepting else "incomplete"
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, status


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
