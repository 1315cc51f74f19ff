"""Chat formatting with budgeted windows.

A turn is written as a header line, its text and an end mark.  Control strings are escaped inside texts by one backslash before
every `\\`, `<` and `#` that could begin one, so that formatting is reversible for any text: no header or end mark can arise
from a text.  Prefix sums of the turns' token counts cut a conversation into windows of at most BUDGET tokens that begin and
end with whole turns: every window starts with the conversation's leading system turn, repeats at most HISTORY tokens of
turns before its own first turn, and masks the loss of what it repeats, so that each assistant text is a target exactly once.
A turn that alone exceeds the budget is a window by itself with the system turn: turns are never cut.

Conversations are formatted and read back as their sorted rows pass, so that one of any length takes the memory of a window.

Defined cases: null texts are empty; null roles are empty roles; turns go by turn number, equal ones by role and text; a
repeated row is one more turn; empty tables give no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.tokens import ByteEncoder

BUDGET, HISTORY = 512, 128
#: The public vocabulary whose tokens the budget counts.
VOCABULARY = "byte_bpe_50k.json"
#: Fixed parts of the template.
HEAD, CLOSE_HEAD, END = "### ", ": ", " </turn>\n"
_SPECIAL = re.compile(r"[\\<#]")
_ESCAPED = re.compile(r"\\([\\<#])")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """Roles stand in a header, in which a colon and a line end have a meaning as well."""
    return re.sub(r"[\\<#:\n]", lambda m: {"\n": "\\n", ":": "\\;"}.get(m[0], "\\" + m[0]), role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", ";": ":"}.get(m[1], m[1]), role)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as it is written, and the range of its escaped text."""
    head = HEAD + escape_role(role) + CLOSE_HEAD
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


_encoders: dict[str, ByteEncoder] = {}


def count_tokens(formatted: str, vocabulary: str = VOCABULARY) -> int:
    """The tokens of a formatted turn; turns end with a line end, which the tokenizer never joins to what follows."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = ByteEncoder(vocabulary)
    return _encoders[vocabulary].count(formatted)


class Formatter:
    """Windows of one conversation, made as its turns come; it holds no more than a window and the history before it."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY):
        self.budget, self.history = budget, history
        self.lead: Turn | None = None
        self.before: deque[Turn] = deque()  # turns that a window may repeat
        self.shown: list[Turn] = []
        self.own: list[Turn] = []
        self.first = True

    def _window(self) -> dict:
        written, spans, at = [], [], 0
        lead = [self.lead] if self.lead else []
        for k, turn in enumerate([*lead, *self.shown, *self.own]):
            if k >= len(lead) + len(self.shown) and turn.role == "assistant":
                spans.append((at + turn.start, at + turn.end))
            written.append(turn.text)
            at += len(turn.text)
        return {"text": "".join(written), "spans": spans, "system": bool(lead), "repeated": len(self.shown)}

    def push(self, role: str, text: str) -> list[dict]:
        """The windows that this turn closes."""
        turn = Turn.of(role, text)
        if self.first:
            self.first = False
            if role == "system":
                self.lead = turn
                return []
        room = self.budget - (self.lead.tokens if self.lead else 0)
        out = []
        if self.own and self._size() + turn.tokens > room:
            out.append(self._window())
            self.shown, self.own = list(self.before), []
        if not self.own:
            while self.shown and self._size() + turn.tokens > room:
                self.shown.pop(0)  # rather less history than none of its own turns
        self.own.append(turn)
        self.before.append(turn)
        self._held = sum(t.tokens for t in self.before) if len(self.before) == 1 else self._held + turn.tokens
        while self.before and self._held > self.history:
            self._held -= self.before.popleft().tokens
        return out

    def _size(self) -> int:
        return sum(t.tokens for t in self.shown) + sum(t.tokens for t in self.own)

    def finish(self) -> list[dict]:
        """The last window; a conversation of its system turn alone is one window as well."""
        return [self._window()] if self.own or self.lead else []


class Turn(NamedTuple):
    role: str
    text: str
    start: int
    end: int
    tokens: int

    @classmethod
    def of(cls, role: str, text: str) -> Turn:
        written, start, end = format_turn(role, text)
        return cls(role, written, start, end, count_tokens(written))


def format_conversation(roles: list[str], texts: list[str], budget: int = BUDGET, history: int = HISTORY) -> list[dict]:
    """The windows of a conversation: text, the ranges under the loss mask and the number of repeated turns."""
    formatter = Formatter(budget, history)
    out = [w for r, t in zip(roles, texts, strict=True) for w in formatter.push(r, t)]
    return out + formatter.finish()


_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*): ((?:[^\\<#]|\\[\\<#])*) </turn>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a window, read back."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    return out


def read_window(window: dict, first: bool) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns that a window has of its own (all, if it is the first), and the texts under its loss mask."""
    found = read_turns(window["text"])
    return found if first else found[window["system"] + window["repeated"] :], [unescape(window["text"][a:b]) for a, b in window["spans"]]


def read_conversation(windows: list[dict]) -> tuple[list[tuple[str, str]], str]:
    """All turns of a conversation, each once, and the text under the loss mask."""
    turns, targets = [], []
    for k, window in enumerate(windows):
        own, loss = read_window(window, not k)
        turns += own
        targets += loss
    return turns, "".join(targets)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    """Whole conversations in a task, in order; sorting spills, and no task holds more than a batch of rows."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, spans, system, repeated): the formatted windows of all conversations."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "conv_id long, window int, text string, spans array<struct<a:int,b:int>>, system boolean, repeated int"
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.bool_(), pa.int32()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        formatter: Formatter | None = None
        made = 0
        out: list[tuple] = []

        def take(found: list[dict]) -> None:
            nonlocal made
            for w in found:
                out.append((current, made, w["text"], [{"a": a, "b": b} for a, b in w["spans"]], w["system"], w["repeated"]))
                made += 1

        def batch_of() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "window", "text", "spans", "system", "repeated"])
            out.clear()
            return got

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if formatter is None or conv != current:
                    if formatter is not None:
                        take(formatter.finish())
                    current, formatter, made = conv, Formatter(budget, history), 0
                take(formatter.push(role, text))
                if len(out) >= 500:
                    yield batch_of()
        if formatter is not None:
            take(formatter.finish())
        if out:
            yield batch_of()

    return _by_conversation(rows, "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(write, schema)


def digests(found: DataFrame, in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows), read back from windows.

    in_order: the windows come as windows() leaves them, a conversation's in one task and in their order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        state: list | None = None
        out: list[tuple] = []

        def close() -> None:
            if state is not None:
                turns, told, chars, loss, formatted, n = state
                out.append((current, turns, told.hexdigest(), chars, loss.hexdigest(), formatted, n))

        def batch_of() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c) if k != 0 else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])
            out.clear()
            return got

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != current:
                    close()
                    current, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                window = row | {"spans": [(s["a"], s["b"]) for s in row["spans"]]}
                turns, targets = read_window(window, not state[5])
                for role, text in turns:
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in targets:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[0] += len(turns)
                state[4] += len(row["text"])
                state[5] += 1
            if out:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    return (found if in_order else _by_conversation(found, "window")).mapInArrow(read, schema)
