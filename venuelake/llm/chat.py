r"""Chat formatting in budgeted windows.

A conversation's turns, in order of ``turn``, fill windows of up to BUDGET tokens, repeated turns included: a turn
that no longer fits opens the next window, so windows begin and end with turns and no turn is ever cut. A window
repeats the system turn, if the conversation opens with one, and up to HISTORY turns before its own, the latest
first, as far as they fit beside its first turn; repeated turns have their own mark and are masked, so each assistant
text is a target exactly once. Only a turn of over BUDGET tokens makes a larger window: it
stands there alone, after the system turn if that one is within BUDGET.

    <|turn|>role<|body|>text<|end|>     a turn of this window
    <|seen|>role<|body|>text<|end|>     a repeated turn

Roles and texts are escaped: a backslash is doubled, and one is put into each control string (this template's and
other common ones) after its first character; unescaping is exact.

The rows of a conversation are streamed in order, and only the system turn, the history and the open window are
held, so memory doesn't grow with a conversation. It is still one task for each conversation, as the digests of its
whole text are sequential. Null roles and texts are empty; null turns come first; ties are ordered by role and
text; repeated rows are turns of their own; rows with a null conv_id are a conversation. conv_id may be of any type
that can be ordered. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

BUDGET, HISTORY = 512, 2
#: Tokens that the marks of a turn count for.
MARKS = 4
_CONTROL = re.compile(r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
_TURNS = re.compile(r"<\|(turn|seen)\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def tokens_of(text: str) -> int:
    return len(text.split()) + MARKS


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """The Arrow type of conv_id, and the columns of each row."""
    for batch in batches:
        yield from zip(itertools.repeat(batch.schema.field("conv_id").type), *(batch.column(c).to_pylist() for c in columns))


class _Open:
    """The window that is being filled."""

    def __init__(self, number: int, repeated: list[tuple[str, str, int]]):
        self.number, self.parts, self.size, self.loss, self.tokens = number, [], 0, [], 0
        for role, text, tokens in repeated:
            self.put("seen", role, text, tokens)

    def put(self, mark: str, role: str, text: str, tokens: int) -> None:
        self.tokens += tokens
        head = f"<|{mark}|>{escape(role)}<|body|>"
        body = escape(text)
        if mark == "turn" and role == "assistant":
            at = self.size + len(head)
            self.loss.append({"start": at, "end": at + len(body)})
        self.parts.append(f"{head}{body}<|end|>")
        self.size += len(self.parts[-1])


def _repeated(system: tuple[str, str, int] | None, recent: deque[tuple[str, str, int]], room: int) -> list[tuple[str, str, int]]:
    """The system turn and the latest turns that fit into ``room`` tokens, in order."""
    first = [system] if system and system[2] <= room else []
    room -= sum(x[2] for x in first)
    found: list[tuple[str, str, int]] = []
    for x in reversed(recent):
        if x[2] > room:
            break
        room -= x[2]
        found.insert(0, x)
    return first + found


def _format(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    conv = object()
    window: _Open | None = None
    system: tuple[str, str, int] | None = None
    recent: deque[tuple[str, str, int]] = deque(maxlen=history)

    def emit() -> pa.RecordBatch:
        ids, numbers, texts, losses = zip(*rows)
        loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array(numbers, pa.int64()), pa.array(texts, pa.large_string()).cast(pa.string()), pa.array(losses, loss)],
            names=["conv_id", "window", "formatted", "loss"],
        )

    for kind, c, role, text in _grouped(batches, ("conv_id", "role", "text")):
        role, text = role or "", text or ""
        tokens = tokens_of(text)
        if c != conv or window is None:
            if window is not None:
                rows.append((conv, window.number, "".join(window.parts), window.loss))
                held += window.size
            conv, window = c, _Open(0, [])
            system = (role, text, tokens) if role == "system" else None
            recent.clear()
            first = True
        else:
            first = False
            if window.tokens + tokens > budget:
                rows.append((conv, window.number, "".join(window.parts), window.loss))
                held += window.size
                window = _Open(window.number + 1, _repeated(system, recent, budget - tokens) if tokens <= budget else _repeated(system, deque(), budget))
        if len(rows) >= 500 or held > 4 << 20:
            if rows:
                yield emit()
            rows, held = [], 0
        window.put("turn", role, text, tokens)
        if not (first and system):
            recent.append((role, text, tokens))
    if window is not None:
        rows.append((conv, window.number, "".join(window.parts), window.loss))
    if rows:
        yield emit()


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), formatted, loss (spans of code points)."""
    ship_package(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(
        lambda it: _format(it, budget, history),
        f"conv_id {dict(turns.dtypes)['conv_id']}, window long, formatted string, loss array<struct<start:long,end:long>>",
    )


def parse(formatted: str) -> list[tuple[bool, str, str]]:
    """(repeated, role, text) of the turns in a window."""
    return [(mark == "seen", unescape(role), unescape(text)) for mark, role, text in _TURNS.findall(formatted)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv = object()
    state: list = []

    def close() -> None:
        if state:
            n, turns, chars, loss, size = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def emit() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for kind, c, formatted, loss in _grouped(batches, ("conv_id", "formatted", "loss")):
        if c != conv or not state:
            close()
            conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if len(out) >= 5000:
                yield emit()
                out = []
        for repeated, role, text in parse(formatted):
            if not repeated:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
        for span in loss:
            target = unescape(formatted[span["start"] : span["end"]])
            state[2] += len(target)
            state[3].update(target.encode())
        state[4] += len(formatted)
    close()
    if out:
        yield emit()


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the rows that ``windows`` gave, in any order: turns, targets, size."""
    rows = formatted.select("conv_id", "window", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(
        _digest, f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
