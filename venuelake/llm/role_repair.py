r"""Repair of conversation structure by error-correcting Earley parsing.

A conversation should read ``(system? (user assistant)+)?``. The parser knows rules for that and, beside each
terminal, error productions with a price: a row can be kept (0), given the role that is wanted (3) or deleted (4), and
a row without text can be inserted (3). Items of the chart keep the least (cost, audit), the audit being the initials
K, R, D, I of the edits in order; the completed chart yields the repair.

Rows are read from the last to the first, so an audit is one letter in front of another audit: ties are decided by the
first letter that differs, and items share what they have in common. The rules are left-recursive and rows are deleted
in front of terminals or at the end only, so all items begin in the first column and a row costs the same whatever the
length of the conversation.

Faults: a row without any character but ``[\x20\x09-\x0D]`` is blank, one whose role and text came before is a
duplicate, one that ends otherwise than in ``[.!?]`` is truncated; the first that holds counts. Blank rows and
duplicates have to go, truncated ones that stay cost 3 more.

Rows are sorted by turn (nulls first), ties by role and text. Null roles and texts are one space, and a role that does
not begin with s, u or a can't be kept. Rows with a null conv_id are one conversation. Other columns are not used.
A conversation is one task, as its digest is sequential. Its texts wait in a file beyond 4 MB; what grows in memory is
16 bytes of address and two bytes of code for each row, and the audits that are still alive.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship_package
from .bytesops import slices

#: Prices of the edits, and what a truncated row adds where it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Terminals that a row may be given or be inserted as.
MADE = "ua"
#: Rules for the rows from the last to the first: (assistant user)+ system?, or nothing.
GRAMMAR = {"talk": ((), ("pairs",), ("pairs", "s")), "pairs": (("a", "u"), ("pairs", "a", "u"))}
START = "talk"
SPACE = "\x20\t\n\x0b\f\r"
FINE, BLANK, DUPLICATE, CUT = range(4)
SPOOL_BYTES = 4 << 20


class Item(NamedTuple):
    left: str
    right: tuple[str, ...]
    dot: int
    origin: int


#: An audit is (letter, role it leaves or "", what follows), or None.
Audit = tuple | None


def letters(audit: Audit) -> Iterator[tuple[str, str]]:
    while audit is not None:
        yield audit[0], audit[1]
        audit = audit[2]


def before(a: Audit, b: Audit) -> bool:
    """Whether ``a`` comes before ``b`` in ASCII order of the letters."""
    while a is not b:
        if a is None or b is None:
            return a is None
        if a[0] != b[0]:
            return a[0] < b[0]
        a, b = a[2], b[2]
    return False


class Place:
    """The items of one place of the input with their least (cost, audit)."""

    def __init__(self) -> None:
        self.items: dict[Item, tuple[int, Audit]] = {}
        self.todo: list[Item] = []

    def add(self, item: Item, cost: int, audit: Audit) -> None:
        had = self.items.get(item)
        if had is None or cost < had[0] or (cost == had[0] and before(audit, had[1])):
            self.items[item] = (cost, audit)
            self.todo.append(item)


def _close(columns: dict[int, Place], at: int) -> None:
    """Predict, complete and insert until nothing in the column gets better."""
    column = columns[at]
    while column.todo:
        item = column.todo.pop()
        cost, audit = column.items[item]
        if item.dot == len(item.right):  # complete: whatever waited for this symbol where the item began goes on
            for other in list(columns[item.origin].items):
                if other.dot < len(other.right) and other.right[other.dot] == item.left:
                    # what the waiting item had cost is part of what began there
                    column.add(other._replace(dot=other.dot + 1), cost, audit)
            continue
        symbol = item.right[item.dot]
        if symbol in GRAMMAR:
            for right in GRAMMAR[symbol]:
                column.add(Item(symbol, right, 0, at), cost, audit)
        elif symbol in MADE:
            column.add(item._replace(dot=item.dot + 1), cost + INSERT, ("I", symbol, audit))


def parse(rows: bytes) -> tuple[int, Audit]:
    """(cost, audit) of the cheapest repair; ``rows`` has two bytes a row, in order: the role's initial and the fault."""
    columns = {0: Place()}
    for right in GRAMMAR[START]:
        columns[0].add(Item(START, right, 0, 0), 0, None)
    _close(columns, 0)
    n = len(rows) // 2
    for at in range(1, n + 1):
        initial, fault = chr(rows[2 * (n - at)]), rows[2 * (n - at) + 1]
        column, last = Place(), columns[at - 1]
        more = TRUNCATED if fault == CUT else 0
        for item, (cost, audit) in last.items.items():
            done = item.dot == len(item.right)
            symbol = None if done else item.right[item.dot]
            if symbol in GRAMMAR or (done and item.left != START):
                continue
            column.add(item, cost + DELETE, ("D", "", audit))
            if done or fault in (BLANK, DUPLICATE):
                continue
            after = item._replace(dot=item.dot + 1)
            if symbol == initial:
                column.add(after, cost + more, ("K", symbol, audit))
            elif symbol in MADE:
                column.add(after, cost + REROLE + more, ("R", symbol, audit))
        columns[at] = column
        # only columns in which something begins are looked at again
        if at > 1 and all(i.origin != at - 1 for i in last.items):
            del columns[at - 1]
        _close(columns, at)
    ends = [v for i, v in columns[n].items.items() if i.left == START and i.origin == 0 and i.dot == len(i.right)]
    best = ends[0]
    for end in ends[1:]:
        if end[0] < best[0] or (end[0] == best[0] and before(end[1], best[1])):
            best = end
    return best


@lru_cache(maxsize=4096)
def _short(rows: bytes) -> tuple[int, Audit]:
    return parse(rows)


class _Conversation:
    """What is known of the rows so far."""

    def __init__(self, key: int | None) -> None:
        self.key = key
        self.codes = bytearray()
        self.seen: set[bytes] = set()
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.illegal, self.faults = 0, [0, 0, 0, 0]
        self.texts = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and (self.turns == 0 or turn != self.last):
            self.turns, self.last = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        data = text.encode()
        address = hashlib.blake2b(len(role).to_bytes(4, "little") + role.encode() + data, digest_size=16).digest()
        bare = text.strip(SPACE)
        fault = BLANK if not bare else DUPLICATE if address in self.seen else CUT if bare[-1] not in ".!?" else FINE
        self.seen.add(address)
        self.faults[fault] += 1
        initial = role[:1] if role[:1] in ROLES else " "
        if self.codes and chr(self.codes[-2]) + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.codes += bytes((ord(initial), fault))
        whole = role.encode()
        self.texts.write(len(whole).to_bytes(4, "little") + whole + len(data).to_bytes(8, "little") + data)

    def result(self) -> tuple:
        rows = bytes(self.codes)
        cost, audit = _short(rows) if len(rows) <= 128 else parse(rows)
        digest, first, spelled = hashlib.sha256(), True, []
        self.texts.seek(0)
        for letter, symbol in letters(audit):
            spelled.append(letter)
            role, text = ROLES.get(symbol, "").encode(), b""
            if letter != "I":
                own = self.texts.read(int.from_bytes(self.texts.read(4), "little"))
                text = self.texts.read(int.from_bytes(self.texts.read(8), "little"))
                role = own if letter == "K" else role
            if letter != "D":
                digest.update((b"" if first else b"\n") + role + b":" + text)
                first = False
        self.texts.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults[1:], self.illegal, cost, "".join(spelled), digest.hexdigest())


_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repair_rows(batches: Iterable[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by conversation and turn; a row with ``there`` false only says that a conversation exists."""
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in _FIELDS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    current, out = None, []
    for batch in (part for whole in batches for part in slices(whole, "text")):
        for key, turn, role, text, there in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there"))):
            if current is None or key != current.key:
                if current is not None:
                    out.append(current.result())
                current = _Conversation(key)
            if there:
                current.row(turn, role, text)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
            out = []
    if current is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, current.result()))], schema)


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ``turns``(conv_id, turn, role, text), and for each conv_id of ``ids``.

    conv_id, gaps (turn numbers that are missing between the first and the last), blank, duplicate, truncated, illegal
    (neighbours that are not system user, user assistant or assistant user), cost, audit, repaired_sha256 (the rows
    ``role:text`` after the repair, joined by newlines). Conversations without rows have zeros and empty texts.
    """
    ship_package(turns.sparkSession)
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("there")
    )
    if ids is not None:
        none = ids.select("conv_id").distinct()
        rows = rows.unionByName(none.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("there")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    fields = ", ".join(f"{c} long" for c in _FIELDS)
    return rows.mapInArrow(lambda it: _repair_rows(it, arrow), f"conv_id {kind.simpleString()}, {fields}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by crc32 of ``conv_id:turn``, modulo 20; nulls of the key, role and text are one space.

    0: the row is gone, 1: its text is empty, 2: its ``[.!?]`` are gone, 3: it comes twice, 4: its role is user.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(fault == 4, "user").otherwise(text_of("role"))
    times = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = turns.where(fault != 0)
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")
