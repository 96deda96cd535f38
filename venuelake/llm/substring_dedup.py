r"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

Words are ``[^\x20\x09-\x0D]+``, unchanged. A word is removed if it lies in WINDOW consecutive words that also occur
in a document with a smaller id. The reference is the corpus itself, which no executor could hold, so the shards of
the reference are not broadcast: they are cut by content, and each meets exactly the passages that can match it.

1. Every window of WINDOW words belongs to its anchor, the run of GRAM words in it with the least hash. Equal windows
   have equal anchors. Consecutive windows with one anchor are a run; a run spans about 70 words.
2. Anchors in one document only are dropped (a row for each run is shuffled, not its text).
3. The remaining runs go, with their words, to the shard of their anchor. There the runs are streamed in order of
   doc_id through a suffix automaton of all runs from smaller ids; wherever the matching length is WINDOW or more the
   window has occurred before. Then the document's own runs extend the automaton, unless they are in it as a whole.
4. An anchor with more than HOT_RUNS runs has no automaton, as it would grow with the corpus: its windows are dealt
   one by one instead, with their words, which decide what is equal. Each task first settles the windows of its own
   documents, HOT_HELD distinct ones at a time, and sends on one row for each, so a passage in a third of all
   documents gives a row for each task.
5. The spans are cut out of the texts, which are shuffled by doc_id once and read twice.

Hashes only choose anchors and places; words are compared as they are. Null texts have no words. Rows with a null
doc_id are neither cut nor a reference. Rows that repeat an id are not cut against each other. Texts with fewer than
WINDOW words stay whole. Ids may be of any type that can be ordered. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bytesops import mix, raw, slices, word_hashes, words
from .common import content_key, materialize

WINDOW, GRAM = 50, 8
HOT_RUNS = 2000
#: Distinct windows of hot anchors that a task holds.
HOT_HELD = 100_000


def _fold(h: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; a power of two times smaller steps, by doubling."""
    out, width = mix(h + np.uint64(salt)), 1
    rest: list[tuple[np.ndarray, int]] = []
    todo = size
    while True:
        if todo & 1:
            rest.append((out, width))
        todo >>= 1
        if not todo:
            break
        nxt = np.zeros_like(out)
        if len(out) > width:
            nxt[: len(out) - width] = mix(out[: len(out) - width] * np.uint64(0xD6E8FEB86659FD93) + out[width:])
        out, width = nxt, width * 2
    value, at = np.zeros(len(h), np.uint64), 0
    for part, width in rest:
        moved = np.zeros(len(h), np.uint64)
        moved[: len(h) - at] = part[at:] if at < len(h) else 0
        value = mix(value * np.uint64(0xA0761D6478BD642F) + moved)
        at += width
    return value


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """For each place the index of the leftmost least value among the next ``width``."""
    at, span = np.arange(len(value)), 1
    while span * 2 <= width:
        other = at[np.minimum(np.arange(len(value)) + span, len(value) - 1)]
        at = np.where(value[other] < value[at], other, at)
        span *= 2
    if span < width:
        other = at[np.minimum(np.arange(len(value)) + width - span, len(value) - 1)]
        at = np.where(value[other] < value[at], other, at)
    return at


def window_runs(body: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(row, anchor hash, lo, hi) of the runs: windows lo..hi (first words, in the row's words) have one anchor.

    Repetitive text has the same anchor again and again; it is one run, since only the hash decides.
    """
    start, end, first = words(body, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(start)) - first[:-1][row]
    ok = np.flatnonzero(place + window <= count[row])
    if not len(ok):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    g = _fold(word_hashes(body, start, end), gram, 7)
    anchor = _least(g, window - gram + 1)[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (g[anchor[1:]] != g[anchor[:-1]]) | (row[ok][1:] != row[ok][:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(ok)) - 1
    return row[ok][begin], g[anchor[begin]].view(np.int64), place[ok][begin], place[ok][last]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            row, anchor, lo, hi = window_runs(*raw(batch.column("text")))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            run = pa.StructArray.from_arrays([pa.array(anchor), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["g", "lo", "hi"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "_k1", "_k2")), pa.ListArray.from_arrays(pa.array(at, pa.int32()), run)],
                names=["doc_id", "_k1", "_k2", "runs"],
            )


class Automaton:
    """A suffix automaton of word sequences, extended one sequence at a time."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, sequence: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for c in sequence:
            p = last
            if c in nxt[p]:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    last = q
                    continue
                last = self._clone(p, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[p] + 1)
            link.append(0)
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def matching(self, sequence: list[bytes]) -> list[int]:
        """For each word the length of the longest run that ends there and occurs in what was added."""
        nxt, link, length = self.next, self.link, self.len
        state = matched = 0
        out = []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            out.append(matched)
        return out


_OUT = ["kind", "key", "seq", "doc_id", "_k1", "_k2", "lo", "hi"]


def _out_schema(kind: str) -> str:
    return f"kind int, key long, seq binary, doc_id {kind}, _k1 long, _k2 long, lo int, hi int"


def _signed(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a run with its words, for the automaton of its anchor. kind 1: a distinct window of a hot anchor, from
    the smallest id of this task. kind 2: windows lo..hi of a document that a smaller id of this task has, dealt evenly."""
    hot: dict[bytes, tuple] = {}
    out: list[tuple] = []
    size = 0
    ids = None

    def rows(some: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.binary(), ids, pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=_OUT)

    def window(seq: bytes, place: tuple) -> tuple:
        key = int.from_bytes(hashlib.blake2b(seq, digest_size=8).digest(), "little", signed=True)
        return (1, key, seq, *place, place[-1])

    def settled(place: tuple) -> tuple:
        return (2, _signed(place[1] + place[-1] * 0x9E3779B97F4A7C15), b"", *place, place[-1])

    def flush() -> Iterator[pa.RecordBatch]:
        out.extend(window(seq, place) for seq, place in hot.items())
        hot.clear()
        for at in range(0, len(out), 20000):
            yield rows(out[at : at + 20000])
        out.clear()

    for batch in batches:
        ids = batch.schema.field("doc_id").type
        for i, runs in enumerate(batch.column("shared").to_pylist()):
            if not runs:
                continue
            doc, k1, k2, text = (batch.column(c)[i].as_py() for c in ("doc_id", "_k1", "_k2", "text"))
            found = text.split()
            for r in runs:
                if not r["hot"]:
                    seq = b" ".join(found[r["lo"] : r["hi"] + WINDOW])
                    out.append((0, r["g"], seq, doc, k1, k2, r["lo"], r["hi"]))
                    size += len(seq)
                    continue
                for p in range(r["lo"], r["hi"] + 1):
                    seq = b" ".join(found[p : p + WINDOW])
                    place, held = (doc, k1, k2, p), hot.get(seq)
                    if held is None:
                        hot[seq] = place
                    elif held[0] == doc:
                        if held != place:  # the same id again: each row that carries it needs the answer
                            out.append(window(seq, place))
                            size += len(seq)
                    elif doc > held[0]:
                        out.append(settled(place))
                    else:
                        out.append(settled(held))
                        hot[seq] = place
                if len(hot) > HOT_HELD:
                    yield from flush()
                    size = 0
            if size > 1 << 20 or len(out) > 20000:
                yield rows(out)
                out, size = [], 0
    yield from flush()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted: runs by (key, doc_id), windows by (key, seq, doc_id). Gives (doc_id, _k1, _k2, lo, hi): covered words [lo, hi)."""
    out: list[tuple] = []
    key = doc = None
    automaton = Automaton()
    waiting: list[list[bytes]] = []
    least = window = ids = None

    def flush() -> pa.RecordBatch:
        kinds = [ids, pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "_k1", "_k2", "lo", "hi"])
        out.clear()
        return batch

    for batch in batches:
        ids = batch.schema.field("doc_id").type
        columns = [batch.column(c).to_pylist() for c in _OUT]
        for kind, k, seq, d, k1, k2, lo, hi in zip(*columns):
            if kind == 2:
                out.append((d, k1, k2, lo, hi + WINDOW))
            elif kind == 1:
                if seq != window:
                    window, least = seq, d
                elif d > least:
                    out.append((d, k1, k2, lo, hi + WINDOW))
            else:
                if k != key:
                    key, doc, automaton, waiting = k, d, Automaton(), []
                elif d != doc:
                    for s in waiting:
                        automaton.add(s)
                    doc, waiting = d, []
                found = seq.split()
                matched = automaton.matching(found) if len(automaton.next) > 1 else ()
                at = None
                for i, m in enumerate(matched):
                    if m >= WINDOW:
                        p = lo + i - WINDOW + 1
                        if at is not None and p <= at[1]:
                            at[1] = p + WINDOW
                        else:
                            if at:
                                out.append((d, k1, k2, *at))
                            at = [p, p + WINDOW]
                if at:
                    out.append((d, k1, k2, *at))
                if not len(matched) or matched[-1] < len(found):
                    waiting.append(found)
        if out:
            yield flush()
    if out:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist()):
            found = text.as_py().split()
            n_words.append(len(found))
            if cuts:
                keep = bytearray(b"\1") * len(found)
                for c in cuts:
                    keep[c["lo"] : c["hi"]] = bytes(c["hi"] - c["lo"])
                found = [w for w, k in zip(found, keep) if k]
            n_removed.append(n_words[-1] - len(found))
            digests.append(hashlib.sha256(b" ".join(found)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, cuts): doc_id, _k1, _k2 with the text as bytes, and with ``cuts``, the word spans to remove."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", *content_key(F.col("text")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    key = ["doc_id", "_k1", "_k2"]
    runs = materialize(texts.where("doc_id is not null").mapInArrow(_runs, f"doc_id {kind}, _k1 long, _k2 long, runs array<struct<g:long,lo:int,hi:int>>"), "runs")
    each = runs.select(*key, F.explode("runs").alias("r")).select(*key, "r.*")
    shared = each.groupBy("g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    # written, so that the join below has plain exchanges and a frequent anchor can be split
    shared = materialize(shared.select("g", (F.col("n") > HOT_RUNS).alias("hot")), "shared")
    by_doc = each.join(shared, "g").groupBy(*key).agg(F.collect_set(F.struct("g", "lo", "hi", "hot")).alias("shared"))
    placed = texts.join(by_doc, key, "left").select(*key, "text", "shared").mapInArrow(_passages, _out_schema(kind))
    # runs of an anchor by id; windows with the same words together, by id
    window = F.when(F.col("kind") == 1, F.col("seq"))
    placed = placed.repartition("key").sortWithinPartitions("kind", "key", window, "doc_id", "lo")
    cuts = placed.mapInArrow(_shards, f"doc_id {kind}, _k1 long, _k2 long, lo int, hi int")
    return texts, cuts.groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    texts, cuts = repeated_spans(docs)
    return texts.join(cuts, ["doc_id", "_k1", "_k2"], "left").select("doc_id", "text", "cuts").mapInArrow(
        _cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string"
    )
