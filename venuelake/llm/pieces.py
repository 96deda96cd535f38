"""SentencePiece encoding and decoding with a given BPE model, as a batched numpy Viterbi search.

A text becomes ``▁`` for each space with one in front, and is cut where no piece reaches across: before a ``▁`` that
follows another character, and around line ends. Units repeat, so only those that a worker has not met are searched.

Units of equal length advance together. At each end position every piece that ends there is a candidate; hashes of
all substrings probe the sorted piece keys. A sum of scores would not give what the model's merges give, so the
quantity that is maximised is the length of a piece among those that merging allows: a sequence is what the merges
give exactly if each adjacent pair is, which is decided by undoing the merges of the two pieces, latest first, and
looking for an earlier merge across their border. That test runs on the distinct pairs of a step, again by hashes.
The best candidate and its length are the backpointers.

The ids equal those of the sentencepiece library. Characters without a piece become byte pieces; so does ``▁`` itself
where a text has it (the library would turn it into a space), so that decoding gives back every text exactly. Units
with several spaces are merged one by one, as their pieces have equal scores and the order of ties matters.
Null texts count as empty; empty texts have no pieces. Rows with null ids and repeated rows keep a row each.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bytesops import slices

#: Units that a worker remembers, and the longest of them in bytes.
CACHE_UNITS, CACHE_BYTES = 400_000, 100
SLICE = 2 << 20
#: Characters of units that are searched together.
CELLS = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = "▁"
_UNITS = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
_START, _NONE = -1, -2


def default_model() -> str:
    """The public BPE model that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes (n, length + 1) of code points (n, length)."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _P + codes[:, i] + np.uint64(1)
    return out


class Pieces:
    """Piece keys, ranks and splits of a BPE model; made on the driver and sent to the workers."""

    def __init__(self, names: list[tuple[int, str, float]], byte_ids: list[int], size: int):
        self.byte_ids = byte_ids
        self.ids = np.array([i for i, _, _ in names], np.int32)
        self.names = [n for _, n, _ in names]
        self.score = {n: s for _, n, s in names}
        self.place = {n: k for k, n in enumerate(self.names)}
        self.longest = max(map(len, self.names))
        self.length = np.array([len(n) for n in self.names], np.int64)
        order = sorted({s for n, s in self.score.items() if len(n) > 1}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        self.rank = np.array([rank[self.score[n]] if len(n) > 1 else -1 for n in self.names], np.int64)
        self.power = np.ones(self.longest + 1, np.uint64)
        for k in range(1, self.longest + 1):
            self.power[k] = np.uint64(int(self.power[k - 1]) * int(_P) & (1 << 64) - 1)
        self.hash = np.array([self._hash_of(n) for n in self.names], np.uint64)
        sort = np.argsort(self.hash)
        self.keys, self.at = self.hash[sort], sort
        self.may = np.zeros(1 << 20, bool)
        self.may[self.keys >> np.uint64(44)] = True
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have the same key")
        self.left = self.right = np.zeros(0, np.int64)
        self.whole = np.zeros(len(self.names), bool)
        left, right = np.arange(len(self.names)), np.arange(len(self.names))
        for k, n in enumerate(self.names):
            parts, last = self._merge(n)
            self.whole[k] = len(parts) == 1
            if last and len(parts) == 1:
                left[k], right[k] = self.place[last[0]], self.place[last[1]]
        self.left, self.right = left, right
        self.bytes = [b""] * size
        for i, n, _ in names:
            self.bytes[i] = n.replace(_SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        scored = Counter(self.score[n] for n in self.names if len(n) > 1)
        if any(scored[self.score[n]] > 1 and n.strip(_SPACE) for n in self.names if len(n) > 1):
            raise ValueError("pieces with equal scores are known for runs of spaces only")
        if any("\n" in n or re.search(f"[^{_SPACE}]{_SPACE}", n) for n in self.names):
            raise ValueError("a piece reaches across a border between units")

    def _hash_of(self, text: str) -> np.uint64:
        value = 0
        for c in text:
            value = (value * int(_P) + ord(c) + 1) & (1 << 64) - 1
        return np.uint64(value)

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The model's merges one by one: best score first, leftmost among equals; and the last merge."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts))) + [-1]
        before = [-1] + list(range(len(parts) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, len(parts[a]) + len(parts[b])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        last = None
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or len(parts[a]) + len(parts[b]) != size:
                continue
            last = (parts[a], parts[b])
            parts[a] += parts[b]
            parts[b] = None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None], last

    def find(self, keys: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Places of pieces with these hashes and lengths, or -1."""
        out = np.full(keys.shape, -1, np.int64)
        maybe = np.nonzero(self.may[keys >> np.uint64(44)])  # most substrings are no piece, as the top bits tell
        some = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        place = self.at[at]
        long = self.length[place] == (length if np.ndim(length) == 0 else length[maybe])
        out[maybe] = np.where((self.keys[at] == some) & long, place, -1)
        return out

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces a, b side by side."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            size = self.length[a] + self.length[b]
            joined = np.full(len(a), -1)
            short = size <= self.longest
            joined[short] = self.find(self.hash[a[short]] * self.power[self.length[b[short]]] + self.hash[b[short]], size[short])
            bad = (joined >= 0) & (self.rank[joined] < limit)
            ok[live[bad]] = False
            later = self.rank[a] > self.rank[b]
            go = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            limit = np.where(later, self.rank[a], self.rank[b] + 1)[go]
            a, b, later, live = a[go], b[go], later[go], live[go]
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return ok

    def _spell(self, text: str) -> list[int]:
        if (k := self.place.get(text)) is not None:
            return [int(self.ids[k])]
        return [self.byte_ids[b] for b in text.encode()]

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        """Ids (int32, little-endian) of units; a space stands for ``▁``."""
        out: list[bytes] = [b""] * len(units)
        by_length: dict[int, list[int]] = {}
        texts = []
        for k, unit in enumerate(units):
            text = unit.decode()
            if not unit.isascii() and _SPACE in text:  # cut around it: no piece may hold what decoding would turn into a space
                parts = re.split(f"({_SPACE})", text)
                ids = [i for p in parts if p for i in ([self.byte_ids[b] for b in p.encode()] if p == _SPACE else np.frombuffer(self.encode_units([p.encode()])[0], np.int32).tolist())]
                out[k] = np.array(ids, np.int32).tobytes()
                text = ""
            else:
                text = text.replace(" ", _SPACE)
            if _SPACE * 2 in text or len(text) > 2000:
                out[k] = np.array([i for p in self._merge(text)[0] for i in self._spell(p)], np.int32).tobytes()
            elif text:
                by_length.setdefault(len(text), []).append(k)
            texts.append(text)
        for length, rows in by_length.items():
            for at in range(0, len(rows), 1 + CELLS // length):
                part = rows[at : at + 1 + CELLS // length]
                for k, ids in zip(part, self._search([texts[k] for k in part], length)):
                    out[k] = ids
        return out

    def _search(self, texts: list[str], length: int) -> list[bytes]:
        n = len(texts)
        codes = np.array(texts, f"<U{length}").view(np.uint32).reshape(n, length)
        prefix = _hash(codes.astype(np.uint64))
        widest = min(length, self.longest)
        known = [self.find(prefix[:, k:] - prefix[:, : length + 1 - k] * self.power[k], k) for k in range(1, widest + 1)]
        unknown = len(self.names)
        known[0] = np.where(known[0] < 0, unknown, known[0])
        last = np.full((n, length + 1), _NONE, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        last[:, 0] = _START
        whole = np.append(self.whole, True)
        for j in range(1, length + 1):
            wide = min(j, widest)
            piece = np.stack([known[k - 1][:, j - k] for k in range(1, wide + 1)], axis=1)
            prev = last[:, j - wide : j][:, ::-1]
            good = (piece >= 0) & (prev != _NONE)
            good &= np.where(good, whole[np.maximum(piece, 0)], False)
            ask = good & (prev >= 0) & (prev < unknown) & (piece < unknown)
            if ask.any():
                pairs, place = np.unique(prev[ask] * unknown + piece[ask], return_inverse=True)
                good[ask] = self.allowed(pairs // unknown, pairs % unknown)[place]
            size = np.where(good, np.arange(1, wide + 1), 0)
            best = size.argmax(axis=1)
            rows = np.arange(n)
            found = size[rows, best] > 0
            last[found, j] = piece[rows, best][found]
            back[found, j] = best[found] + 1
        at, count = np.full(n, length), np.zeros(n, np.int64)
        tokens = np.zeros((n, length), np.int64)
        while (live := at > 0).any():
            rows = np.flatnonzero(live)
            tokens[rows, length - 1 - count[rows]] = last[rows, at[rows]]
            count[rows] += 1
            at[rows] = at[rows] - np.maximum(back[rows, at[rows]], 1)
        lost = last[:, length] == _NONE
        special = lost | ((tokens == unknown) & (np.arange(length) >= length - count[:, None])).any(axis=1)
        ids = np.append(self.ids, np.int32(0)).astype(np.int32)[np.maximum(tokens, 0)]
        flat = ids[np.arange(length) >= length - count[:, None]].tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for r in np.flatnonzero(special).tolist():
            out[r] = np.array([i for p in self._merge(texts[r])[0] for i in self._spell(p)], np.int32).tobytes()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


@functools.cache
def load(path: str) -> Pieces:
    """Pieces of a sentencepiece BPE model file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    names = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Pieces(names, byte_ids, len(every))


class Encoder:
    """Remembers short units that a worker has met. When there are too many, those stay that were met again since the last time."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cache: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        units = [_UNITS.findall(b" " + t) if t else [] for t in texts]
        distinct = set().union(*units)
        new = [u for u in distinct if u not in self.cache]
        met = distinct.difference(new)
        self.again |= met
        if len(self.cache) + len(new) > CACHE_UNITS:
            keep = self.again if len(self.again) + len(new) <= CACHE_UNITS else met
            self.cache = {u: self.cache[u] for u in keep}
            self.again = met
        self.cache.update(zip(new, self.pieces.encode_units(new)))
        get = self.cache.__getitem__
        found = [b"".join(map(get, u)) for u in units]
        for u in new:
            if len(u) > CACHE_BYTES:
                del self.cache[u]
        return found


def _encoded(docs: DataFrame, path: str, finish, schema: str) -> DataFrame:
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
                yield finish(batch, texts, encoder.encode(texts), encoder.pieces)

    return docs.mapInArrow(run, schema)


def _lists(found: list[bytes]) -> pa.Array:
    size = np.array([len(x) // 4 for x in found], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids``, the piece ids of each text."""

    def finish(batch: pa.RecordBatch, texts: list[bytes], found: list[bytes], pieces: Pieces) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(found)], names=["doc_id", "ids"])

    return _encoded(docs.select("doc_id", "text"), path, finish, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of rows with ``ids``; null ids give the empty text."""
    ship_package(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = [pieces.decode(x.as_py() or []).decode() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (as of ``encode``), n_pieces, ids_sha256 (of int32, little-endian), decoded_sha256, round_trip (decoding gave the text)."""

    def finish(batch: pa.RecordBatch, texts: list[bytes], found: list[bytes], pieces: Pieces) -> pa.RecordBatch:
        decoded = [pieces.decode(np.frombuffer(x, np.int32).tolist()) for x in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), _lists(found), pa.array([len(x) // 4 for x in found], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_()),
            ],
            names=["doc_id", "ids", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"],
        )

    return _encoded(
        docs.select("doc_id", "text"), path, finish,
        f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean",
    )
