r"""LM scoring with an interpolated modified Kneser-Ney bigram model, counted in Spark.

Tokens are words ``[^\x20\x09-\x0D]+`` after lowering A-Z, and one end of text. A task counts its own texts, a few
million keys at a time, and sends on its sorted keys, cut into cells by their top bits and packed as differences. Cells
are summed up and written one by one, so that memory follows neither the keys of a task nor the size of a file:

1. words: 64 bits of a cryptographic digest are the key, 64 more prove that equal keys are equal words (else all is
   done again with another salt). The place of a word in all files is its id; the end of text is a word too.
2. bigrams: (context id, word id) in one integer, or two for large vocabularies, scrambled one to one, so that the bigrams of a frequent context are
   dealt as evenly as all others.
3. ids: the total and the counts of counts of each context, and the number of contexts of each word, in arrays by id.

The arrays lie in the shared folder and are memory-mapped by the workers, so a worker holds only the pages that it
touches, and scoring looks sorted distinct keys up by binary search. Lost tasks write the same files again. The
shared folder has to be mounted on the executors (a ``file:`` path), as usual for memory mapping. There is a cell for
each PART_BYTES of text. A file holds one cell, or several beyond MAX_PARTS of them, and the driver is sent a row for each file.

    p(w|u) = max(c(uw) - D(c(uw)), 0) / c(u.) + g(u) p(w)
    p(w)   = max(N(.w) - D'(N(.w)), 0) / N(..) + g' / (V + 1)

D are the three discounts of each order, from the counts of counts; g gives what they take. V + 1 counts unknown
words as one. The context of the first token is the start of text. Null texts count as empty and have the end only.
Rows with a null id are held out. Without training texts, all is uniform over the one unknown word: scores are 0.
Ids are 32 bits in a bigram's key; a vocabulary that needs more has keys of two numbers. Other columns are not used.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bytesops import LOWER, digests, mix, raw, slices, unmix, word_codes, words
from .common import crc_bucket, new_path

#: Bytes of text for each part of the model, and the most parts; powers of two.
PART_BYTES, MAX_PARTS = 16 << 20, 4096
#: Bits of an id in a bigram's key of one number. A vocabulary that needs more has keys of two numbers.
ID_BITS = 32
#: Bigrams that occur so often have their counts in a list of their own.
MOST = (1 << 32) - 1
#: Distinct keys that a task gathers before it sends them on.
FLUSH_KEYS = 1 << 21
ROWS = 1000


def _sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of ``keys``, and the sums of their ``values``."""
    if len(keys) < 2:
        return keys, values
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[at], np.add.reduceat(values, at, axis=0)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, by place: the high ones are mostly zero."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(8, -1).T).view(np.uint64).ravel()


def _pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted rows, the first key as differences."""
    columns = [np.diff(keys[:, 0], prepend=np.uint64(0)), *keys.T[1:], *values.T]
    data = b"".join(map(_planes, columns))
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(data) if len(keys) > 32 else b"\0" + data


def _unpack(blob: bytes, keyed: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[0] else blob[1:]
    first, *rest = (_numbers(x) for x in np.frombuffer(data, np.uint8).reshape(keyed + width, -1))
    columns = [np.cumsum(first, dtype=np.uint64), *rest]
    return np.stack(columns[:keyed], axis=1), np.stack(columns[keyed:], axis=1).view(np.int64)


class _Gather:
    """Sums by key in a task, sent on as a packed row for each cell: the top ``bits`` of the first key."""

    def __init__(self, bits: int):
        self.bits, self.held, self.size = bits, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, values))
        self.size += len(keys)
        if self.size > FLUSH_KEYS:
            self._merge()
            if self.size > FLUSH_KEYS // 2:
                yield from self.flush()

    def _merge(self) -> None:
        self.held = [_sum(*(np.concatenate(x) for x in zip(*self.held)))]
        self.size = len(self.held[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            keys, values = self.held[0]
            cells = (keys[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]]).tolist()
            for at in range(0, len(cut) - 1, ROWS):
                spans = list(zip(cut[at : at + ROWS], cut[at + 1 : at + ROWS + 1]))
                blobs = [_pack(keys[a:b], values[a:b]) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(cells[[a for a, _ in spans]]), pa.array(blobs, pa.binary())], names=["cell", "blob"])
        self.held, self.size = [], 0


_CELLS = "cell long, blob binary"


def _merged(batches: Iterator[pa.RecordBatch], keyed: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, keys, sums) of rows sorted by cell; one cell is held at a time."""
    cell, held = None, []
    for batch in batches:
        for c, blob in zip(batch.column("cell").to_pylist(), batch.column("blob")):
            if c != cell:
                if held:
                    yield cell, *_sum(*(np.concatenate(x) for x in zip(*held)))
                cell, held = c, []
            held.append(_unpack(blob.as_py(), keyed, width))
            if len(held) > 8:
                held = [_sum(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        yield cell, *_sum(*(np.concatenate(x) for x in zip(*held)))


class _Files:
    """The arrays of one part. Whole files only: a second attempt at a task puts the same content in their place."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.own = folder, part, f"{os.getpid()}-{os.urandom(4).hex()}"
        self.open: dict[str, object] = {}
        self.rows = 0

    def put(self, **arrays: np.ndarray) -> None:
        for name, array in arrays.items():
            if name not in self.open:
                os.makedirs(self.folder, exist_ok=True)
                self.open[name] = open(f"{self.folder}/.{name}{self.part}-{self.own}", "wb")
            self.open[name].write(np.ascontiguousarray(array).tobytes())

    def close(self) -> None:
        for name, file in self.open.items():
            file.close()
            os.replace(file.name, f"{self.folder}/{name}{self.part}")


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model is memory-mapped, so {path} must be a folder that the executors have mounted")
    return path


def _written(rows: DataFrame, model: Model, keyed: int, width: int, put: Callable, stats: int) -> dict[int, tuple[int, ...]]:
    """Cells of ``rows`` in the file of their part, one after the other.

    ``put(files, keys, sums)`` writes a cell and gives its statistics, which are summed up for each part.
    """
    folder, shift = model.folder, model.cell_bits - model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, total, done = None, None, []

        def close() -> None:
            files.close()
            done.append((files.part, *total))

        for cell, keys, sums in _merged(batches, keyed, width):
            if files is None or files.part != cell >> shift:
                if files is not None:
                    close()
                files, total = _Files(folder, cell >> shift), [0] * stats
            total = [a + int(b) for a, b in zip(total, put(files, keys, sums))]
        if files is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=["part", *(f"s{i}" for i in range(stats))])

    schema = "part long, " + ", ".join(f"s{i} long" for i in range(stats))
    dealt = rows.repartition(F.shiftright("cell", shift)).sortWithinPartitions("cell")
    return {r.part: tuple(r)[1:] for r in dealt.mapInArrow(run, schema).collect()}


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts, each within [0, count]; plain halves where a count is missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


def taken(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _tokens(batch: pa.RecordBatch, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each token, first token of each row and the end, digests by code); the last code is the end of text."""
    body, offsets = raw(batch.column("text"))
    body = LOWER[body]
    start, end, first = words(body, offsets)
    codes, distinct = word_codes(body, start, end)
    rows = batch.num_rows
    out = np.full(len(codes) + rows, len(distinct))
    out[np.arange(len(codes)) + np.repeat(np.arange(rows), np.diff(first))] = codes
    # a space, which no word has, stands for the end
    return out, np.append(first[:-1] + np.arange(rows), len(out)), digests([*distinct, b" "], salt)


class Model:
    """What workers need to open the arrays, and the numbers that hold for the whole model."""

    def __init__(self, folder: str, cell_bits: int, salt: int):
        self.folder, self.cell_bits, self.salt = folder, cell_bits, salt
        self.bits = min(cell_bits, MAX_PARTS.bit_length() - 1)
        self.parts = 1 << self.bits
        self.offsets, self.tokens = [0] * (self.parts + 1), 0
        self.d1 = self.d2 = (0.5, 0.5, 0.5)
        self.pairs, self.floor = 0, 1.0
        self.wide = False
        self.maps: dict[tuple[str, int], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    @property
    def size(self) -> int:
        """Words; also the id of the context at the start of a text."""
        return self.offsets[-1]

    def range_bits(self) -> int:
        """Ids are dealt by their top bits among this many."""
        return max(self.size.bit_length(), self.cell_bits)

    def map(self, name: str, part: int, kind: str, columns: int = 1) -> np.ndarray:
        if (name, part) not in self.maps:
            path = f"{self.folder}/{name}{part}"
            there = os.path.exists(path) and os.path.getsize(path)
            array = np.memmap(path, kind, "r") if there else np.zeros(0, kind)
            self.maps[name, part] = array.reshape(-1, columns) if columns > 1 else array
        return self.maps[name, part]

    def _parts_of(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        borders = np.arange(self.parts, dtype=np.uint64) << np.uint64(64 - self.bits)
        cut = np.append(np.searchsorted(keys, borders), len(keys)).tolist()
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if b > a:
                yield p, slice(a, b)

    def find(self, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of words by their digests."""
        order = np.argsort(digest[:, 0], kind="stable")
        h, check = digest[order, 0], digest[order, 1]
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for p, some in self._parts_of(h):
            keys = self.map("word", p, "u8")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
                hit = (keys[at] == h[some]) & (self.map("check", p, "u8")[at] == check[some])
                ids[some] = np.where(hit, at + self.offsets[p], -1)
                counts[some] = np.where(hit, self.map("count", p, "i8")[at], 0)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return ids[back], counts[back]

    @property
    def keyed(self) -> int:
        """Numbers in the key of a bigram."""
        return 2 if self.wide else 1

    def pair_keys(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(n, keyed): keys that are equal exactly for equal bigrams, with the first number spread evenly."""
        before, ids = before.astype(np.uint64), ids.astype(np.uint64)
        if self.wide:
            return np.stack([mix(before ^ mix(ids)), ids], axis=1)
        return mix(before << np.uint64(32) | ids)[:, None]

    def pair_ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams of keys."""
        if self.wide:
            return unmix(keys[:, 0]) ^ mix(keys[:, 1]), keys[:, 1]
        both = unmix(keys[:, 0])
        return both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)

    def pair_table(self, part: int) -> np.ndarray:
        return self.map("pair", part, "u8").reshape(-1, self.keyed)

    def times(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct bigram keys."""
        out = np.zeros(len(keys), np.int64)
        for p, some in self._parts_of(keys[:, 0]):
            table = self.pair_table(p)
            if len(table):
                at, hit = _locate(table, keys[some])
                c = np.where(hit, self.map("times", p, "u4")[at], 0).astype(np.int64)
                if (c == MOST).any():  # those that need more bits are listed apart
                    over = self.map("over", p, "u8").reshape(-1, self.keyed + 1)
                    place, listed = _locate(over[:, : self.keyed], keys[some])
                    c = np.where(listed, over[place, self.keyed].astype(np.int64), c)
                out[some] = c
        return out

    def by_id(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, [n1, n2, n3, contexts]) of sorted ids."""
        total, kinds = np.zeros(len(ids), np.int64), np.zeros((len(ids), 4), np.int64)
        shift = self.range_bits() - self.bits
        part = ids >> shift
        cut = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)]):
            if b > a:
                p = int(part[a])
                at = ids[a:b] - (p << shift)
                there = at < len(self.map("total", p, "i8"))
                total[a:b][there] = self.map("total", p, "i8")[at[there]]
                kinds[a:b][there] = self.map("kinds", p, "u4", 4)[at[there]]
        return total, kinds

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """p(w) of sorted distinct word ids, -1 for unknown words."""
        out = np.full(len(ids), self.floor)
        known = ids >= 0
        n = self.by_id(ids[known])[1][:, 3]
        out[known] += np.maximum(n - taken(n, self.d1), 0) / max(self.pairs, 1)
        return out

    def context(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, back-off weight) of sorted distinct context ids; an unknown context has total 0 and weight 1."""
        total, kinds = np.zeros(len(ids), np.int64), np.zeros((len(ids), 4), np.int64)
        known = ids >= 0
        total[known], kinds[known] = self.by_id(ids[known])
        return total, np.where(total > 0, kinds[:, :3] @ np.array(self.d2) / np.maximum(total, 1), 1.0)


def _locate(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of keys in a table of sorted rows that is not empty."""
    at = np.minimum(np.searchsorted(table[:, 0], keys[:, 0]), len(table) - 1)
    if keys.shape[1] > 1:  # rows with an equal first number follow each other
        while True:
            on = np.minimum(at + 1, len(table) - 1)
            go = (table[at, 0] == keys[:, 0]) & (table[at, 1] != keys[:, 1]) & (table[on, 0] == keys[:, 0]) & (on > at)
            if not go.any():
                break
            at = np.where(go, on, at)
    return at, (table[at] == keys).all(axis=1)


def _before(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[first[:-1]] = start
    return out


def train(docs: DataFrame, salt: int = 0) -> Model:
    """The model of all texts of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(_local(new_path(spark, "kneser-ney")), max((total // PART_BYTES).bit_length(), 1), salt)
    cells = model.cell_bits

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(cells)
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, _, digest = _tokens(batch, salt)
                n = np.bincount(codes, minlength=len(digest))
                yield from gather.add(digest[n > 0], n[n > 0, None])
        yield from gather.flush()

    def put_words(files: _Files, keys: np.ndarray, sums: np.ndarray) -> tuple[int, ...]:
        files.put(word=keys[:, 0], check=keys[:, 1], count=sums)
        return len(keys), sums.sum(), (keys[1:, 0] == keys[:-1, 0]).sum()

    sized = _written(texts.mapInArrow(count_words, _CELLS), model, 2, 1, put_words, 3)
    if any(again for _, _, again in sized.values()):
        return train(docs, salt + 1)
    model.offsets = np.concatenate([[0], np.cumsum([sized.get(p, (0, 0, 0))[0] for p in range(model.parts)])]).tolist()
    model.tokens = sum(n for _, n, _ in sized.values())
    model.wide = model.size + 1 >= 1 << ID_BITS
    if not model.tokens:
        return model
    shared = spark.sparkContext.broadcast(model)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, gather = shared.value, _Gather(cells)
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, first, digest = _tokens(batch, m.salt)
                ids = m.find(digest)[0][codes]
                keys = m.pair_keys(_before(ids, first, m.size), ids)
                if m.wide:
                    yield from gather.add(*_sum(keys, np.ones((len(keys), 1), np.int64)))
                else:
                    keys, n = np.unique(keys[:, 0], return_counts=True)
                    yield from gather.add(keys[:, None], n[:, None])
        yield from gather.flush()

    def put_pairs(files: _Files, keys: np.ndarray, sums: np.ndarray) -> tuple[int, ...]:
        files.put(pair=keys, times=np.minimum(sums, MOST).astype(np.uint32))
        if (many := sums[:, 0] >= MOST).any():
            files.put(over=np.concatenate([keys[many], sums[many].view(np.uint64)], axis=1))
        return len(keys), *_counts_of_counts(sums)

    filled = _written(texts.mapInArrow(count_pairs, _CELLS), model, model.keyed, 1, put_pairs, 5)
    model.pairs, *coc = (sum(x) for x in zip(*filled.values()))
    model.d2 = discounts(*coc)
    top = np.uint64(64 - model.range_bits())
    base = model.range_bits() - model.bits

    def by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the bigrams of each part, by id (in the top bits): total and counts of counts as a context, contexts as a word."""
        m, gather = shared.value, _Gather(cells)
        for batch in batches:
            for p in batch.column("id").to_pylist():
                table = m.pair_table(p)
                for at in range(0, len(table), FLUSH_KEYS):
                    keys = table[at : at + FLUSH_KEYS]
                    n = m.times(keys)
                    ids, place = np.unique(np.concatenate(m.pair_ids(keys)), return_inverse=True)
                    values = np.zeros((len(ids), 5), np.int64)
                    np.add.at(values[:, 0], place[: len(n)], n)
                    for k, some in enumerate((n == 1, n == 2, n > 2), 1):
                        values[:, k] = np.bincount(place[: len(n)][some], minlength=len(ids))
                    values[:, 4] = np.bincount(place[len(n) :], minlength=len(ids))
                    yield from gather.add((ids << top)[:, None], values)
        yield from gather.flush()

    def put_ids(files: _Files, keys: np.ndarray, sums: np.ndarray) -> tuple[int, ...]:
        at = (keys[:, 0] >> top).astype(np.int64) - (files.part << base) - files.rows
        dense = np.zeros((at[-1] + 1, 5), np.int64)
        dense[at] = sums
        files.rows += len(dense)
        files.put(total=dense[:, 0], kinds=dense[:, 1:].astype(np.uint32))
        return *_counts_of_counts(sums[:, 4]), (sums[:, 4] > 2).sum()

    which = spark.range(model.parts, numPartitions=model.parts)
    n1, n2, n3, n4, more = (sum(x) for x in zip(*_written(which.mapInArrow(by_id, _CELLS), model, 1, 5, put_ids, 5).values()))
    model.d1 = discounts(n1, n2, n3, n4)
    model.floor = (model.d1[0] * n1 + model.d1[1] * n2 + model.d1[2] * more) / model.pairs / (model.size + 1)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``(doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, first, digest = _tokens(batch, m.salt)
                by_code = m.find(digest)
                ids, counts = (x[codes] for x in by_code)
                base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (m.size + 1)))
                before = _before(ids, first, m.size)
                distinct, place = np.unique(ids, return_inverse=True)
                low = m.lower(distinct)[place]
                distinct, place = np.unique(before, return_inverse=True)
                total, weight = (x[place] for x in m.context(distinct))
                c = np.zeros(len(ids), np.int64)
                both = (ids >= 0) & (before >= 0)
                keys, place = np.unique(m.pair_keys(before[both], ids[both]), axis=0, return_inverse=True) if m.wide else np.unique(m.pair_keys(before[both], ids[both])[:, 0], return_inverse=True)
                c[both] = m.times(keys.reshape(-1, m.keyed))[place.ravel()]
                p = np.maximum(c - taken(c, m.d2), 0) / np.maximum(total, 1) + weight * low
                sums = [np.add.reduceat(x, first[:-1]) for x in (base, np.log10(p), counts > 0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(first)), pa.array(sums[2].astype(np.int64)),
                        pa.array(np.full(batch.num_rows, m.tokens, np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def held_out_scores(docs: DataFrame, modulus: int = 10, remainder: int = 0) -> DataFrame:
    """Scores of all documents by a model of those whose id doesn't hash to ``remainder``."""
    marked = docs.select("doc_id", "text", (crc_bucket(F.col("doc_id"), modulus) == remainder).alias("held_out"))
    return score(marked, train(marked.where("not held_out")))
