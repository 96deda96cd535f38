"""Numpy kernels over the bytes of Arrow columns: slices of bounded size, words, hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bytes of text that a kernel looks at together; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``limit`` bytes in ``column``, or one row."""
    sizes = lengths(batch.column(column))
    start = held = 0
    for row, n in enumerate(sizes.tolist()):
        if row > start and held + n > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(raw(texts)[1])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column, and the offsets of its rows from the first byte; nulls are empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = pa.array([b"" if x is None else x for x in texts.cast(pa.large_binary() if wide else pa.binary()).to_pylist()], pa.binary())
        wide = False
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def words(body: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and for each row the index of its first word (one more at the end)."""
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = ~gap[body]
    begins = inside[1:] & ~inside[:-1]
    ends = ~inside[1:] & inside[:-1]
    # a row's border splits words that touch it
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(body))]
    cut = borders[inside[borders] & inside[borders + 1]]
    begins[cut] = True
    ends[cut] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made ``x`` of."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_POWERS", _P), ("_INVERSES", _P_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS, _INVERSES


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span lies."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(body) + 1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[: len(body)], out=total[1:])
    value = (total[end] - total[start]) * inverse[start]
    return mix(value + mix((end - start).astype(np.uint64)))


def gram_hashes(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a row with fewer words, but not none, gives one run of them all."""
    rows = len(first) - 1
    count = np.diff(first)
    row_of = np.repeat(np.arange(rows), count)
    place = np.arange(len(h)) - first[:-1][row_of]
    span = np.minimum(count, size)[row_of]
    ok = place + span <= count[row_of]
    at, n = np.flatnonzero(ok), span[ok]
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        use = n > k
        value[use] = mix(value[use] * np.uint64(0xD6E8FEB86659FD93) + h[at[use] + k] + np.uint64(k + 1))
    return value, row_of[ok]


def word_codes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(code of each byte span, the distinct spans): codes are equal exactly if the bytes are."""
    if not len(start):
        return np.zeros(0, np.int64), []
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    inside = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    packed = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body[inside])])
    found = packed.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def digests(spans: list[bytes], salt: int = 0) -> np.ndarray:
    """(n, 2) 64-bit halves of a cryptographic 128-bit digest of each span."""
    of = hashlib.blake2b(digest_size=16, salt=salt.to_bytes(8, "little")).copy
    out = []
    for x in spans:
        h = of()
        h.update(x)
        out.append(h.digest())
    data = b"".join(out)
    return np.frombuffer(data, np.uint64).reshape(-1, 2)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An integer for each pair (a, b) of small integers, equal exactly for equal pairs."""
    if not len(a):
        return np.zeros(0, np.int64)
    return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)


def run_names(codes: np.ndarray, size: int) -> np.ndarray:
    """An integer for the run of ``size`` codes from each place on, equal exactly for equal runs.

    Pairs of names are named again, by doubling. Runs that would pass the end have no meaning.
    """
    name, width, parts = codes, 1, []
    todo = size
    while True:
        if todo & 1:
            parts.append((name, width))
        todo >>= 1
        if not todo:
            break
        name, width = _joined(name, np.append(name[width:], np.zeros(min(width, len(name)), np.int64))), width * 2
    (out, at), *rest = parts
    for part, width in rest:
        out = _joined(out, np.append(part[at:], np.zeros(min(at, len(part)), np.int64)))
        at += width
    return out
