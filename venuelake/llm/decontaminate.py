r"""Benchmark decontamination: a prefix-filtered set join, verified on windows the size of an item's window.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering A-Z. A window is 10 consecutive words of an item; an
item of fewer words, but not none, is one window. A document contains a window only if it contains all its
shingles (pairs of adjacent words; of a window of one word, the word), so a prefix of one shingle is enough:

1. The shingles of all windows are counted in all documents, and those of a window ordered by rarity. The rarest is
   the prefix of the window; a window with a shingle that no document has is dropped.
2. The documents are read once more: each place with the hash of a prefix becomes a row, with the words around it.
3. These places are joined with the prefixes. Position and length bounds drop windows that would begin before the
   first word or end after the last, and the rest are verified word by word; hashes only decide what is compared.

Both readings of the documents send on only what hits a bitmap of BITMAP_BITS of the shingles in question. It is the
one thing that is collected and broadcast, and its size is fixed: a larger benchmark lets more through to the join, but needs
no more readings. A frequent shingle or document is a key of plain exchanges, which adaptive execution splits.

Null texts and texts without words have no windows and are not contaminated. Items with a null id still mark words,
but are not counted among the items. Rows that repeat an item id are one item. Rows with a null doc_id and repeated
rows keep a row each. Columns other than doc_id, item_id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bytesops import mix, raw, slices, word_hashes, words
from .common import content_key, materialize, release, unused

WINDOW = 10
#: Bits of the bitmap that is broadcast (4 MB); a power of two.
BITMAP_BITS = 25
#: Places of a document in one row; a document with more has several rows.
PLACES = 500

_KEEP = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_FOLD = np.frombuffer(_KEEP, np.uint8)
_GAP = np.arange(256) == 0x20
_CHUNK = 4096  # bytes of a bitmap in one bucket


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


class _Places:
    """The words of a slice, and the hash of the shingle at each word."""

    def __init__(self, texts: pa.Array, single: bool):
        body, offsets = raw(texts)
        self.body = _FOLD[body]
        self.start, self.end, self.first = words(self.body, offsets, _GAP)
        self.count = np.diff(self.first)
        h = word_hashes(self.body, self.start, self.end)
        row = np.repeat(np.arange(len(self.count)), self.count)
        self.pair = np.zeros(len(h), np.uint64)
        self.has = np.zeros(len(h), bool)
        if len(h) > 1:
            self.pair[:-1] = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
            self.has[:-1] = row[1:] == row[:-1]
        self.word = mix(h ^ np.uint64(0x5851F42D4C957F2D)) if single else None
        self.row = row

    def found(self, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the shingles that are in the bitmap."""
        at = np.flatnonzero(self.has & _inside(bitmap, self.pair))
        if self.word is None:
            return at, self.pair[at]
        more = np.flatnonzero(_inside(bitmap, self.word))
        return np.concatenate([at, more]), np.concatenate([self.pair[at], self.word[more]])


def _inside(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(65 - (len(bitmap) * 8).bit_length())
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Of a column ``h``; made by the executors, at most 2**BITMAP_BITS bits in all."""
    slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for r in parts.collect():
        out[(r.b - 1) * _CHUNK : r.b * _CHUNK] = np.frombuffer(r.bits, np.uint8)[: len(out)]
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, w (the words), size, hs (of the shingles, in order) of each window of the items."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["item", "w", "size", "hs"])

    rows: list[tuple] = []
    for whole in batches:
        for batch in slices(whole, "text"):
            p = _Places(batch.column("text"), True)
            pair, word = p.pair.view(np.int64), p.word.view(np.int64)
            for item, text, first in zip(batch.column("item").to_pylist(), batch.column("text"), p.first.tolist()):
                found = [x.decode() for x in tokens(text.as_py())]
                size = min(WINDOW, len(found))
                for i in range(len(found) - size + 1 if found else 0):
                    hs = pair[first + i : first + i + size - 1] if size > 1 else word[first : first + 1]
                    rows.append((item, " ".join(found[i : i + size]), size, hs))
                    if len(rows) >= 10000:
                        yield emit(rows)
                        rows = []
    if rows:
        yield emit(rows)


def prefixes(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(prefix, items, single): h, at, size, w of the windows' rarest shingles; w, item; whether a window has one word."""
    spark = docs.sparkSession
    ship_package(spark)
    given = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    every = materialize(given.mapInArrow(_windows, "item string, w string, size int, hs array<long>").distinct(), "windows")
    shingles = materialize(every.select("w", "size", F.posexplode("hs").alias("at", "h")).distinct(), "shingles")
    single = not every.where("size = 1").isEmpty()
    shared = spark.sparkContext.broadcast(_bitmap(shingles))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, n = np.unique(_Places(batch.column("text"), single).found(shared.value)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = materialize(texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    ranked = shingles.join(counts, "h", "left").groupBy("w", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("rarest")
    )
    prefix = materialize(ranked.where("rarest.n > 0").select("rarest.h", "rarest.at", "size", "w"), "prefixes")
    release(shingles, counts)
    return prefix, every.select("w", "item"), single


def places(docs: DataFrame, prefix: DataFrame, single: bool) -> DataFrame:
    """doc_id, _k1, _k2, rid, first, n_words, places: the prefixes in each document, with the words around them.

    ``first`` marks one row of each document; long lists go on in more rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(prefix))
    entry = pa.struct([("h", pa.int64()), ("q", pa.int32()), ("off", pa.int32()), ("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                p = _Places(batch.column("text"), single)
                at, h = p.found(shared.value)
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order].view(np.int64)
                row = p.row[at]
                begin = p.first[:-1][row]
                lo, hi = np.maximum(at - WINDOW + 1, begin), np.minimum(at + WINDOW, p.first[1:][row])
                body = p.body.tobytes()
                near = [b" ".join(body[a:b].split()).decode() for a, b in zip(p.start[lo].tolist(), p.end[hi - 1].tolist())]
                each = list(zip(h.tolist(), (at - begin).tolist(), (at - lo).tolist(), near))
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
                index, lists, firsts = [], [], []
                for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    for k in range(a, max(b, a + 1), PLACES):
                        index.append(r)
                        firsts.append(k == a)
                        lists.append([dict(zip(("h", "q", "off", "near"), x)) for x in each[k : min(b, k + PLACES)]])
                taken = batch.take(pa.array(index, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(c) for c in ("doc_id", "_k1", "_k2", "rid")), pa.array(firsts, pa.bool_()), pa.array(p.count[index], pa.int64()), pa.array(lists, pa.list_(entry))],
                    names=["doc_id", "_k1", "_k2", "rid", "first", "n_words", "places"],
                )

    texts = docs.select("doc_id", *content_key(F.col("text")), F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(
        run,
        f"doc_id {dict(docs.dtypes)['doc_id']}, _k1 long, _k2 long, rid long, first boolean, n_words long, places array<struct<h:long,q:int,off:int,near:string>>",
    )


def _hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, items): the documents' ``places``; rid, start, end, w of verified windows; w, item."""
    prefix, items, single = prefixes(docs, benchmark)
    rows = materialize(places(docs, prefix, single), "places")
    each = rows.select("rid", "n_words", F.explode("places").alias("p")).select("rid", "n_words", "p.*")
    start = F.col("q") - F.col("at")
    near = F.array_join(F.slice(F.split("near", " "), F.col("off") - F.col("at") + 1, F.col("size")), " ")
    hits = (
        each.join(prefix, "h").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .where(near == F.col("w"))
        .select("rid", start.alias("start"), (start + F.col("size")).alias("end"), "w")
    )
    return rows, materialize(hits, "hits"), items


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, spans (of words, sorted; they may overlap), items (distinct ids, sorted as strings)."""
    rows, hits, items = _hits(docs, benchmark)
    spans = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    named = hits.select("rid", "w").distinct().join(items.where("item is not null"), "w").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = rows.where("first").join(spans, "rid", "left").join(named, "rid", "left")
    return found.select(
        "doc_id", "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    """Words covered by spans that may overlap."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all columns, without the documents that contain a window of the benchmark."""
    rows, hits, _ = _hits(docs, benchmark)
    bad = rows.where("first").join(hits.select("rid").distinct(), "rid").select("doc_id", "_k1", "_k2").distinct()
    a, b, *other = unused(docs, "_k1", "_k2", "_d", "_a", "_b")
    bad = materialize(bad, "contaminated").toDF(*other)
    keyed = docs.withColumns(dict(zip((a, b), content_key(F.col("text")))))
    same = keyed["doc_id"].eqNullSafe(bad[other[0]]) & (keyed[a] == bad[other[1]]) & (keyed[b] == bad[other[2]])
    return keyed.join(bad, same, "left_anti").select(*docs.columns)
