r"""Phrase collocations by pivot partitioning, after MG-FSM.

1. Words are counted for each language. Words below ``LEAST`` can't be part of a candidate, so they end fragments.
2. The words that are left get an order by their frequency. An n-gram belongs to its pivot, the rarest of its words (of
   equal ones the leftmost). Each occurrence of a word is rewritten as the fragment of at most four words to each side
   that belongs to it: to the left words that are more frequent, to the right words that are at least as frequent.
   Every occurrence of an n-gram so lies in exactly one fragment, that of its pivot.
3. Fragments are routed to their pivot, equal ones of a slice of text as one with a count, and all of a pivot as one row. There all n-grams that
   hold the pivot's place are mined, and only those with ``LEAST`` occurrences leave. Pivots with more than ``HOT``
   occurrences are dealt to several groups by the content of the fragment, whose partial counts are summed up.
4. Candidates meet the counts of the parts of each cut, and of the longer candidates that hold them.

The order comes from a table of ``CELLS`` sums, so that what is broadcast has a fixed size; words that share a cell
share a frequency there, which moves n-grams to another pivot but changes no count. All arithmetic is on whole numbers
of 38 digits.

Null texts are empty, a null language is ``und``. Repeated rows count again. Empty tables give no phrases. Columns
other than lang and text are not used. A long text is a slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .bytesops import LOWER, lengths, raw, slices, word_codes, word_hashes, words
from .common import materialize

#: Least occurrences of a candidate, its most words, and how many phrases of a language are returned.
LEAST, MOST, TOP = 100, 5, 2000
#: Places of the table of frequencies that every task holds, of 8 bytes each.
CELLS = 1 << 21
#: Occurrences of a pivot beyond which its fragments are dealt to several groups.
HOT = 1 << 18
#: Bytes of fragments that are mined together, apart from those of the last pivot.
MINED_BYTES = 2 << 20
SLICE = 2 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class _Tokens:
    """The words of a slice: distinct ones, the code of each, its language and piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        body, offsets = raw(batch.column("text"))
        self.body = LOWER[body]
        self.start, self.end, first = words(self.body, offsets, _GAP)
        self.codes, self.words = word_codes(self.body, self.start, self.end)
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        found = batch.column("lang").dictionary_encode()
        self.langs = [x.encode() for x in found.dictionary.to_pylist()]
        self.lang = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        cuts = np.cumsum(_BREAK[self.body])
        cut = cuts[self.start] if len(self.start) else np.zeros(0, np.int64)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (cut[1:] != cut[:-1])
        self.piece = np.cumsum(new)

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key of each token, the distinct keys, their counts); a key is a word of a language."""
        key = self.codes * max(1, len(self.langs)) + self.lang
        distinct, place, count = np.unique(key, return_inverse=True, return_counts=True)
        return place, distinct, count

    def name(self, key: int) -> tuple[bytes, bytes]:
        code, lang = divmod(int(key), max(1, len(self.langs)))
        return self.langs[lang], self.words[code]


def _crc(lang: bytes, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang + b"\0"))


class _Runs:
    """Integers for runs of codes, equal exactly for equal runs of one length.

    Runs of 2, 4 and 8 are named by doubling; any other is known by two of them that overlap.
    """

    def __init__(self, codes: np.ndarray, longest: int) -> None:
        self.names, width = {1: codes}, 1
        while 2 * width <= longest:
            name = self.names[width]
            later = np.append(name[width:], np.zeros(min(width, len(name)), np.int64))
            self.names[2 * width] = pd.factorize(name * (int(name.max(initial=0)) + 1) + later)[0].astype(np.int64)
            width *= 2

    def name(self, begin: np.ndarray, length: int) -> np.ndarray:
        width = 1 << (length.bit_length() - 1)
        name = self.names[width]
        return name[begin] * (int(name.max(initial=0)) + 1) + name[begin + length - width]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            tokens = _Tokens(batch)
            _, keys, count = tokens.known()
            names = [tokens.name(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang.decode() for lang, _ in names], pa.string()), pa.array([word.decode() for _, word in names], pa.string()),
                    pa.array([_crc(*n) for n in names], pa.int64()), pa.array(count, pa.int64()),
                ],
                names=["lang", "word", "crc", "n"],
            )


def _spans(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as a column."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    inside = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(body[inside])]).cast(pa.binary())


def _spaced(tokens: _Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, start, end): the words with one space behind each, so that a run of words is a run of bytes."""
    size = tokens.end - tokens.start + 1
    end = np.cumsum(size)
    start = end - size
    inside = np.repeat(tokens.start - start, size) + np.arange(end[-1] if len(end) else 0)
    body = np.append(tokens.body, np.uint8(0x20))[np.minimum(inside, len(tokens.body))]
    body[end - 1] = 0x20
    return body, start, end - 1


def fragments(tokens: _Tokens, cells: np.ndarray, hot: int = HOT) -> pa.RecordBatch:
    """Distinct fragments of a slice, packed: key of the group, and language, words, place of the pivot and occurrences.

    The key is the pivot's 32-bit address and, above it, the number of the group, 0 where the pivot has only one.
    """
    place, keys, _ = tokens.known()
    crc = np.array([_crc(*tokens.name(k)) for k in keys], np.int64)
    often = cells[crc % CELLS] if len(crc) else np.zeros(0, np.int64)
    order, address = often[place], crc[place]
    n = len(order)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for reach, step in ((left, -1), (right, 1)):
        going = order > 0
        for d in range(1, MOST):
            if n <= d:
                break
            near = np.zeros(n, bool)
            own, other = (slice(d, None), slice(None, -d)) if step < 0 else (slice(None, -d), slice(d, None))
            less = order[other] > order[own] if step < 0 else order[other] >= order[own]
            near[own] = less & (tokens.piece[other] == tokens.piece[own])
            going = going & near
            reach += going
    pivot = np.flatnonzero(left + right)
    begin, size, at = pivot - left[pivot], (left + right)[pivot] + 1, left[pivot]
    # equal fragments of a language: the same words, pivot and place
    runs = _Runs(place, 2 * MOST - 1)  # a key is a word of a language, so a run of keys has one language
    first, count = [], []
    for length in range(2, 2 * MOST):
        mine = np.flatnonzero(size == length)
        if not len(mine):
            continue
        same = runs.name(begin[mine], length) * MOST + at[mine]
        _, where, times = np.unique(same, return_index=True, return_counts=True)
        first.append(mine[where])
        count.append(times)
    first = np.concatenate(first) if first else np.zeros(0, np.int64)
    count = np.concatenate(count) if count else np.zeros(0, np.int64)
    body, start, end = _spaced(tokens)
    a, b = start[begin[first]], end[(begin + size - 1)[first]]
    groups = -(-order[pivot[first]] // hot)
    dealt = (word_hashes(body, a, b) % np.maximum(groups, 1).astype(np.uint64)).astype(np.int64) + 1
    key = address[pivot[first]] + np.where(groups > 1, dealt << 32, 0)
    # by pivot and language, each of which is one row; counts above a byte are several fragments
    lang = tokens.lang[pivot[first]]
    order = np.lexsort((lang, key))
    order = np.repeat(order, -(-count[order] // MOST_COUNT))
    times = np.minimum(count[order] - MOST_COUNT * _place_in_run(order), MOST_COUNT)
    new = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (lang[order][1:] != lang[order][:-1]))) if len(order) else order
    return pa.RecordBatch.from_arrays([pa.array(key[order][new]), _packed(tokens, body, a[order], b[order], at[first[order]], times, lang[order], new)], names=["key", "body"])


#: The largest count that a fragment holds.
MOST_COUNT = 127


def _place_in_run(values: np.ndarray) -> np.ndarray:
    """How many equal values stand right before each."""
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return np.arange(len(values)) - np.repeat(begins, np.diff(np.append(begins, len(values))))


def _packed(tokens: _Tokens, body: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, times: np.ndarray, lang: np.ndarray, new: np.ndarray) -> pa.Array:
    """A line with the language, then one for each fragment: the pivot's place as a digit and the count as a byte above 127, and the words."""
    codes = [b"_" + quote(x, safe="").encode() + b"\n" for x in tokens.langs]
    heads = np.frombuffer(b"".join(codes), np.uint8)
    length = np.array([len(c) for c in codes], np.int64)
    where = np.cumsum(length) - length
    size, lead = end - begin, np.zeros(len(begin), np.int64)
    lead[new] = length[lang[new]]
    stop = np.cumsum(lead + size + 4)
    start = stop - size - 4  # behind the language
    out = np.full(stop[-1] if len(stop) else 0, 0x20, np.uint8)
    out[start], out[start + 1], out[stop - 1] = 0x30 + at, 0x7F + times, 0x0A
    for source, first, n, to in ((body, begin, size, start + 3), (heads, where[lang[new]] if len(new) else new, lead[new], (start - lead)[new])):
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + steps] = source[np.repeat(first, n) + steps]
    offsets = np.append((start - lead)[new], len(out)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def mined(rows: pa.RecordBatch, least: int = LEAST) -> pa.RecordBatch:
    """The n-grams that hold the pivot of their fragment, with occurrences; of undivided pivots those that are frequent."""
    body, offsets = raw(rows.column("body"))
    start, end, first = words(body, offsets)
    codes, distinct = word_codes(body, start, end)
    row = np.repeat(np.arange(rows.num_rows), np.diff(first))
    kinds, lang = np.unique(codes[first[:-1]], return_inverse=True)
    langs = pa.array([unquote(distinct[k].decode()[1:]) for k in kinds], pa.string())
    # a line's first word says where its pivot is and how often it came, or is the language
    line = np.cumsum(body == 0x0A)[start]
    begins = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])))
    of = np.searchsorted(begins, np.arange(len(codes)), "right") - 1
    place, size = np.arange(len(codes)) - begins[of] - 1, np.diff(np.append(begins, len(codes)))[of] - 1
    head = start[begins]
    at, n = body[head].astype(np.int64)[of] - 0x30, body[head + 1].astype(np.int64)[of] - 0x7F
    split = (rows.column("key").to_numpy() >> 32) > 0
    runs, out = _Runs(codes, MOST), []
    for length in range(2, MOST + 1):
        use = np.flatnonzero((place >= 0) & (place <= at) & (at < place + length) & (place + length <= size))
        if not len(use):
            continue
        name = runs.name(use, length) * max(1, len(kinds)) + lang[row[use]]
        _, where, back = np.unique(name, return_index=True, return_inverse=True)
        total = np.zeros(len(where), np.int64)
        np.add.at(total, back, n[use])
        begin = use[where]
        keep = (total >= least) | split[row[begin]]
        begin, total = begin[keep], total[keep]
        out.append((begin, begin + length - 1, np.full(len(begin), length), total))
    begin, stop, length, total = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    return pa.RecordBatch.from_arrays(
        [
            langs.take(pa.array(lang[row[begin]])), _spans(body, start[begin], end[stop]).cast(pa.string()), pa.array(length.astype(np.int32)),
            pa.array(total), pa.array(split[row[begin]]),
        ],
        names=["lang", "phrase", "size", "a", "partial"],
    )


def _mine(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by key; whole groups are mined together, some at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in (part for whole in batches for part in slices(whole, "body", MINED_BYTES)):
        held.append(batch)
        size += int(lengths(batch.column("body")).sum())
        if size < MINED_BYTES:
            continue
        together = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = together.column("key").to_numpy()
        done = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if done:
            yield mined(together.slice(0, done), least)
        held = [together.slice(done)]
        size = int(lengths(held[0].column("body")).sum()) if done else 0  # a group beyond that size waits for as much again
    if held:
        yield mined(pa.Table.from_batches(held).combine_chunks().to_batches()[0], least)


def phrases(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): (lang, phrase, size, a) of all frequent n-grams; (lang, word, n) of frequent words and, with a null word, of all others."""
    spark = docs.sparkSession
    ship_package(spark)
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = given.mapInArrow(_count_words, "lang string, word string, crc long, n long").groupBy("lang", "word", "crc").agg(F.sum("n").alias("n"))
    often = F.col("n") >= least
    named = counted.select("lang", F.when(often, F.col("word")).alias("word"), F.when(often, F.col("crc")).alias("crc"), "n")
    known = materialize(named.groupBy("lang", "word", "crc").agg(F.sum("n").alias("n")), "words")
    table = known.where("word is not null").groupBy((F.col("crc") % CELLS).alias("cell")).agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    cells = np.zeros(CELLS, np.int64)
    cells[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(cells)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield fragments(_Tokens(batch), sent.value, hot)

    routed = given.mapInArrow(cut, "key long, body binary").repartition("key").sortWithinPartitions("key")
    found = materialize(routed.mapInArrow(lambda it: _mine(it, least), "lang string, phrase string, size int, a long, partial boolean"), "mined")
    # what belongs to one undivided pivot is complete; the rest is summed up
    summed = found.where("partial").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return materialize(found.where("not partial").drop("partial").unionByName(summed), "phrases"), known.drop("crc")


def scored(found: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the cut with the least score; of equal ones the first."""
    total = materialize(known.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    parts = materialize(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(known.where("word is not null").select("lang", "word", "n").toDF("lang", "part", "f")), "parts")
    w = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "a", w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, MOST), " ").alias("rest"))
    both = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
    number = lambda c: F.col(c).cast("decimal(18,0)")
    both = both.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * number("n"), "down": number("l") * number("r")})
    score = F.expr("up div down")
    best = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def standing(found: DataFrame) -> DataFrame:
    """The candidates that lie in no longer one with as many occurrences: (lang, phrase, size, a)."""
    w = F.split("phrase", " ")
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(0), F.col("size") - s), lambda i: F.array_join(F.slice(w, i + 1, s), " "))))
    inside = found.where("size > 2").select("lang", F.col("a").alias("over"), F.explode(F.array_distinct(shorter)).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    return found.join(most, ["lang", "phrase"], "left").where("over is null or 100 * over < 100 * a").drop("over")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    found, known = phrases(docs, least, hot)
    rows = scored(found, known).join(standing(found).select("lang", "phrase"), ["lang", "phrase"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first the best of each of 64 shares of a language, so that no task sorts all of one
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
