"""Language and quality of whole texts, by byte convolutional networks trained on labelled rows.

A bounded sample of the labelled rows trains the network: up to SAMPLE rows of each class (TOTAL in all, or one each), those with the smallest
hash of their id and text, whatever their length. A few windows of each, at hashed places, are cut out by the executors,
and only those reach the driver. Prediction reads every byte of every text, in windows.

``language``: windows of LANGUAGE_WINDOW bytes, side by side; the probabilities of the windows are averaged by length.
Null texts and texts without letters are ``und`` with score 0, and so is all if nothing is labelled.
``quality``: chunks of QUALITY_CHUNK bytes that overlap by half and cover the whole text; the log odds of the chunks
are averaged into one probability. Null texts count as empty; empty texts are scored as one chunk of padding.
Rows with null ids and repeated rows keep a row each. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .byte_cnn import ByteConvNet, padded_windows
from .bytesops import raw, slices
from .common import unused

SAMPLE = 1000
LANGUAGE_WINDOW, QUALITY_CHUNK = 512, 512
#: All languages are learned; beyond TOTAL / SAMPLE of them the sample of each shrinks, to one row at least.
TOTAL = 256_000
#: Probabilities (cells x languages) that are held together.
HELD = 1 << 20
SLICE = 128 << 10


def _smallest(ids: DataFrame, label: str, each: int | None = None) -> DataFrame:
    """Of each label the ``each`` (SAMPLE) rows with the smallest (_h, _id).

    Hashes are counted in 4096 ranges first. Only the ranges up to the one that completes the sample are ranked, so
    the task of a label reads little more than the sample, however many rows and tasks there are.
    """
    each = SAMPLE if each is None else each
    ranged = ids.withColumn("_range", F.shiftright("_h", 52))
    counts = ranged.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    last = (
        counts.withColumn("_before", F.coalesce(before, F.lit(0)))
        .groupBy(label).agg(F.max(F.when(F.col("_before") < each, F.col("_range"))).alias("_last"))
    )
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", "_id"))
    few = ranged.join(F.broadcast(last), label).where(F.col("_range") <= F.col("_last"))
    return few.withColumn("_r", rank).where(F.col("_r") <= each)


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _cut(text: Column, key: Column, size: int, most: int) -> Column:
    """Up to ``most`` windows of ``size`` bytes, at places that ``key`` decides; texts of one window give that."""
    n = F.octet_length(text)
    count = F.greatest(F.least(F.lit(most), F.ceil(n / size)), F.lit(1)).cast("int")
    place = lambda k: F.pmod(F.xxhash64(key, k), F.greatest(n - size + 1, F.lit(1)).cast("long")).cast("int") + 1
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.substring(text.cast("binary"), place(k), F.lit(size)))


def _sample(keyed: DataFrame, ids: DataFrame, kind: str, size: int, most: int, each: int | None = None) -> list[tuple[bytes, object]]:
    """(window, label) of a bounded number of rows for each label.

    ``keyed``(_id, _h, text): the rows; ``ids``(_id, _h, _label): their labels, of SQL type ``kind``.
    """
    # repeated rows are one, so they neither fill the sample nor gather in one task
    picked = _smallest(ids.select("_id", "_h", "_label").distinct(), "_label", each).select("_id", "_h", "_label").collect()
    if not picked:
        return []
    wanted = keyed.sparkSession.createDataFrame(picked, f"_id {dict(ids.dtypes)['_id']}, _h long, _label {kind}")
    same = (keyed["_h"] == wanted["_h"]) & keyed["_id"].eqNullSafe(wanted["_id"])
    found = keyed.join(F.broadcast(wanted), same).select(
        wanted["_id"], wanted["_h"], "_label", _cut(keyed["text"], wanted["_h"], size, most).alias("_windows")
    )
    return sorted((bytes(w), r._label) for r in found.dropDuplicates(["_id", "_h", "_label"]).collect() for w in r._windows)


def _pooled(net: ByteConvNet, texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pooled responses, bytes, row) of the cells of ``size`` bytes that the padded texts are cut into.

    A text is padded with as many zeros as the widest filter looks ahead, and as many again separate it from the
    next, so that no text has a part in another's responses.
    """
    pad = max(net.widths) - 1
    body, offsets = raw(texts)
    length = np.diff(offsets)
    rows = len(length)
    data = np.zeros(len(body) + 2 * pad * rows, np.uint8)
    data[np.arange(len(body)) + 2 * pad * np.repeat(np.arange(rows), length)] = body
    begin, padded = offsets[:-1] + 2 * pad * np.arange(rows), length + pad
    count = -(-padded // size)
    row = np.repeat(np.arange(rows), count)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
    start = begin[row] + place
    # the zeros between the texts are cells of their own, which are dropped
    cut = np.sort(np.concatenate([start, begin + padded]))
    cell = np.isin(cut, start, assume_unique=True)
    return net.pooled(data, cut)[cell], np.minimum(padded[row] - place, size), row


def train_language(docs: DataFrame, learn: Column) -> tuple[ByteConvNet | None, list[str]]:
    labelled = docs.where(learn).where("lang is not null and text is not null")
    keyed = labelled.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_h"), "text", F.col("lang").alias("_label"))
    each = max(1, min(SAMPLE, TOTAL // max(1, labelled.select("lang").distinct().count())))
    sample = _sample(keyed.select("_id", "_h", "text"), keyed.select("_id", "_h", "_label"), "string", LANGUAGE_WINDOW, 3, each)
    names = sorted({label for _, label in sample})
    if not names:
        return None, []
    number = {x: n for n, x in enumerate(names)}
    net = ByteConvNet(len(names))
    net.fit(padded_windows([w for w, _ in sample], LANGUAGE_WINDOW), np.array([number[x] for _, x in sample]), epochs=4)
    return net, names


def language(docs: DataFrame, learn: Column) -> DataFrame:
    """``docs`` with all columns, and _lang_pred, _lang_score, which it has not itself. ``learn``: which rows may train."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(train_language(docs, learn))
    (letters,) = unused(docs, "_letters")
    given = docs.withColumn(letters, has_letters(F.col("text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _lang_pred string, _lang_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, names = shared.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                rows = batch.num_rows
                labels, scores = np.full(rows, "und", object), np.zeros(rows)
                if net is not None:
                    pooled, weight, row = _pooled(net, batch.column("text"), LANGUAGE_WINDOW)
                    total = np.zeros((rows, len(names)))
                    step = max(1, HELD // len(names))
                    for at in range(0, len(row), step):
                        part = slice(at, at + step)
                        np.add.at(total, row[part], net.probabilities(pooled[part]) * weight[part, None])
                    total /= np.bincount(row, weight, rows)[:, None]
                    ok = batch.column(letters).to_numpy(zero_copy_only=False)
                    best = total.argmax(axis=1)
                    labels[ok] = np.array(names, object)[best[ok]]
                    scores[ok] = np.clip(total[np.arange(rows), best], 0, 1)[ok]
                kept = [c for c in batch.schema.names if c != letters]
                columns = [*map(batch.column, kept), pa.array(labels, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_lang_pred", "_lang_score"])

    return given.mapInArrow(run, schema)


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column) -> ByteConvNet | None:
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.where(learn).select(F.col("doc_id").alias("_of"), F.col("quality").alias("_label"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", text).alias("_h"), text.alias("text"))
    ids = keyed.select("_id", "_h").join(marks, F.col("_id") == F.col("_of")).select("_id", "_h", "_label")
    sample = _sample(keyed, ids, "int", QUALITY_CHUNK, 4)
    if len({q for _, q in sample}) < 2:
        return None
    net = ByteConvNet(2)
    net.fit(padded_windows([w for w, _ in sample], QUALITY_CHUNK), np.array([q for _, q in sample]), epochs=8)
    return net


def quality(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, held_out, score for each document. ``learn``: over doc_id, which labels may train."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(train_quality(docs, labels, learn))
    half = QUALITY_CHUNK // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                rows = batch.num_rows
                scores = np.full(rows, 0.5)
                if net is not None:
                    cell, _, row = _pooled(net, batch.column("text"), half)
                    # a chunk is a cell and the next one of the same text; the last cell closes the last chunk
                    joined = np.flatnonzero(row[1:] == row[:-1])
                    single = np.flatnonzero(np.bincount(row, minlength=rows)[row] == 1)
                    pooled = np.concatenate([np.maximum(cell[joined], cell[joined + 1]), cell[single]])
                    owner = np.concatenate([row[joined], row[single]])
                    p = np.clip(net.probabilities(pooled)[:, 1].astype(float), 1e-6, 1 - 1e-6)
                    odds = np.bincount(owner, np.log(p / (1 - p)), rows) / np.maximum(np.bincount(owner, minlength=rows), 1)
                    scores = 1 / (1 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], names=["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    given = docs.select("doc_id", (~learn).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
