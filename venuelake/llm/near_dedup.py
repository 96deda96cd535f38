r"""Near-duplicate documents: fast similarity sketching, banding, exact verification on full shingle sets.

1. Every text becomes the set of its distinct word shingles (five words unless told otherwise; ASCII lower case, words
   ``[^\x20\x09-\x0D]+``; with fewer words the whole sequence). Texts with the same words in the same order form a
   class, named by the SHA-256 of the words, and one row stands for it.
2. A class is sketched in rounds. In round i < t each element is thrown into one of the t bins; in round t + j all
   go into bin j, so that after 2t rounds at the latest no bin is empty. A bin keeps the least value of the first
   round that reached it. Equal coordinates estimate the similarity with the concentration of t samples.
3. BANDS bands of ROWS coordinates each put classes into buckets. A bucket links each member to another one that
   has a similar size and whose 1-bit signature (all t coordinates) is not far off, as a spanning forest, so a
   bucket gives fewer rows than it has members. The components of these candidates are families.
4. The candidates are verified, a row each, on the two full texts: links have 100 * intersection >= 80 * union.
   A family that the links hold together is done; a hot family of near copies ends here, after as many comparisons
   as it has candidates.
5. In other families members may still be linked across the parts that the links make. They are cut into blocks, a
   large part into its own and small parts into common ones, and pairs of blocks are verified through an inverted
   index, except inside one part. Nothing is capped, and a task holds two blocks.
6. The components of all links are the result.

Sketches work on 64-bit hashes, which only decide what is compared. Sets and their sizes are exact: shingles are
compared by their words, or by names that are equal exactly for equal words (``run_names``).

A link at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6; the signature cut is over
five standard deviations below. Null or empty texts and texts without words are linked with nothing. Ids may be of
any type that can be ordered; a component is called by its smallest id. Rows with a null id take no part: they
have their own component (null) and are kept. Of repeated rows with one id all count as kept if it is the smallest;
rows that share an id but not the text are documents of their own. Columns other than doc_id and text are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bytesops import LOWER, digests, gram_hashes, mix, raw, run_names, slices, word_codes, words
from .common import content_key, keep_rows, materialize, release
from .graph import connected_components

SHINGLE, PERCENT = 5, 80
COORDS, BANDS, ROWS = 256, 24, 4
#: Least estimated similarity of signatures that a bucket links (t = 256 bits: 0.8 less over six deviations).
SIGNATURE_FLOOR = 0.56
#: Members of a bucket compared with each other; a larger bucket links all of them to one, which only adds candidates.
BUCKET_PAIRS = 2048
#: Shingles of a family in one block; a pair of blocks is verified in one task.
BLOCK_SHINGLES = 50_000
_LOWER = bytes(LOWER)


def folded(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.translate(_LOWER).split()


def shingle_set(found: list[bytes], shingle: int = SHINGLE) -> frozenset[tuple[bytes, ...]]:
    if len(found) < shingle:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(*(found[k:] for k in range(shingle))))


def linked(a: frozenset, b: frozenset) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, hashes, first): the distinct shingles of each row, and where each row's begin.

    A name is equal in two rows exactly if the words of the shingle are; hashes of equal shingles are equal anywhere.
    """
    body, offsets = raw(texts)
    body = LOWER[body]
    start, end, first = words(body, offsets)
    codes, distinct = word_codes(body, start, end)
    rows, count = len(first) - 1, np.diff(first)
    hashes, row = gram_hashes(digests(distinct)[:, 0][codes], first, shingle)
    place = np.arange(len(codes)) - np.repeat(first[:-1], count)
    at = np.flatnonzero(place + np.repeat(np.minimum(count, shingle), count) <= np.repeat(count, count))
    name = run_names(codes, shingle)[at] if len(codes) else np.zeros(0, np.int64)
    few = count[row] < shingle  # the whole sequence: equal in two rows only if the rows are of one class
    name = np.where(few, -1 - row, name) + rows
    new = ~pd.Series(row * (int(name.max(initial=0)) + 1) + name).duplicated().to_numpy()
    return name[new], hashes[new], np.searchsorted(row[new], np.arange(rows + 1))


def sketches(value: np.ndarray, first: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """rows x coords fast similarity sketch; rows without elements are all zero."""
    rows = len(first) - 1
    out = np.zeros((rows, coords), np.uint64)
    live = np.flatnonzero(np.diff(first))  # rows with a bin that is still empty
    filled = np.zeros((len(live), coords), bool)
    h, r = value, np.repeat(np.arange(len(live)), np.diff(first)[live])
    most = np.iinfo(np.uint64).max
    for i in range(2 * coords):
        if not len(live):
            break
        x = mix(h + np.uint64(0x632BE59BD9B4E019 * (i + 1) & (1 << 64) - 1))
        bins = (x >> np.uint64(40)).astype(np.int64) % coords if i < coords else i - coords
        best = np.full(len(live) * coords, most, np.uint64)
        np.minimum.at(best, r * coords + bins, x >> np.uint64(1))
        best = best.reshape(len(live), coords)
        hit = (best != most) & ~filled
        row, col = np.nonzero(hit)
        out[live[row], col] = mix(best[hit] + np.uint64(i))
        filled |= hit
        todo = ~filled.all(axis=1)
        if not todo.all():
            keep = todo[r]
            place = np.cumsum(todo) - 1
            h, r = h[keep], place[r[keep]]
            live, filled = live[todo], filled[todo]
    return out


_SKETCHED = "_k1 long, _k2 long, text binary, rid long, class binary, n long, bands array<long>, bits binary"


def _sketch_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            _, value, first = shingle_sets(batch.column("text"), shingle)
            sk = sketches(value, first)
            rows = batch.num_rows
            band = np.zeros((rows, BANDS), np.uint64)
            for b in range(BANDS):
                k = np.full(rows, b + 1, np.uint64)
                for c in range(b * ROWS, (b + 1) * ROWS):
                    k = mix(k * np.uint64(0xD6E8FEB86659FD93) + sk[:, c])
                band[:, b] = k
            bits = np.packbits((sk & np.uint64(1)).astype(bool), axis=1)
            named = [hashlib.sha256(b" ".join(folded(x.as_py()))).digest() for x in batch.column("text")]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(band.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "_k1", "_k2", "text", "rid")), pa.array(named, pa.binary()),
                    pa.array(np.diff(first).astype(np.int64)), bands, pa.array([x.tobytes() for x in bits], pa.binary()),
                ],
                names=["doc_id", "_k1", "_k2", "text", "rid", "class", "n", "bands", "bits"],
            )


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _similar(bits: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket that may be linked, by signature and size."""
    differ = int(COORDS * (1 - SIGNATURE_FLOOR) / 2)
    wide = bits.view(np.uint64).reshape(len(bits), -1)
    for i in range(len(bits) - 1):
        d = np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(axis=1)
        lo, hi = np.minimum(n[i + 1 :], n[i]), np.maximum(n[i + 1 :], n[i])
        for j in np.flatnonzero((d <= differ) & (100 * lo >= PERCENT * hi)).tolist():
            yield i, i + 1 + j


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary())], names=["a", "b"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by key; a bucket may go on in the next batch. At most BUCKET_PAIRS rows are held."""
    key = None
    ids: list[bytes] = []
    bits: list[bytes] = []
    size: list[int] = []
    hub = None  # of a bucket that has outgrown the pairs
    out: list[tuple[bytes, bytes]] = []

    def close() -> None:
        if len(ids) == 2 and not (100 * min(size) >= PERCENT * max(size)):
            return
        if len(ids) > 1:
            pairs = _forest(len(ids), _similar(np.frombuffer(b"".join(bits), np.uint8).reshape(len(ids), -1), np.array(size)))
            out.extend((ids[a], ids[b]) for a, b in pairs)

    for batch in batches:
        keys = batch.column("key").to_numpy()
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        alone = ~same[:-1] & ~same[1:]
        if len(keys):
            alone[0] = alone[-1] = False
        c, b, s = batch.column("class"), batch.column("bits"), batch.column("n")
        for i in np.flatnonzero(~alone).tolist():
            if keys[i] != key:
                if hub is None:
                    close()
                key, hub = keys[i], None
                ids, bits, size = [], [], []
            if hub is not None:
                out.append((hub, c[i].as_py()))
                continue
            ids.append(c[i].as_py())
            bits.append(b[i].as_py())
            size.append(s[i].as_py())
            if len(ids) > BUCKET_PAIRS:
                hub = ids[0]
                out.extend((hub, x) for x in ids[1:])
                ids, bits, size = [], [], []
        if out:
            yield _pairs(out)
            out.clear()
    if hub is None:
        close()
    if out:
        yield _pairs(out)


def _verify_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Of candidates (a, b, left, right: the texts) those that are links. Rows with one ``a`` mostly follow each other."""
    last, mine = None, frozenset()
    for batch in batches:
        good = []
        for a, left, right in zip(*(batch.column(c) for c in ("a", "left", "right"))):
            if a.as_py() != last:
                last, mine = a.as_py(), shingle_set(folded(left.as_py()), shingle)
            good.append(linked(mine, shingle_set(folded(right.as_py()), shingle)))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified_links(value: np.ndarray, first: np.ndarray, *apart: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i > j) of rows with 100 * intersection >= PERCENT * union, counted through an inverted index.

    ``apart``: numbers of the rows; pairs of rows with the same number in any of them are left out.
    """
    rows = len(first) - 1
    n = np.diff(first)
    row_of = np.repeat(np.arange(rows), n)
    order = np.argsort(value, kind="stable")
    sorted_value, holders = value[order], row_of[order]
    lo = np.searchsorted(sorted_value, value, "left")
    hi = np.searchsorted(sorted_value, value, "right")
    shared = hi - lo > 1
    for i in range(1, rows):
        mine = slice(first[i], first[i + 1])
        use = shared[mine]
        spans = np.stack([lo[mine][use], hi[mine][use]], axis=1)
        if not len(spans):
            continue
        size = spans[:, 1] - spans[:, 0]
        at = np.repeat(spans[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        overlap = np.bincount(holders[at], minlength=rows)[:i]
        good = 100 * overlap >= PERCENT * (n[i] + n[:i] - overlap)
        for number in apart:
            good &= number[:i] != number[i]
        for j in np.flatnonzero(good & (overlap > 0)).tolist():
            yield i, j


def _verify_blocks(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by (fam, bi, bj); groups of bounded bytes are verified one after the other."""
    held: list[tuple[bytes, bytes, bool, bytes]] = []
    key = None

    def close() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            names, _, first = shingle_sets(pa.array([h[3] for h in held], pa.large_binary()), shingle)
            apart = [np.unique([h[1].hex() for h in held], return_inverse=True)[1]]
            if key[1] != key[2]:  # pairs inside one block are another task's
                apart.append(np.array([h[2] for h in held]))
            pairs = _forest(len(held), verified_links(names, first, *apart))
            if pairs:
                yield _pairs([(held[a][0], held[b][0]) for a, b in pairs])

    for batch in batches:
        for *k, node, part, left, text in zip(*(batch.column(c) for c in ("fam", "bi", "bj", "node", "part", "left", "text"))):
            k = [x.as_py() for x in k]
            if k != key:
                yield from close()
                key, held = k, []
            held.append((node.as_py(), part.as_py(), left.as_py(), text.as_py()))
    yield from close()


def _across(members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Links of families in several parts. ``members``: node, fam, part, n."""
    whole = members.groupBy("fam", "part").agg(F.sum("n").alias("weight"))
    whole = whole.withColumn("own", F.when(F.col("weight") > BLOCK_SHINGLES, F.ceil(F.col("weight") / F.lit(BLOCK_SHINGLES)).cast("int")).otherwise(0))
    # written, so that a large family is met by plain exchanges
    whole = materialize(whole, "whole")
    common = materialize(whole.where("own = 0").groupBy("fam").agg(F.ceil(F.sum("weight") / F.lit(BLOCK_SHINGLES)).cast("int").alias("common")), "common")
    # a block: the part that has it for itself, or none, and a number
    alone = whole.where("own > 0").select("fam", F.col("part").alias("of"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("number"))
    shared = common.select("fam", F.lit(b"").alias("of"), F.explode(F.sequence(F.lit(0), F.col("common") - 1)).alias("number"))
    blocks = materialize(alone.unionByName(shared).select("fam", F.struct("of", "number").alias("block")), "blocks")
    placed = members.join(whole, ["fam", "part"]).join(common, "fam", "left")
    number = F.pmod(F.xxhash64("node"), F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("common"))).cast("int")
    of = F.when(F.col("own") > 0, F.col("part")).otherwise(F.lit(b""))
    placed = materialize(placed.select("node", "fam", "part", F.struct(of.alias("of"), number.alias("number")).alias("block")), "placed")
    tasks = placed.join(blocks.withColumnRenamed("block", "other"), "fam").where(
        "block.of != other.of or length(block.of) = 0"  # pairs of blocks of one part are left out
    )
    tasks = tasks.select(
        "node", "fam", "part", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") <= F.col("other")).alias("left")
    )
    tasks = tasks.join(texts.hint("merge"), "node").repartition("fam", "bi", "bj").sortWithinPartitions("fam", "bi", "bj", "node")
    tasks = tasks.select("fam", F.to_json("bi").alias("bi"), F.to_json("bj").alias("bj"), "node", "part", "left", "text")
    return tasks.mapInArrow(lambda it: _verify_blocks(it, shingle), "a binary, b binary")


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and the address of its text (_k1, _k2)."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    given = docs.select(
        "doc_id", *content_key(F.col("text")), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("rid")
    )
    rows = materialize(
        given.mapInArrow(lambda it: _sketch_rows(it, shingle), f"doc_id {kind}, {_SKETCHED}"), "sketches"
    )
    whole = rows.where("doc_id is not null and n > 0")
    # the written row that stands for a class, and its smallest id
    classes = materialize(whole.groupBy("class").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid")), "classes")
    # texts and sketches are joined by sort and merge at any size, as they have to be where it counts
    stands = rows.join(classes.select("rid").hint("merge"), "rid")
    buckets = stands.select(F.explode("bands").alias("key"), "class", "n", "bits").repartition("key").sortWithinPartitions("key", "class")
    near = materialize(buckets.mapInArrow(_bucket_links, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    families = materialize(connected_components(near, "families"), "families")
    # by the number of the row, so that only texts of members move if they are few
    member = materialize(families.join(classes.select(F.col("class").alias("node"), "rid"), "node").select("node", "rid"), "member")
    texts = materialize(rows.select("rid", "text", "n").join(member.hint("merge"), "rid").select("node", "text", "n"), "texts")
    # the hub of a hot bucket is met last, by a join that can be split
    right = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")).hint("merge"), "b")
    pairs = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    links = materialize(pairs.select("a", "b", "left", "right").mapInArrow(lambda it: _verify_rows(it, shingle), "a binary, b binary"), "links")
    parts = materialize(connected_components(links, "parts").withColumnRenamed("root", "part"), "parts")
    members = families.withColumnRenamed("root", "fam").join(parts, "node", "left").select("node", "fam", F.coalesce("part", "node").alias("part"))
    open_families = members.groupBy("fam").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("fam")
    members = materialize(members.join(materialize(open_families, "open"), "fam").join(texts.select("node", "n"), "node"), "members")
    if not members.isEmpty():
        links = links.unionByName(_across(members, texts.select("node", "text"), shingle))
    components = materialize(connected_components(links, "components"), "components")
    named = classes.join(components, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    # written, so that the join has plain exchanges and a large class can be split
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    by_class = materialize(named.join(smallest, "root").select("class", "component_id"), "by-class")
    release(near, families, member, texts, links, parts, members, components, smallest, classes)
    found = rows.select("doc_id", "_k1", "_k2", "class", "n").join(by_class, "class", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "_k1", "_k2")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with all columns, without the documents that are linked with one of a smaller id."""
    return keep_rows(docs, near_groups(docs, shingle).where("kept"))
