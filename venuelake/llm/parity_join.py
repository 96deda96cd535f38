r"""Jaccard join of word n-gram sets by parity sketches.

A token (an n-gram of words) flips one bit of a bit sketch, so a sketch holds the parity of the tokens at each bit, and
the Hamming distance of two sketches is never more than the symmetric difference of the two sets. Sets of s1 and s2
tokens that link at PERCENT differ in at most (100 - PERCENT) * (s1 + s2) / (100 + PERCENT) tokens.

1. Every text becomes the set of its distinct n-grams. Texts with the same words in the same order form a class, and
   one row stands for it; the number of that row is its node.
2. Size bands overlap so that the two sizes of a link always lie together in one. In a band with at most D differences
   the sketch is cut into more than D segments of ``SEGMENT_BITS`` bits, of which one at least is equal for a link.
   Long sketches are kept as what each segment holds: the exclusive or of numbers that stand for its odd bits.
3. A set sends its first segments until as many as its own D allows, and one, are not empty. Two linked sets so meet in
   a segment that is not empty: of those that the one of them sends first, not all can differ. A set with too few
   such segments sends all, empty ones too.
4. In each bucket of equal segments every member is compared with one member only, the same for all: first by sizes
   and by short sketches of ``SHORT`` bits, which every row has, then, what these allow, on the words. This ends groups
   of near copies of any size after as many comparisons as they have members.
5. Buckets whose other members the links so far leave in several components are looked at again: all pairs across
   components that the short sketches allow are verified, or, if they are more than ``FEW`` a member, a spanning forest
   of them. Where a pair of a forest fails, the sets themselves (64-bit tokens) are compared, after sketches of at
   least ``DENSE`` bits a token that the task makes of them, and the forest is of true links. Buckets of equal members
   are looked at once. A bucket of more than ``BLOCK`` members is compared in blocks, a task each pair of blocks.
6. The components of all links are the result.

Texts are only sent to where they are compared: a bitmap of fixed size (``BITMAP_BITS``), the one thing that is
broadcast, holds the rows in question, and what it lets through besides is dropped by the joins.

Null or empty texts and texts without words are linked with nothing. Rows with a null id take no part; their component
is null. Ids may be of any type that can be ordered. Rows that share an id but not the text are documents of their own;
repeated rows get a row each. Columns other than doc_id and text are not used. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bytesops import mix, slices
from .common import materialize, release
from .graph import connected_components
from .near_dedup import folded, shingle_set, shingle_sets

SHINGLE, PERCENT = 4, 85
SEGMENT_BITS = 1 << 20
SHORT, DENSE = 1024, 32
BLOCK = 4096
#: Possible pairs for each member up to which a bucket has all of them verified.
FEW = 8
#: Bits of the bitmap of rows that is broadcast (4 MB).
BITMAP_BITS = 25
#: A band's largest size over the smallest size that is new in it.
WIDTH = 2


def differences(sizes: int | np.ndarray) -> int | np.ndarray:
    """The most tokens in which two linked sets differ that have ``sizes`` tokens together."""
    return sizes * (100 - PERCENT) // (100 + PERCENT)


def bands(largest: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, segments) of the bands for sets of up to ``largest`` tokens."""
    out, high = [], 0
    while high < largest:
        low = -(-(high + 1) * PERCENT // 100)  # the smallest partner of the smallest new size
        high = max(6, high * WIDTH)
        most = differences(2 * high)
        out.append((low, high, 1 if most == 0 else most + 3 + most // 32))
    return out


def segment_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the segments that each set sends, of all bands that it lies in."""
    size = np.diff(first)
    keys, rows = [], []
    for number, (low, high, parts) in enumerate(bands(int(size.max(initial=0)))):
        mine = np.flatnonzero((size >= low) & (size <= high))
        if not len(mine):
            continue
        own = size[mine]
        count = np.repeat(own, own)
        row = np.repeat(np.arange(len(mine)), own)
        at = np.repeat(first[mine] - (np.cumsum(own) - own), own) + np.arange(len(count))
        x = mix(hashes[at] ^ mix(np.full(1, number + 1, np.uint64)))
        segment = ((x >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        bit = x % np.uint64(SEGMENT_BITS)
        # where two tokens share a bit their numbers cancel, as its parity says
        place = row * parts + segment
        order = np.argsort(place, kind="stable")
        place, odd = place[order], mix(bit[order] + np.uint64(SEGMENT_BITS))
        begins = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        held, place = np.bitwise_xor.reduceat(odd, begins), place[begins]
        filled = held != 0
        held, place = held[filled], place[filled]
        row = place // parts
        # the most differences with any partner of this band
        due = differences(own + np.minimum(high, own * 100 // PERCENT)) + 1
        ends = np.searchsorted(row, np.arange(len(mine) + 1))
        rank = np.arange(len(row)) - ends[row]
        send = rank < due[row]
        key, to = [mix(held[send] ^ mix((place % parts)[send].astype(np.uint64) + (np.uint64(number + 1) << np.uint64(32))))], [mine[row[send]]]
        for r in np.flatnonzero(np.diff(ends) < due).tolist():
            empty = np.setdiff1d(np.arange(parts), place[ends[r] : ends[r + 1]] % parts)
            key.append(mix(mix(empty.astype(np.uint64) + (np.uint64(number + 1) << np.uint64(32)))))
            to.append(np.full(len(empty), mine[r]))
        keys += key
        rows += to
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def dense_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bytes of a sketch with a power of two of bits, at least DENSE for each token."""
    bits = 1 << max(9, (DENSE * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bytes: bits that fall together add their parities."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def short_sketches(hashes: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """rows x bytes: sketches that have ``bits`` bits, whatever the size of the set."""
    size = np.diff(first)
    place = np.repeat(np.arange(len(size)), size) * bits + (hashes & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=len(size) * bits) & 1
    return np.packbits(odd.astype(bool)).reshape(len(size), bits // 8)


_ROWS = "rid long, class binary, n long, short binary, text binary"


def _set_rows(batches: Iterator[pa.RecordBatch], shingle: int, bits: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            _, hashes, first = shingle_sets(batch.column("text"), shingle)
            short = [x.tobytes() for x in short_sketches(hashes, first, bits)]
            named = [hashlib.sha256(b" ".join(folded(x.as_py()))).digest() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("rid"), pa.array(named, pa.binary()), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(short, pa.binary()), batch.column("text"),
                ],
                names=["doc_id", "rid", "class", "n", "short", "text"],
            )


def _key_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            _, hashes, first = shingle_sets(batch.column("text"), shingle)
            key, row = segment_keys(hashes, first)
            node = batch.column("rid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[row])], names=["key", "node"])


def _token_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(node, n, held): the sorted 64-bit tokens."""
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            _, hashes, first = shingle_sets(batch.column("text"), shingle)
            held = [np.sort(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(np.diff(first)), pa.array(held, pa.binary())], names=["node", "n", "held"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by (key, node): each further member of a bucket with its first one."""
    key = hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        new = np.append(True, keys[1:] != keys[:-1])
        new[0] = key is None or keys[0] != key
        begins = np.flatnonzero(new)
        of = np.searchsorted(begins, np.arange(len(keys)), "right") - 1
        hubs = np.where(of < 0, 0 if hub is None else hub, nodes[begins[np.maximum(of, 0)]] if len(begins) else 0)
        key, hub = keys[-1], hubs[-1]
        use = hubs != nodes
        yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (keys, hubs, nodes)], names=["key", "hub", "node"])


def _possible_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, and the size and short sketch of each) the pairs that may be links."""
    for batch in batches:
        if not batch.num_rows:
            continue
        m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(n), -1) for c in ("left", "right"))
        apart = np.bitwise_count(left ^ right).sum(axis=1)
        good = (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)) & (apart <= differences(m + n))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def linked(a: frozenset, b: frozenset) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Of candidates (a, b, left, right: the texts) those that are links. Rows with one ``a`` mostly follow each other."""
    last, mine = None, frozenset()
    for batch in batches:
        good = []
        for a, left, right in zip(batch.column("a").to_pylist(), batch.column("left"), batch.column("right")):
            if a != last:
                last, mine = a, shingle_set(folded(left.as_py()), shingle)
            good.append(linked(mine, shingle_set(folded(right.as_py()), shingle)))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


class _Bucket:
    """Members of a bucket, and the pairs across components that are near enough, or a forest of them."""

    def __init__(self, exact: bool, few: int = FEW) -> None:
        self.exact, self.few = exact, few
        self.node, self.part, self.n, self.left = [], [], [], []
        self.held: list[np.ndarray] = []

    def add(self, node: int, part: int, n: int, left: bool, held: bytes) -> None:
        self.node.append(node)
        self.part.append(part)
        self.n.append(n)
        self.left.append(left)
        self.held.append(np.frombuffer(held, np.uint64 if self.exact else np.uint8))

    def apart(self, i: int, j: int) -> int:
        return self.n[i] + self.n[j] - 2 * len(np.intersect1d(self.held[i], self.held[j], assume_unique=True))

    def pairs(self, across: bool) -> tuple[list[tuple[int, int]], bool]:
        """The pairs, and whether they are all; ``across``: only those of different blocks."""
        part, n, left = np.array(self.part), np.array(self.n), np.array(self.left)
        given, most = part.copy(), 0 if self.exact else self.few * len(part)
        dense = [dense_sketch(x) for x in self.held] if self.exact else self.held
        size = min(len(x) for x in dense)
        sketches = np.stack([fold(x, size) for x in dense]).view(np.uint64)
        every, forest = [], []
        for i in range(1, len(part)):
            of = part if len(every) > most or self.exact else given
            use = of[:i] != of[i]
            if across:
                use &= left[:i] != left[i]
            use &= (100 * np.minimum(n[:i], n[i]) >= PERCENT * np.maximum(n[:i], n[i]))
            other = np.flatnonzero(use)
            if not len(other):
                continue
            apart = np.bitwise_count(sketches[other] ^ sketches[i]).sum(axis=1)
            for j in other[apart <= differences(n[other] + n[i])].tolist():
                if len(every) <= most:
                    every.append((j, i))
                if part[j] != part[i] and (not self.exact or self.apart(i, j) <= differences(n[i] + n[j])):
                    forest.append((j, i))
                    part[part == part[j]] = part[i]
        whole = len(every) <= most
        return [(self.node[a], self.node[b]) for a, b in (every if whole else forest)], whole


def _forests(batches: Iterator[pa.RecordBatch], exact: bool, few: int) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by (key, bi, bj)."""
    key, bucket = None, _Bucket(exact, few)

    def close() -> Iterator[pa.RecordBatch]:
        pairs, whole = bucket.pairs(key[1] != key[2]) if len(bucket.node) > 1 else ([], True)
        if pairs:
            a, b = np.array(pairs).T
            columns = [np.full(len(a), key[0]), np.minimum(a, b), np.maximum(a, b), np.full(len(a), whole)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "a", "b", "whole"])

    for batch in batches:
        for *mine, node, part, n, left, held in zip(*(batch.column(c).to_pylist() for c in ("key", "bi", "bj", "node", "part", "n", "left", "held"))):
            if mine != key:
                if key is not None:
                    yield from close()
                key, bucket = mine, _Bucket(exact, few)
            bucket.add(node, part, n, left, held)
    if key is not None:
        yield from close()


def _marked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false only if ``rid`` is not in ``nodes``(rid). The bitmap has 2**BITMAP_BITS bits at most."""
    slot = F.pmod(F.xxhash64("rid"), F.lit(1 << BITMAP_BITS)) + 1
    bits = nodes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bit = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("bucket"), "left")
    return marked.withColumn("maybe", F.coalesce(F.getbit(byte, bit % 8), F.lit(0)) == 1).drop("bucket", "bits")


def _among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rid, text) of ``nodes``(rid), and of a few more."""
    return _marked(rows.select("rid", "text"), nodes).where("maybe").select("rid", "text")


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, label: str) -> DataFrame:
    """The links among ``pairs``(a, b)."""
    texts = _among(rows, pairs.select(F.explode(F.array("a", "b")).alias("rid")))
    right = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("right")).hint("merge"), "b")
    both = right.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    return materialize(both.select("a", "b", "left", "right").mapInArrow(lambda it: _verify_rows(it, shingle), "a long, b long"), label)


def _open_members(stars: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node, part) of the buckets in which pairs that were never compared lie in different components."""
    placed = stars.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("part", "node").alias("part"))
    placed = materialize(placed, "placed")
    members = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(7), "node")))
    buckets = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), members.alias("same")).where("lo != hi")
    once = materialize(buckets.groupBy("same").agg(F.min("key").alias("key")).select("key"), "open")
    return materialize(placed.join(once, "key"), "open-members")


def _again(members: DataFrame, rows: DataFrame, shingle: int, exact: bool) -> DataFrame:
    """(key, a, b, whole): pairs of the buckets in ``members``(key, node, part), as ``_Bucket`` finds them."""
    few = FEW
    if exact:
        wanted = members.select(F.col("node").alias("rid")).distinct()
        texts = _among(rows, wanted).join(wanted.hint("merge"), "rid")
        held = materialize(texts.mapInArrow(lambda it: _token_rows(it, shingle), "node long, n long, held binary"), "held")
    else:
        held = rows.select(F.col("rid").alias("node"), "n", F.col("short").alias("held"))
    sizes = materialize(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "node", "part", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") <= F.col("other")).alias("left"))
    tasks = placed.join(held.hint("merge"), "node").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "node")
    return materialize(tasks.mapInArrow(lambda it: _forests(it, exact, few), "key long, a long, b long, whole boolean"), "forests")


def _components(links: DataFrame, label: str) -> DataFrame:
    return materialize(connected_components(links, label).select("node", F.col("root").alias("part")), f"{label}-parts")


def class_parts(rows: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, part): the components of all linked pairs of ``texts``(rid, text), which are among ``rows``."""
    keys = texts.mapInArrow(lambda it: _key_rows(it, shingle), "key long, node long")
    stars = materialize(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "key long, hub long, node long"), "stars")
    near = materialize(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near")
    right = near.join(rows.select(F.col("rid").alias("b"), "n", F.col("short").alias("right")).hint("merge"), "b")
    both = right.join(rows.select(F.col("rid").alias("a"), F.col("n").alias("m"), F.col("short").alias("left")).hint("merge"), "a")
    possible = materialize(both.select("a", "b", "m", "n", "left", "right").mapInArrow(_possible_rows, "a long, b long"), "possible")
    links = _verified(possible, rows, shingle, "links")
    parts, grown = _components(links, "grown"), False
    members = _open_members(stars, parts)
    for exact in (False, True):
        if members.isEmpty():
            break
        forests = _again(members, rows, shingle, exact)
        tried = materialize(forests.select("a", "b").distinct().join(links, ["a", "b"], "left_anti"), "tried")
        if tried.isEmpty():
            break
        more = _verified(tried, rows, shingle, "more")
        wrong = materialize(tried.join(more, ["a", "b"], "left_anti"), "wrong")
        if not more.isEmpty():
            links, grown = materialize(links.unionByName(more), "all-links"), True
        if exact and not wrong.isEmpty():
            raise RuntimeError("two different n-grams have one 64-bit hash")
        if not exact:
            members = materialize(members.join(forests.where("not whole").join(wrong, ["a", "b"]).select("key").distinct(), "key"), "failed")
    release(stars, near, possible, members)
    return _components(links, "components") if grown else parts


def ngram_join(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included)."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("rid"))
    bits = SHORT
    rows = materialize(given.mapInArrow(lambda it: _set_rows(it, shingle, bits), f"doc_id {kind}, {_ROWS}"), "sets")
    whole = rows.where("doc_id is not null and n > 0")
    classes = materialize(whole.groupBy("class").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid")), "classes")
    # one text of each class; of those that the bitmap takes for further copies, a join says which are
    stand = classes.select("rid")
    marked = _marked(whole.select("rid", "text"), whole.select("rid").join(stand, "rid", "left_anti"))
    texts = marked.where("not maybe").unionByName(marked.where("maybe").join(stand.hint("merge"), "rid")).select("rid", "text")
    components = class_parts(rows, texts, shingle)
    named = classes.join(components, F.col("rid") == F.col("node"), "left").select("class", "least", F.coalesce("part", "rid").alias("root"))
    # written, so that the joins have plain exchanges and a large class or component can be split
    named = materialize(named, "named")
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    by_class = materialize(named.join(smallest, "root").select("class", "component_id"), "by-class")
    found = rows.select("doc_id", "class", "n").join(by_class, "class", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
