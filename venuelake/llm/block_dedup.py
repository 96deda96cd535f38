"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of fixed size. The distinct blocks are sorted into integer names; adjacent names are
then paired and the distinct pairs sorted into names again, until each document has one name. Two documents have
the same (level, name) exactly if their texts are equal.

Blocks are dealt to buckets by a hash of their content and sorted inside their bucket, so that a name is
``bucket * 2**32 + rank`` and no task ever sorts more than a bucket. Only the distinct blocks of a task are shuffled.
Rows find the name of their block by a 128-bit address; every bucket holds its blocks in full and proves that
different blocks have different addresses. If two ever agree, all is done again with another salt, so the result
never rests on luck.

Null texts count as empty. Rows with a null id take part; among equal texts they lose to any row with an id.
Of repeated rows one stays. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, keep_rows, materialize

#: Bytes in a block, and how many blocks (of any level) a bucket holds on average.
BLOCK_BYTES, BUCKET_BLOCKS = 8192, 64
_RANK = 2**32


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty. Single spaces need no rewriting."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]", " ")


def _blocks(norm: Column, size: int) -> Column:
    data = norm.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(norm) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _address(block: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(salt), block).alias("k1"), F.xxhash64(F.lit(salt + 1), block).alias("k2"))


def _buckets(rows: int) -> int:
    return 1 << max(4, (rows // BUCKET_BLOCKS).bit_length())


def _named(items: DataFrame, item: Column, bucket: Column) -> DataFrame:
    """(item, name) of the distinct items: sorted inside their bucket, numbered from the bucket's own range."""
    sorted_sets = items.select(bucket.alias("bucket"), item.alias("item")).groupBy("bucket").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )
    return sorted_sets.select("bucket", F.posexplode("items").alias("rank", "item")).select(
        "item", (F.col("bucket") * F.lit(_RANK) + F.col("rank")).alias("name")
    )


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, salt: int = 1) -> DataFrame:
    """One row per document: rid, doc_id, text_sha256, _k1, _k2 (address of the text as given), level, name."""
    texts = docs.select("doc_id", "text", normalised(F.col("text")).alias("norm"))
    rows = materialize(
        texts.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            *content_key(F.col("text")),
            F.transform(_blocks(F.col("norm"), block_bytes), lambda b: _address(b, salt)).alias("keys"),
        ),
        "rows",
    )
    total, longest = rows.agg(F.sum(F.size("keys")), F.max(F.size("keys"))).first()
    total, longest = total or 0, longest or 0

    blocks = texts.select(F.explode(_blocks(F.col("norm"), block_bytes)).alias("block"))
    address = _address(F.col("block"), salt)
    count = _buckets(total)
    names = _named(blocks, F.col("block"), F.pmod(address["k1"], F.lit(count)))
    names = names.select(_address(F.col("item"), salt).alias("key"), "name").select("key.k1", "key.k2", "name")
    names = materialize(names, "names")
    if not names.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        return name_documents(docs, block_bytes, salt + 2)

    current = (
        rows.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
        .select("rid", "n", "pos", "key.k1", "key.k2")
        .join(names, ["k1", "k2"])
        .select("rid", "n", "pos", "name")
    )
    current = materialize(current, "level0")
    done = current.where("n = 1").select("rid", F.lit(0).alias("level"), "name")
    level = 0
    while longest > 1:
        level, longest, total = level + 1, (longest + 1) // 2, total // 2 + 1
        pairs = materialize(
            current.where("n > 1")
            .groupBy("rid", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            ),
            f"pairs{level}",
        )
        bucket = F.pmod(F.xxhash64("a", "b"), F.lit(_buckets(total)))
        named = _named(pairs, F.struct("a", "b"), bucket).select("item.a", "item.b", "name")
        current = materialize(
            pairs.join(named, ["a", "b"]).select("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"),
            f"level{level}",
        )
        done = done.unionByName(current.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    return rows.drop("keys").join(done, "rid")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the address of its text."""
    named = materialize(name_documents(docs, block_bytes), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    # written, so that the join has plain exchanges and a large group of copies can be split
    groups = materialize(named.groupBy("level", "name").agg(first, F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "text_sha256",
        "_k1",
        "_k2",
    )


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all columns, without the rows whose text another row with a smaller id has."""
    return keep_rows(docs, exact_groups(docs, block_bytes).where("kept"))
