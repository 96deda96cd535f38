"""Shared folder, written intermediates and row keys for the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local session gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="venuelake-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/venuelake-{uuid.uuid4().hex}/{label}"
    _WRITTEN.append((spark, path.rpartition("/")[0]))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._venuelake_path = path
    return written


def release(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote and nobody will read again; other DataFrames are left alone."""
    for df in written:
        if path := getattr(df, "_venuelake_path", None):
            entry = (df.sparkSession, path.rpartition("/")[0])
            if entry in _WRITTEN:
                _WRITTEN.remove(entry)
                _delete(*entry)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder is only scratch space
            return


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids go to bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def content_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that address a text; null differs from the empty text."""
    return [F.xxhash64(F.lit(salt), text.isNull(), text).alias(name) for salt, name in ((11, "_k1"), (12, "_k2"))]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, content) is in ``kept``(doc_id, _k1, _k2); of repeated rows one stays.

    All columns of ``docs`` come back. ``kept`` may repeat a key.
    """
    names = docs.columns
    k1, k2, d, a, b, times, *other = unused(docs, "_k1", "_k2", "_d", "_a", "_b", "_times", "_e", "_x", "_y")
    keyed = docs.withColumns(dict(zip((k1, k2), content_key(F.col("text")))))
    counts = keyed.groupBy(F.col("doc_id").alias(d), F.col(k1).alias(a), F.col(k2).alias(b)).agg(F.count(F.lit(1)).alias(times))
    wanted = kept.select("doc_id", "_k1", "_k2").distinct().toDF(*other)
    same = F.col(d).eqNullSafe(F.col(other[0])) & (F.col(a) == F.col(other[1])) & (F.col(b) == F.col(other[2]))
    wanted = counts.join(wanted, same).select(d, a, b, times)
    found = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted[d]) & (keyed[k1] == wanted[a]) & (keyed[k2] == wanted[b]))
    once = found.where(F.col(times) == 1).select(*names)
    again = found.where(F.col(times) > 1).dropDuplicates(["doc_id", k1, k2]).select(*names)
    return once.unionByName(again)
