"""Intermediates written as Parquet below ``spark.checkpoint.dir``, so that lineage ends and lost executors cost nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends. A local session without a shared folder gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="venuelake-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/venuelake-{uuid.uuid4().hex}-{label}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written in the shared folder and read back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._venuelake_stored = path
    return found


def released(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these and nobody will read again; others are left alone."""
    for df in frames:
        if path := getattr(df, "_venuelake_stored", None):
            if (df.sparkSession, path) in _WRITTEN:
                _WRITTEN.remove((df.sparkSession, path))
                _delete(df.sparkSession, path)


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
