"""Writers of published datasets. Each replaces what its folder had, so no stale file is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import compact_json


def write_dataset(folder: str, manifest: dict[str, object], **tables: DataFrame) -> None:
    """A folder with a Parquet table for each name, and the small values that hold for all in ``manifest``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    row = spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in manifest.items()])).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def write_records(df: DataFrame, folder: str, key: str) -> None:
    """(key, record) with the sparse record of each row as JSON."""
    df.select(key, compact_json(df).alias("record")).write.mode("overwrite").parquet(folder)


def by_resolution(features: DataFrame, zoom: str, split: int = 13) -> tuple[DataFrame, DataFrame]:
    """(low, high): features for the whole area, and those that are seen from zoom ``split`` on only; each by class."""
    return features.where(F.col(zoom) < split).orderBy("cls"), features.where(F.col(zoom) >= split).orderBy("cls")


def centres(df: DataFrame, lat: Column, lng: Column, cell: float = 0.0035) -> DataFrame:
    """(lat, lng): the mean place of each grid cell that has rows, to six digits, in order."""
    grid = df.groupBy(F.floor(lat / cell).alias("_a"), F.floor(lng / cell).alias("_o")).agg(F.avg(lat).alias("lat"), F.avg(lng).alias("lng"))
    return grid.select(F.bround("lat", 6).alias("lat"), F.bround("lng", 6).alias("lng")).orderBy("lat", "lng")
