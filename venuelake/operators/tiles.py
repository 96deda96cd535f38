"""Tiles, hash buckets and the polyline codec."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import ring_centre, tile_of_units
from ..session import ship_package


def hash_bucket(key: Column, buckets: int = 64) -> Column:
    """First byte of the SHA-256 of a key, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % buckets).cast("int")


def content_version(df: DataFrame, bucket: str, payload: Column, order: str) -> DataFrame:
    """One version string for a bucketed table: digests of rows make digests of buckets, and those one.

    Digests of a bucket's rows are combined by an order-free sum, so a bucket is never gathered.
    """
    h = F.sha2(F.concat_ws("\x1f", F.col(order).cast("string"), payload), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).alias(f"h{i}")
    each = df.groupBy(bucket).agg(*[part(i) for i in range(4)])
    return each.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(bucket, "h0", "h1", "h2", "h3"))), lambda s: s.cast("string")), ","), 256), 1, 20).alias("version"))


def tile_index(df: DataFrame, x: str, y: str, size: int, payload: list[str]) -> DataFrame:
    """(tx, ty, n, bytes) of the tiles of ``size`` world units."""
    placed = df.withColumns({"tx": tile_of_units(F.col(x), size), "ty": tile_of_units(F.col(y), size)})
    return placed.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*payload)))).alias("bytes"))


def tile_totals(index: DataFrame, layer: str) -> DataFrame:
    """(layer, tiles, total, biggest) of a tile index."""
    return index.groupBy(layer).agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("total"), F.max("bytes").alias("biggest"))


#: Share of a tile by which its clip box is larger on each side.
MARGIN = 0.25


def assigned(df: DataFrame, points: str, size: int, area: bool = False) -> DataFrame:
    """``df`` with tx, ty and the clip box x0, y0, x1, y1 of its tile (G16): lines by the middle of their box, areas by their centre."""
    x, y = F.col(points)["x"], F.col(points)["y"]
    middle = lambda v: (F.array_min(v) + F.array_max(v)) / 2
    at = ring_centre(F.col(points)) if area else F.struct(middle(x).alias("x"), middle(y).alias("y"))
    placed = df.withColumn("_at", at).withColumns({"tx": tile_of_units(F.col("_at.x"), size), "ty": tile_of_units(F.col("_at.y"), size)}).drop("_at")
    bound = lambda t, k: F.col(t) * size + k * size
    return placed.withColumns({"x0": bound("tx", -MARGIN), "y0": bound("ty", -MARGIN), "x1": bound("tx", 1 + MARGIN), "y1": bound("ty", 1 + MARGIN)})


def tile_contents(features: DataFrame, labels: DataFrame, pois: DataFrame, size: int) -> DataFrame:
    """(tx, ty, ox, oy, f, l, p): what each tile holds, features by class; tiles without anything have no row.

    ``features``(tx, ty, cls, ord, feature), ``labels`` and ``pois``(tx, ty, ord, item).
    """
    key = ["tx", "ty"]
    listed = lambda df, name, by, item: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*by, item))), lambda s: s[item]).alias(name))
    f, l, p = listed(features, "f", ["cls", "ord"], "feature"), listed(labels, "l", ["ord"], "item"), listed(pois, "p", ["ord"], "item")  # noqa: E741
    return f.join(l, key, "full").join(p, key, "full").select(*key, (F.col("tx") * size).alias("ox"), (F.col("ty") * size).alias("oy"), "f", "l", "p")


def viewport_tiles(x0: float, y0: float, x1: float, y1: float, size: int) -> list[tuple[int, int]]:
    """Tiles that a box of world units meets, for pruning partitions by literals."""
    return [(i, j) for i in range(int(x0 // size), int(x1 // size) + 1) for j in range(int(y0 // size), int(y1 // size) + 1)]


def write_tiles(df: DataFrame, path: str, layer: str, tx: str, ty: str) -> None:
    """One directory per layer and tile; tiles lie together, so that each is a file or few."""
    df.repartition(layer, tx, ty).write.mode("overwrite").partitionBy(layer, tx, ty).parquet(path)


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """One directory per hash bucket."""
    df.withColumn("bucket", hash_bucket(F.col(key), buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def encode_points(points: list[tuple[float, float]], origin: tuple[int, int] = (0, 0)) -> str:
    """Rounded points as zig-zag differences in five-bit groups above character 63; repeated points go."""
    out = []
    px, py = origin
    for k, (x, y) in enumerate(points):
        x, y = round(x), round(y)
        if k and (x, y) == (px, py):
            continue
        for d in (x - px, y - py):
            v = d << 1 if d >= 0 else (-d << 1) - 1
            while v >= 32:
                out.append(chr(63 + (v & 31 | 32)))
                v >>= 5
            out.append(chr(63 + v))
        px, py = x, y
    return "".join(out)


def decode_points(text: str, origin: tuple[int, int] = (0, 0)) -> list[tuple[int, int]]:
    numbers, v, shift = [], 0, 0
    for ch in text:
        b = ord(ch) - 63
        v |= (b & 31) << shift
        shift += 5
        if b < 32:
            numbers.append(v >> 1 if not v & 1 else -((v + 1) >> 1))
            v = shift = 0
    out = []
    x, y = origin
    for dx, dy in zip(numbers[::2], numbers[1::2]):
        x, y = x + dx, y + dy
        out.append((x, y))
    return out


@F.pandas_udf(T.StringType())
def encode_line(points: pd.Series) -> pd.Series:
    """Polyline of array<struct<x, y>>."""
    return points.map(lambda p: None if p is None else encode_points([(q["x"], q["y"]) for q in p]))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])))
def decode_line(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"x": a, "y": b} for a, b in decode_points(t)])


def chained(parts: list[list[tuple[float, float]]], least: int, origin: tuple[int, int] = (0, 0)) -> list[str]:
    """Polylines of parts, each beginning where the last one kept ended (G15); parts with fewer points are left out."""
    out, at = [], origin
    for part in parts:
        text = encode_points(part, at)
        points = decode_points(text, at)
        if len(points) >= least:
            out.append(text)
            at = points[-1]
    return out


def chain(parts: Column, least: int, ox: Column, oy: Column) -> Column:
    """array<string> of array<array<struct<x, y>>>, from the origin of a tile."""

    @F.arrow_udf(T.ArrayType(T.StringType()))  # lists of lists, which pandas can't hold
    def run(lists: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        flat = lambda v: [[(q["x"], q["y"]) for q in part] for part in v]
        rows = zip(lists.to_pylist(), xs.to_pylist(), ys.to_pylist())
        return pa.array([None if v is None else chained(flat(v), least, (int(a), int(b))) for v, a, b in rows], pa.list_(pa.string()))

    return run(parts, ox, oy)


def round_trip(df: DataFrame, points: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.withColumn("decoded", decode_line(encode_line(F.col(points))))
