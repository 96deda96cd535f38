"""Geometry kernels on point lists, and their Arrow UDFs. Points are (x, y) in world units; rings are closed implicitly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import signed_area
from ..session import ship_package

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
Point = tuple[float, float]


def clip_ring(ring: list[Point], x0: float, y0: float, x1: float, y1: float) -> list[Point]:
    """The part of a ring inside a box: one half plane after the other."""
    sides = [(0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)]
    for axis, bound, sign in sides:
        out: list[Point] = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ia, ib = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ia:
                out.append(a)
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
    return ring


def clip_line(line: list[Point], x0: float, y0: float, x1: float, y1: float) -> list[list[Point]]:
    """Pieces of a line inside a box, by the parameters at which each segment crosses it."""
    pieces: list[list[Point]] = []
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        lo, hi = 0.0, 1.0
        for p, q in ((ax - bx, ax - x0), (bx - ax, x1 - ax), (ay - by, ay - y0), (by - ay, y1 - ay)):
            if p == 0:
                if q < 0:
                    lo, hi = 1.0, 0.0
            elif p < 0:
                lo = max(lo, q / p)
            else:
                hi = min(hi, q / p)
        if lo > hi:
            continue
        a, b = ((ax + t * (bx - ax), ay + t * (by - ay)) for t in (lo, hi))
        if pieces and pieces[-1][-1] == a:
            pieces[-1].append(b)
        else:
            pieces.append([a, b])
    return pieces


def segment_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points to segments, by broadcasting."""
    d = b - a
    t = np.clip(((p - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    return np.hypot(*np.moveaxis(p - (a + t[..., None] * d), -1, 0))


def simplify(line: list[Point], tolerance: float) -> list[Point]:
    """Douglas-Peucker without recursion."""
    if len(line) < 3:
        return line
    xy, keep, todo = np.array(line, float), np.zeros(len(line), bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d = segment_distance(xy[i + 1 : j], xy[i], xy[j])
        k = int(d.argmax())
        if d[k] > tolerance:
            k += i + 1
            keep[k] = True
            todo += [(i, k), (k, j)]
    return [p for p, k in zip(line, keep) if k]


def contains(ring: list[Point], x: float, y: float) -> bool:
    """Even-odd rule; points on the border may fall either way."""
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def line_distance(line: list[Point], x: float, y: float) -> float:
    xy = np.array(line, float)
    if len(xy) == 1:
        return float(np.hypot(xy[0, 0] - x, xy[0, 1] - y))
    return float(segment_distance(np.array([x, y]), xy[:-1], xy[1:]).min())


def centroid(ring: list[Point]) -> Point:
    """Centre of area; of the points where the area is nothing."""
    xy = np.array(ring, float)
    nxt = np.roll(xy, -1, axis=0)
    cross = xy[:, 0] * nxt[:, 1] - nxt[:, 0] * xy[:, 1]
    if abs(cross.sum()) < 1e-12:
        return tuple(xy.mean(axis=0))
    return tuple(((xy + nxt) * cross[:, None]).sum(axis=0) / (3 * cross.sum()))


def stitch(lines: list[list[Point]]) -> list[list[Point]]:
    """Lines joined at shared end points, in order of input, until none fits."""
    left = [list(line) for line in lines if line]
    out = []
    while left:
        run = left.pop(0)
        grown = True
        while grown and run[0] != run[-1]:
            grown = False
            for k, line in enumerate(left):
                if run[-1] in (line[0], line[-1]):
                    run += (line if line[0] == run[-1] else line[::-1])[1:]
                elif run[0] in (line[0], line[-1]):
                    run = (line if line[-1] == run[0] else line[::-1])[:-1] + run
                else:
                    continue
                left.pop(k)
                grown = True
                break
        out.append(run)
    return out


def _points(value) -> list[Point]:
    return [(p["x"], p["y"]) for p in value]


def _structs(points: list[Point]) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def clipped(points: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Ring inside a box, as a column."""

    @F.pandas_udf(POINTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else _structs(clip_ring(_points(v), x0, y0, x1, y1)))

    return run(points)


def simplified(points: Column, tolerance: float) -> Column:
    @F.pandas_udf(POINTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else _structs(simplify(_points(v), tolerance)))

    return run(points)


@F.pandas_udf(T.DoubleType())
def distance_to_line(points: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Distance of a point to a line; null without either."""
    return pd.Series([None if v is None or a != a or b != b else line_distance(_points(v), a, b) for v, a, b in zip(points, x, y)], dtype="float64")


def nearest_on_ring(ring: list[Point], x: float, y: float) -> Point:
    """The point of a ring's border nearest to a point; of equally near ones that on the first side."""
    a = np.array(ring, float)
    d = np.roll(a, -1, axis=0) - a
    p = np.array([x, y])
    t = np.clip(((p - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    on = a + t[:, None] * d
    px, py = on[np.hypot(*(p - on).T).argmin()]
    return float(px), float(py)


def pin_gap(ring: Column, x: Column, y: Column) -> Column:
    """struct<x, y, gap>: the nearest point of an outline and how far it is.

    Inside the outline it is the point itself with gap 0. Null without a point or a ring.
    """

    @F.pandas_udf("x double, y double, gap double")
    def run(rings: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for v, a, b in zip(rings, xs, ys):
            if v is None or not len(v) or pd.isna(a) or pd.isna(b):
                out.append((None, None, None))
            elif contains(points := _points(v), a, b):
                out.append((a, b, 0.0))
            else:
                px, py = nearest_on_ring(points, a, b)
                out.append((px, py, float(np.hypot(px - a, py - b))))
        return pd.DataFrame(out, columns=["x", "y", "gap"], dtype="float64")

    return run(ring, x, y)


def polygons(rings: Column) -> Column:
    """array<array<ring>>: a ring of positive area begins a polygon, the others are holes of the one before.

    A hole without a polygon before it begins one. Null for null; an empty list has none.
    """
    none = F.array().cast("array<array<array<struct<x:double,y:double>>>>")

    def add(done: Column, ring: Column) -> Column:
        n, own = F.size(done), F.array(F.array(ring))
        with_hole = F.concat(F.slice(done, 1, n - 1), F.array(F.concat(F.element_at(done, -1), F.array(ring))))
        return F.when((n == 0) | (signed_area(ring) > 0), F.concat(done, own)).otherwise(with_hole)

    return F.aggregate(rings, none, add)


def way_line(points: Column) -> Column:
    """The points of a way that are there."""
    return F.filter(points, lambda p: p.isNotNull())


def way_ring(points: Column) -> Column:
    """A closed way of four points or more as a ring without its repeated end, else null."""
    line = way_line(points)
    closed = (F.size(line) >= 4) & (F.element_at(line, 1) == F.element_at(line, -1))
    return F.when(closed, F.slice(line, 1, F.size(line) - 1))


def assembled(outer: list[list[Point]], inner: list[list[Point]]) -> list[list[list[Point]]]:
    """Polygons of a relation's ways (G02): closed runs of outer ways, each with the closed inner runs that lie in it.

    Runs that stay open bound nothing.
    """
    rings = lambda ways: [r[:-1] for r in stitch([w for w in ways if len(w) > 1]) if len(r) > 3 and r[0] == r[-1]]
    found = [[r] for r in rings(outer)]
    for hole in rings(inner):
        holders = [p for p in found if contains(p[0], *centroid(hole))]
        if holders:  # the smallest, where rings lie in each other
            min(holders, key=lambda p: abs(area_of(p[0]))).append(hole)
    return found


def area_of(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def relation_polygons(outer: Column, inner: Column) -> Column:
    """array<polygon> of arrays of ways; null if there is no outer way, or a point of any way is missing."""

    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    @F.arrow_udf(T.ArrayType(T.ArrayType(POINTS)))  # lists of lists, which pandas can't hold
    def run(outers: pa.Array, inners: pa.Array) -> pa.Array:
        out = []
        for o, i in zip(outers.to_pylist(), inners.to_pylist()):
            o, i = ([w for w in v or [] if w is not None] for v in (o, i))
            broken = any(p is None for w in o + i for p in w)
            found = None if broken or not o else assembled([_points(w) for w in o], [_points(w) for w in i])
            out.append([[_structs(r) for r in p] for p in found] if found else None)
        return pa.array(out, pa.list_(pa.list_(pa.list_(point))))

    return run(outer, inner)


def flattened(df: DataFrame, shapes: str) -> DataFrame:
    """A row for each shape of a list, in order, with its place ``part`` (G03); rows without any are gone."""
    others = [c for c in df.columns if c != shapes]
    return df.select(*others, F.posexplode(shapes).alias("part", shapes))


#: Fixed least areas in world units, and in square metres for outlines (F16).
LEAST_AREA, LEAST_OUTLINE_M2, LEAST_SHAPE = 40.0, 30.0, 20.0


def large_enough(ring: Column, least: float = LEAST_AREA, simplified: bool = False) -> Column:
    """The area counts; after simplification a quarter of it is enough (F16)."""
    return F.abs(signed_area(ring)) >= (least / 4 if simplified else least)


def element_class(kind: Column, tags: Column) -> Column:
    """building, area, way, poi or null of a map element by its kind and tags."""
    has = lambda k: F.coalesce(tags[k], F.lit("")) != ""
    return (
        F.when(has("building") | (kind == "relation"), "building")
        .when(has("landuse") | F.coalesce(tags["amenity"] == "marketplace", F.lit(False)) | F.coalesce(tags["man_made"] == "bridge", F.lit(False)), "area")
        .when(has("highway") | has("railway"), "way")
        .when((kind == "node") | has("amenity"), "poi")
    )


def packed(df: DataFrame, keys: list[str], cx: str, cy: str, order: str, points: str, cell: int = 512) -> DataFrame:
    """Features of a class and cell in one row, in order (G15); a cell bounds how much is gathered."""
    placed = df.withColumns({"bx": F.floor(F.col(cx) / cell), "by": F.floor(F.col(cy) / cell)})
    return placed.groupBy(*keys, "bx", "by").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, points))), lambda s: s[points]).alias("parts"))


def ring_segment_distance(ring: list[Point], a: Point, b: Point) -> float:
    """Distance of a ring's area to a segment; 0 if they meet."""
    if contains(ring, *a) or contains(ring, *b):
        return 0.0
    p = np.array(ring, float)
    q = np.roll(p, -1, axis=0)
    s, t = np.array(a, float), np.array(b, float)
    side = lambda u, v, w: (v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0])
    if ((side(p, q, s) * side(p, q, t) < 0) & (side(s, t, p) * side(s, t, q) < 0)).any():
        return 0.0
    return float(min(segment_distance(s, p, q).min(), segment_distance(t, p, q).min(), segment_distance(p, s[None], t[None]).min()))


@F.pandas_udf(T.DoubleType())
def _to_segment(ring: pd.Series, ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series([ring_segment_distance(_points(r), (a, b), (c, d)) for r, a, b, c, d in zip(ring, ax, ay, bx, by)], dtype=float)


def _span(values: Column, pad: float, cell: float) -> Column:
    """The cells that the padded range of ``values`` touches."""
    return F.sequence(F.floor((F.array_min(values) - pad) / cell), F.floor((F.array_max(values) + pad) / cell))


def fronting(buildings: DataFrame, lines: DataFrame, key: str, reach: float, largest: float, cell: float = 256.0) -> DataFrame:
    """Rows of ``buildings``(key, points) with an area up to ``largest`` and within ``reach`` of a line of ``lines``(points).

    Keys are distinct; rings and lines of under two points are near nothing.
    """
    near = fronting_pairs(buildings, lines.select("points"), key, [], reach, largest, cell).select(F.col(key).alias("_near")).distinct()
    return buildings.join(near, buildings[key] == F.col("_near"), "left_semi")


def fronting_pairs(buildings: DataFrame, lines: DataFrame, key: str, by: list[str], reach: float, largest: float, cell: float = 256.0) -> DataFrame:
    """(key, *by): the buildings up to ``largest`` and the lines ``lines``(*by, points) within ``reach`` of them, once each.

    Segments and padded buildings meet by an equi join on grid cells; the exact distance decides.
    """
    ship_package(buildings.sparkSession)
    small = buildings.where((F.size("points") > 2) & (F.abs(signed_area(F.col("points"))) <= largest))
    placed = small.select(key, F.col("points").alias("_ring"), F.explode(_span(F.col("points.x"), reach, cell)).alias("_cx"), "points").withColumn(
        "_cy", F.explode(_span(F.col("points.y"), reach, cell))
    )
    pairs = F.transform(F.slice("points", 1, F.size("points") - 1), lambda p, i: F.struct(p.alias("a"), F.col("points")[i + 1].alias("b")))
    segments = lines.where(F.size("points") > 1).select(*by, F.explode(pairs).alias("s")).select(*by, "s.a", "s.b").distinct()
    segments = segments.withColumn("_sx", F.explode(_span(F.array("a.x", "b.x"), 0.0, cell))).withColumn("_sy", F.explode(_span(F.array("a.y", "b.y"), 0.0, cell)))
    met = placed.join(segments, (F.col("_cx") == F.col("_sx")) & (F.col("_cy") == F.col("_sy")))
    return met.where(_to_segment("_ring", "a.x", "a.y", "b.x", "b.y") <= reach).select(key, *by).distinct()


def grid_split(df: DataFrame, points: str, cell: float) -> DataFrame:
    """A row for each grid cell that a ring has a part in, with the part, ``cx`` and ``cy``."""
    ship_package(df.sparkSession)

    @F.pandas_udf(POINTS)
    def part(ring: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        return pd.Series([_structs(clip_ring(_points(r), x * cell, y * cell, (x + 1) * cell, (y + 1) * cell)) for r, x, y in zip(ring, cx, cy)], dtype=object)

    placed = df.where(F.size(points) > 2).withColumn("cx", F.explode(_span(F.col(f"{points}.x"), 0.0, cell))).withColumn("cy", F.explode(_span(F.col(f"{points}.y"), 0.0, cell)))
    cut = placed.withColumn(points, part(points, "cx", "cy"))
    return cut.where((F.size(points) > 2) & (F.abs(signed_area(F.col(points))) > 0))
