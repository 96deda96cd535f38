"""Planar overlay across rows: dissolve, difference, buffers, rings, shared borders, coasts.

Areas are sets of directed edges with the inside on the left, on whole coordinates: give a ``scale`` where units are
not fine enough. Edges are cut where they leave a cell of a grid, every cell is arranged by itself, and what bounds
the result is put together again by joins, so no group, area or ring is ever in one task.

How often a point is covered (its winding number) is known at the corner of each cell from the edges that cross the
cell's row left of it, a running sum over cells, and inside the cell from the edges between the corner and the point.
Grid lines lie at irrational offsets, so that no corner of an area lies on them. Crossings nearer to each other than
one millionth of a unit are one point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import signed_area
from ..session import ship_package
from ..stored import released, stored
from . import geometry
from .chains import merged_lines, ranked, whole_lines

#: Where grid lines lie between whole coordinates.
OFF_X, OFF_Y = math.sqrt(2) - 1, math.sqrt(3) - 1
#: Fractions of a unit that are told apart.
FINE = float(1 << 20)
#: Edges that are compared with all others of their cell at a time.
CHUNK = 256
#: A mitre is cut off where it would reach further than this many distances.
MITRE_LIMIT = 5.0


def end_point(k: int) -> Column:
    """One end of an edge: 1 where it begins, 2 where it ends."""
    return F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))


def ring_edges(df: DataFrame, by: list[str], ring: str, scale: float = 1.0, layer: int = 0, hole: Column | None = None) -> DataFrame:
    """(*by, x1, y1, x2, y2, w0, w1): the edges of rings, closed implicitly, outer rings anticlockwise and ``hole`` the other way."""
    whole = F.transform(ring, lambda p: F.struct(F.round(p["x"] * scale).cast("long").alias("x"), F.round(p["y"] * scale).cast("long").alias("y")))
    turned = (signed_area(F.col(ring)) < 0) != (F.lit(False) if hole is None else hole)
    placed = df.where(F.size(ring) >= 3).select(*by, F.when(turned, F.reverse(whole)).otherwise(whole).alias("_r"))
    edges = placed.select(*by, F.explode(F.transform("_r", lambda p, i: F.struct(p.alias("a"), F.coalesce(F.get("_r", i + 1), F.get("_r", F.lit(0))).alias("b")))).alias("e"))
    w = [F.lit(1 if layer == k else 0).cast("long").alias(f"w{k}") for k in (0, 1)]
    return edges.select(*by, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"), *w).where("x1 != x2 or y1 != y2")


def _lines_between(low: Column, high: Column, cell: int, off: float) -> Column:
    """The numbers of the grid lines between two coordinates."""
    first, last = F.floor((low - off) / cell) + 1, F.floor((high - off) / cell)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _meeting(edges: DataFrame, by: list[str], cell: int) -> tuple[DataFrame, DataFrame]:
    """(pieces, crossings): edges cut at grid lines, with the cell of each piece; and where edges cross the lower border of a cell."""
    merged = edges.groupBy(
        *by, F.least(end_point(1), end_point(2)).alias("a"), F.greatest(end_point(1), end_point(2)).alias("b")
    )
    forward = end_point(1) < end_point(2)
    total = [F.sum(F.when(forward, F.col(w)).otherwise(-F.col(w))).alias(w) for w in ("w0", "w1")]
    # borders that two areas share in opposite directions are gone
    once = merged.agg(*total).where("w0 != 0 or w1 != 0").select(*by, *[F.col(f"{p}.{c}").alias(f"{c}{k}") for p, k in (("a", 1), ("b", 2)) for c in "xy"], "w0", "w1")
    once = stored(once.withColumn("edge", F.monotonically_increasing_id()), "edges")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    xs = _lines_between(F.least("x1", "x2"), F.greatest("x1", "x2"), cell, OFF_X)
    ys = _lines_between(F.least("y1", "y2"), F.greatest("y1", "y2"), cell, OFF_Y)
    at = F.array_sort(F.concat(
        F.array(F.lit(0.0), F.lit(1.0)),
        F.transform(xs, lambda k: (k * cell + OFF_X - F.col("x1")) / dx),
        F.transform(ys, lambda k: (k * cell + OFF_Y - F.col("y1")) / dy),
    ))
    cut = once.withColumn("at", at).withColumn("t", F.explode(F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda t, i: F.struct(t.alias("a"), F.get("at", i + 1).alias("b")))))
    middle = (F.col("t.a") + F.col("t.b")) / 2
    pieces = cut.where("t.b > t.a").select(
        *by, F.floor((F.col("x1") + middle * dx - OFF_X) / cell).alias("cx"), F.floor((F.col("y1") + middle * dy - OFF_Y) / cell).alias("cy"),
        "edge", "x1", "y1", "x2", "y2", "w0", "w1", F.col("t.a").alias("t0"), F.col("t.b").alias("t1"),
    )
    up = F.signum(dy.cast("double")).cast("long")
    level = once.select(*by, "x1", "y1", "x2", "y2", *[(-F.col(w) * up).alias(w) for w in ("w0", "w1")], F.explode(ys).alias("cy"))
    level = level.withColumn("x", F.col("x1") + (F.col("cy") * cell + OFF_Y - F.col("y1")) / dy * dx)
    return pieces, level.select(*by, F.floor((F.col("x") - OFF_X) / cell).alias("cx"), "cy", "x", "w0", "w1")


def overlay(edges: DataFrame, by: list[str], cell: int, keep: str = "union") -> DataFrame:
    """The boundary (*by, x1, y1, x2, y2) of what ``edges``(*by, x1, y1, x2, y2, w0, w1) cover, inside on the left.

    ``keep``: ``union`` (covered in layer 0), ``both`` (in both layers) or ``difference`` (in 0 but not in 1). Overlaps,
    repeated areas, shared borders and areas of no size are fine. A cell is one task's work, quadratic in its edges.
    """
    ship_package(edges.sparkSession)
    pieces, crossings = _meeting(edges, by, cell)
    pieces = stored(pieces, "pieces")
    cells = pieces.select(*by, "cx", "cy", F.lit(0).cast("long").alias("w0"), F.lit(0).cast("long").alias("w1")).distinct().unionByName(crossings.drop("x"))
    cells = cells.groupBy(*by, "cx", "cy").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    left = Window.partitionBy(*by, "cy").orderBy("cx").rowsBetween(Window.unboundedPreceding, -1)
    corners = cells.select(*by, "cx", "cy", *[F.coalesce(F.sum(w).over(left), F.lit(0)).cast("long").alias(w) for w in ("w0", "w1")])
    filled = pieces.select(*by, "cx", "cy").distinct()
    none = {c: F.lit(None).cast(t) for c, t in (("edge", "long"), ("x1", "double"), ("y1", "double"), ("x2", "double"), ("y2", "double"), ("t0", "double"), ("t1", "double"))}
    row = ["kind", "edge", "x1", "y1", "x2", "y2", "t0", "t1", "w0", "w1"]
    as_double = {c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")}
    rows = (
        pieces.withColumns(as_double).withColumn("kind", F.lit(2)).select(*by, "cx", "cy", *row)
        .unionByName(crossings.withColumns({**none, "x1": F.col("x")}).withColumn("kind", F.lit(1)).select(*by, "cx", "cy", *row))
        .unionByName(corners.withColumns(none).withColumn("kind", F.lit(0)).select(*by, "cx", "cy", *row))
    )
    # cells without a piece have nothing to arrange
    rows = rows.join(filled.toDF(*[f"_{c}" for c in filled.columns]), _same([*by, "cx", "cy"]), "left_semi")
    dealt = rows.withColumn("_cell", F.xxhash64(*by, "cx", "cy")).repartition("_cell").sortWithinPartitions("_cell", *by, "cx", "cy", "kind")
    names = [*by, "cx", "cy"]
    schema = ", ".join([f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by] + ["edge long, back boolean, s0 double, s1 double, cut0 boolean, cut1 boolean", *[f"{c} double" for c in ("x1", "y1", "x2", "y2")]])
    found = dealt.select(*names, *row).mapInArrow(lambda it: _arranged(it, names, len(by), keep), schema)
    return _rejoined(found, by)


def _same(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def _rejoined(found: DataFrame, by: list[str]) -> DataFrame:
    """Edges that were cut at grid lines only are one again."""
    w = Window.partitionBy(*by, "edge", "back").orderBy("s0")
    goes_on = F.coalesce(F.col("cut0") & F.lag("cut1").over(w) & (F.lag("s1").over(w) == F.col("s0")), F.lit(False))
    runs = found.withColumn("run", F.sum((~goes_on).cast("int")).over(w))
    one = runs.groupBy(*by, "edge", "back", "run").agg(*[F.min_by(end_point(1), "s0").alias("a"), F.max_by(end_point(2), "s0").alias("b")])
    # found edges run along their carrier; those that bound from the other side are turned last
    ends = [F.when(F.col("back"), F.col(f"{q}.{c}")).otherwise(F.col(f"{p}.{c}")).alias(f"{c}{k}") for k, p, q in ((1, "a", "b"), (2, "b", "a")) for c in "xy"]
    return one.select(*by, *ends)


def _inside(w: np.ndarray, keep: str) -> np.ndarray:
    if keep == "union":
        return w[0] > 0
    return (w[0] > 0) & ((w[1] > 0) if keep == "both" else (w[1] <= 0))


def _splits(a: np.ndarray, d: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(edge, parameter) pairs at which pieces meet others: at crossings, and at ends that lie on them."""
    n, out = len(a), []
    tiny = 1e-9
    for at in range(0, n, CHUNK):
        i = np.arange(at, min(at + CHUNK, n))[:, None]
        j = np.arange(n)[None, :]
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        r = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (r[..., 0] * d[j, 1] - r[..., 1] * d[j, 0]) / cross
            u = (r[..., 0] * d[i, 1] - r[..., 1] * d[i, 0]) / cross
        hit = (cross != 0) & (t > t0[i] + tiny) & (t < t1[i] - tiny) & (u >= t0[j] - tiny) & (u <= t1[j] + tiny)
        k, _ = np.nonzero(hit)
        out.append((i[k, 0], t[hit]))
        # on one line: the other's ends
        along = (cross == 0) & (r[..., 0] * d[i, 1] == r[..., 1] * d[i, 0]) & (i != j)
        if along.any():
            k, m = np.nonzero(along)
            e, f = i[k, 0], j[0, m]
            length = (d[e] ** 2).sum(axis=1)
            for s in (t0, t1):
                t = ((a[f] + d[f] * s[f, None] - a[e]) * d[e]).sum(axis=1) / length
                ok = (t > t0[e] + tiny) & (t < t1[e] - tiny)
                out.append((e[ok], t[ok]))
    return out


def _arrange(rows: dict[str, np.ndarray], keep: str) -> list[np.ndarray]:
    """The parts of a cell's edges that bound the result: edge, back, s0, s1, cut0, cut1, x1, y1, x2, y2."""
    piece, crossing = rows["kind"] == 2, rows["kind"] == 1
    a = np.stack([rows["x1"][piece], rows["y1"][piece]], axis=1)
    d = np.stack([rows["x2"][piece], rows["y2"][piece]], axis=1) - a
    t0, t1 = rows["t0"][piece], rows["t1"][piece]
    w = np.stack([rows["w0"], rows["w1"]])
    corner = w[:, rows["kind"] == 0].sum(axis=1)
    found = _splits(a, d, t0, t1)
    n = len(a)
    edge = np.concatenate([np.arange(n), np.arange(n), *[e for e, _ in found]])
    t = np.concatenate([t0, t1, *[s for _, s in found]])
    # an end is a cut if the grid made it, that is if it isn't an end of the whole edge
    cut = np.concatenate([t0 > 0, t1 < 1, np.zeros(len(t) - 2 * n, bool)])
    order = np.lexsort((t, edge))
    edge, t, cut = edge[order], t[order], cut[order]
    on = np.round((a[edge] + d[edge] * t[:, None]) * FINE) / FINE
    # parts between neighbouring points of an edge; points that came out equal are one, which is no cut if any of them is none
    new = np.append(True, (edge[1:] != edge[:-1]) | (on[1:] != on[:-1]).any(axis=1))
    group = np.cumsum(new) - 1
    true_node = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    np.logical_or.at(true_node, group, ~cut)
    edge, t, on = edge[new], t[new], on[new]
    go = np.flatnonzero(edge[1:] == edge[:-1])
    p, q, e = on[go], on[go + 1], edge[go]
    s0, s1, c0, c1 = t[go], t[go + 1], ~true_node[go], ~true_node[go + 1]
    weight = w[:, piece][:, e]
    # equal parts, in either direction, become one with the sum of their weights
    turned = (p[:, 0] > q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1]))
    low, high = np.where(turned[:, None], q, p), np.where(turned[:, None], p, q)
    weight = np.where(turned, -weight, weight)
    _, first, back = np.unique(np.concatenate([low, high], axis=1), axis=0, return_index=True, return_inverse=True)
    total = np.zeros((2, len(first)), np.int64)
    for k in (0, 1):
        np.add.at(total[k], back.ravel(), weight[k])
    several = np.bincount(back.ravel(), minlength=len(first)) > 1
    live = np.flatnonzero((total != 0).any(axis=0))
    first, total, several = first[live], total[:, live], several[live]
    low, high = low[first], high[first]
    # how often the place just below the middle of each part is covered, or just left of it where the part is upright
    middle = (low + high) / 2
    below = np.repeat(corner[:, None], len(first), axis=1)
    at, by = rows["x1"][crossing], w[:, crossing]
    order = np.argsort(at)
    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(by[:, order], axis=1)], axis=1)
    below += sums[:, np.searchsorted(at[order], middle[:, 0])]
    slanted = np.flatnonzero(high[:, 0] > low[:, 0])
    for begin in range(0, len(first), CHUNK):
        i = np.arange(begin, min(begin + CHUNK, len(first)))
        x, y = middle[i, 0][:, None], middle[i, 1][:, None]
        u, v = low[slanted], high[slanted]
        over = (u[:, 0] < x) & (x <= v[:, 0])
        height = u[:, 1] + (x - u[:, 0]) / (v[:, 0] - u[:, 0]) * (v[:, 1] - u[:, 1])
        over &= (height < y) & (i[:, None] != slanted[None, :])
        below[:, i] += total[:, slanted] @ over.T.astype(np.int64)
    upright = high[:, 0] == low[:, 0]
    left = np.where(upright, below, below + total)
    right = np.where(upright, below - total, below)
    inside, outside = _inside(left, keep), _inside(right, keep)
    bound = np.flatnonzero(inside != outside)
    first, against = first[bound], outside[bound]  # the inside has to be on the left
    # s0 to s1 is along the carrier, whatever the direction of the part
    flipped = turned[first]
    start, end = np.where(flipped[:, None], high[bound], low[bound]), np.where(flipped[:, None], low[bound], high[bound])
    whole = several[bound]
    return [rows["edge"][piece][e[first]], against != flipped, s0[first], s1[first], c0[first] & ~whole, c1[first] & ~whole, start[:, 0], start[:, 1], end[:, 0], end[:, 1]]


_OUT = ["edge", "back", "s0", "s1", "cut0", "cut1", "x1", "y1", "x2", "y2"]


def _arranged(batches: Iterator[pa.RecordBatch], names: list[str], keys: int, keep: str) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by cell, the rows of a cell by kind."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        borders = _borders(held, names)
        if len(borders) > 1:  # the last cell may go on
            yield from _cells(held, borders, names[:keys], keep)
            held = held.slice(borders[-1])
    if held is not None and held.num_rows:
        yield from _cells(held, [*_borders(held, names), held.num_rows], names[:keys], keep)


def _cells(table: pa.Table, borders: list[int], by: list[str], keep: str) -> Iterator[pa.RecordBatch]:
    """The cells between the borders, in one batch: a cell has few rows, which would cost more as batches of their own."""
    found = [batch for a, b in zip(borders[:-1], borders[1:]) for batch in _cell(table.slice(a, b - a), by, keep)]
    if found:
        yield from pa.Table.from_batches(found).combine_chunks().to_batches()


def _borders(table: pa.Table, names: list[str]) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in names:
        values = table.column(c).combine_chunks().dictionary_encode() if table.num_rows else None
        if values is not None:
            values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
            codes = values.indices.fill_null(-1).to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new).tolist()


def _cell(table: pa.Table, by: list[str], keep: str) -> Iterator[pa.RecordBatch]:
    rows = {c: table.column(c).to_numpy() for c in ("kind", "edge", "x1", "y1", "x2", "y2", "t0", "t1", "w0", "w1")}
    if not (rows["kind"] == 2).any():
        return
    out = _arrange(rows, keep)
    n = len(out[0])
    if n:
        same = [table.column(c).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in by]
        same = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in same]
        yield pa.RecordBatch.from_arrays([*same, pa.array(out[0].astype(np.int64)), *[pa.array(x) for x in out[1:]]], names=[*by, *_OUT])


def dissolved(df: DataFrame, by: list[str], ring: str, cell: int, scale: float = 1.0) -> DataFrame:
    """The boundary of the union of the rings of each group (A18, G05), in scaled units."""
    return overlay(ring_edges(df, by, ring, scale), by, cell)


def area(edges: DataFrame, by: list[str], scale: float = 1.0) -> DataFrame:
    """(*by, area, perimeter) inside a boundary."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return edges.groupBy(*by).agg((F.sum(cross) / 2 / scale**2).alias("area"), (F.sum(length) / scale).alias("perimeter"))


def followed(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges with ``_edge`` and ``_next``, the edge that goes on around the same inside. At a point where several meet that is the first one clockwise."""
    placed = stored(edges.withColumn("_edge", F.monotonically_increasing_id()), "boundary")
    into = placed.select(*by, "_edge", F.col("x2").alias("x"), F.col("y2").alias("y"), F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("_from"))
    out = placed.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_edge").alias("_to"), F.col("x1").alias("_x"), F.col("y1").alias("_y"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("_angle"))
    turn = F.pmod(F.col("_from") - F.col("_angle"), F.lit(2 * math.pi))
    met = into.join(out, _same([*by, "x", "y"]))
    links = met.groupBy("_edge").agg(F.min_by("_to", F.when(turn < 1e-12, 2 * math.pi).otherwise(turn)).alias("_next"))
    return placed.join(links, "_edge", "left")


def rings(edges: DataFrame, by: list[str], places: bool = True) -> DataFrame:
    """(*by, x1, y1, x2, y2, ring, place): boundary edges with the ring that they are part of, and, with ``places``, their place in it from 0."""
    linked = stored(followed(edges, by), "followed")
    named = ranked(linked.select(F.col("_edge").alias("id"), F.col("_next").alias("next")), places).toDF("_edge", "_ring", "_steps", "_closed")
    if not places:
        return linked.join(named, "_edge").select(*by, "x1", "y1", "x2", "y2", F.col("_ring").alias("ring"), F.lit(None).cast("long").alias("place"))
    placed = stored(linked.join(named, "_edge"), "ringed")
    most = placed.groupBy("_ring").agg(F.max("_steps").alias("_most"))
    return placed.join(most, "_ring").select(*by, "x1", "y1", "x2", "y2", F.col("_ring").alias("ring"), (F.col("_most") - F.col("_steps")).alias("place"))


def ring_areas(found: DataFrame, by: list[str], scale: float = 1.0) -> DataFrame:
    """(*by, ring, area, points): areas are negative for holes."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return found.groupBy(*by, "ring").agg((F.sum(cross) / 2 / scale**2).alias("area"), F.count(F.lit(1)).alias("points"))


def ring_points(found: DataFrame, by: list[str], scale: float = 1.0) -> DataFrame:
    """(*by, ring, points): each ring as a list of points."""
    points = F.array_sort(F.collect_list(F.struct("place", (F.col("x1") / scale).alias("x"), (F.col("y1") / scale).alias("y"))))
    return found.groupBy(*by, "ring").agg(F.transform(points, lambda p: F.struct(p["x"], p["y"])).alias("points"))


def _normal(a: Column, b: Column, distance: float | Column) -> tuple[Column, Column]:
    """The vector of length ``distance`` to the left of a to b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.hypot(dx, dy)
    return -dy / length * distance, dx / length * distance


def _moved(p: Column, x: Column, y: Column) -> Column:
    return F.struct((p["x"] + x).alias("x"), (p["y"] + y).alias("y"))


def _strip(a: Column, b: Column, distance: float | Column) -> Column:
    """What lies beside a segment, up to its flat ends."""
    x, y = _normal(a, b, distance)
    return F.array(_moved(a, -x, -y), _moved(b, -x, -y), _moved(b, x, y), _moved(a, x, y))


def _joint(a: Column, b: Column, c: Column, distance: float | Column) -> Column:
    """The mitre on the outer side of the corner b; the plain corner where it would be too long. Null where the way goes straight on or back."""
    x1, y1 = _normal(a, b, distance)
    x2, y2 = _normal(b, c, distance)
    turn = x1 * y2 - y1 * x2
    side = F.when(turn > 0, -1.0).otherwise(1.0)
    share = 1 + (x1 * x2 + y1 * y2) / (distance * distance)
    first, second = _moved(b, side * x1, side * y1), _moved(b, side * x2, side * y2)
    tip = _moved(b, side * (x1 + x2) / share, side * (y1 + y2) / share)
    near, far = F.when(turn > 0, first).otherwise(second), F.when(turn > 0, second).otherwise(first)
    shape = F.when(2 / share <= MITRE_LIMIT**2, F.array(b, near, tip, far)).otherwise(F.array(b, near, far))
    return F.when((F.abs(turn) > 1e-12 * (distance * distance)) & (share > 1e-9), shape)


def line_strips(df: DataFrame, by: list[str], points: str, distance: float | Column) -> DataFrame:
    """(*by, ring): pieces whose union is the buffer of a line, with flat ends and mitres (G09). Points that repeat are one.

    ``distance``: a number, or a column made of ``by``.
    """
    line = F.filter(F.transform(points, lambda p, i: F.when((i == 0) | (p != F.get(F.col(points), i - 1)), p)), lambda p: p.isNotNull())
    clean = df.select(*by, line.alias("_l")).where(F.size("_l") >= 2)
    n = F.size("_l")
    strips = F.transform(F.slice("_l", F.lit(1), n - 1), lambda p, i: _strip(p, F.get("_l", i + 1), distance))
    joints = F.transform(F.slice("_l", F.lit(1), n - 2), lambda p, i: _joint(p, F.get("_l", i + 1), F.get("_l", i + 2), distance))
    return clean.select(*by, F.explode(F.array_compact(F.concat(strips, joints))).alias("ring"))


def border_strips(edges: DataFrame, by: list[str], distance: float | Column) -> DataFrame:
    """(*by, ring): pieces whose union is the buffer of a boundary, with mitres at its corners."""
    linked = stored(followed(edges, by), "followed")
    after = linked.select(F.col("_edge").alias("_after"), end_point(2).alias("_c"))
    a, b = end_point(1), end_point(2)
    corners = linked.join(after, F.col("_next") == F.col("_after"))
    return corners.select(*by, F.explode(F.array_compact(F.array(_strip(a, b, distance), _joint(a, b, F.col("_c"), distance)))).alias("ring"))


def _weighted(edges: DataFrame, by: list[str]) -> DataFrame:
    """A boundary as edges of layer 0, on whole coordinates."""
    return edges.select(*by, *[F.round(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(1).cast("long").alias("w0"), F.lit(0).cast("long").alias("w1")).where("x1 != x2 or y1 != y2")


def outlines(alleys: DataFrame, shapes: DataFrame, by: str, width: float, scale: float, cell: int, out: float = 2.5, back: float = 1.5, least: float = 30.0) -> DataFrame:
    """(by, ring, area, points): the outline of each place from its ways and areas.

    ``alleys``(by, points) become strips of a ``width`` with flat ends; with ``shapes``(by, points), the buildings and areas
    that belong to a place, they are dissolved, and small gaps are closed by going ``out`` and ``back``. Parts of up to
    ``least`` are dropped, and holes with them; areas count in units, edges are ``scale`` times as large.
    """
    strips = line_strips(alleys, [by], "points", width / 2)
    rows = strips.unionByName(shapes.select(by, F.col("points").alias("ring")))
    union = dissolved(rows, [by], "ring", cell, scale)
    wide = buffered(union, [by], out * scale, cell)
    closed = stored(rings(buffered(wide, [by], back * scale, cell, inwards=True), [by], places=False), "outlines")
    sizes = stored(ring_areas(closed, [by], scale).where(F.abs("area") > least), "sizes")
    return sizes.select(by, "ring", "area", "points")


def place_shapes(hits: DataFrame, by: str, cell: int, scale: float = 1.0, least: float = geometry.LEAST_SHAPE) -> tuple[DataFrame, DataFrame]:
    """(areas, lines) of places out of map features that carry their names.

    ``hits``(by, points, area, itself, street): features that are an area by their tags, or named exactly as the place,
    count where they are closed; areas(by, ring, area, points) has the parts of their union over ``least``. Places without
    any such feature have the lines of their streets, lines(by, points).
    """
    ring = geometry.way_ring(F.col("points"))
    shaped = hits.withColumn("_ring", F.when((F.col("area") | F.col("itself")) & ~F.col("street"), ring))
    areas = stored(shaped.where("_ring is not null").select(by, F.col("_ring").alias("ring")), "areas")
    found = rings(dissolved(areas, [by], "ring", cell, scale), [by], places=False)
    kept = ring_areas(found, [by], scale).where(F.abs("area") > least).select(by, "ring", "area", "points")
    lines = hits.where("street").where(F.size("points") >= 2).join(areas.select(by).distinct(), by, "left_anti").select(by, "points")
    return kept, lines


def buffered(edges: DataFrame, by: list[str], distance: float | Column, cell: int, inwards: bool = False) -> DataFrame:
    """A boundary moved outwards by ``distance``, or ``inwards``, with mitres (G09). ``distance``: a number, or a column made of ``by``."""
    edges = stored(edges, "unbuffered")
    around = ring_edges(border_strips(edges, by, distance), by, "ring", layer=1 if inwards else 0)
    return overlay(_weighted(edges, by).unionByName(around), by, cell, "difference" if inwards else "union")


def simplified_borders(edges: DataFrame, area_id: str, tolerance: float) -> DataFrame:
    """(area_id, x1, y1, x2, y2): the boundaries of areas with fewer points, the same on both sides.

    Boundaries are cut into arcs where more than two edges meet or another area begins; each arc is simplified once,
    and all areas beside it take the same result. ``edges``(area_id, x1, y1, x2, y2): inside on the left, as
    ``dissolved`` gives them, with equal points on both sides of a border. An arc that is a whole ring keeps three points.
    Arcs that would share an edge once they are simplified keep all their points.
    """
    ship_package(edges.sparkSession)
    forward = end_point(1) < end_point(2)
    low, high = F.least(end_point(1), end_point(2)), F.greatest(end_point(1), end_point(2))
    # what lies to the left and to the right of an edge from its lower to its higher end
    both = edges.groupBy(low.alias("a"), high.alias("b")).agg(F.max(F.when(forward, F.col(area_id))).alias("on_left"), F.max(F.when(~forward, F.col(area_id))).alias("on_right"))
    point = lambda s: F.struct(F.col(f"{s}.x").cast("double").alias("x"), F.col(f"{s}.y").cast("double").alias("y"))
    pair = F.least("on_left", "on_right"), F.greatest("on_left", "on_right")
    lines = stored(both.select(*[p.alias(c) for p, c in zip(pair, ("p", "q"))], "on_left", "on_right", F.array(point("a"), point("b")).alias("points")), "borders")
    arcs = stored(whole_lines(merged_lines(lines.select("p", "q", "points"), ["p", "q"], "points", across=True), ["p", "q"]), "arcs")
    # an arc's side is told by one of its edges
    first = F.struct(F.element_at("points", 1).alias("a"), F.element_at("points", 2).alias("b"))
    told = arcs.select("p", "q", "line", F.least(first["a"], first["b"]).alias("lo"), F.greatest(first["a"], first["b"]).alias("hi"), (first["a"] < first["b"]).alias("up"))
    sides = lines.select(F.col("points")[0].alias("lo"), F.col("points")[1].alias("hi"), "on_left", "on_right")
    told = told.join(sides, ["lo", "hi"]).select("line", F.when(F.col("up"), F.col("on_left")).otherwise(F.col("on_right")).alias("l"), F.when(F.col("up"), F.col("on_right")).otherwise(F.col("on_left")).alias("r"))
    n = F.size("points")
    half = F.greatest(F.lit(2), F.ceil(n / 2).cast("int"))
    # a ring has its first point at both ends: two halves keep a point between them
    halves = F.when(F.col("ring") & (n > 4), F.array(F.slice("points", F.lit(1), half), F.slice("points", half, n - half + 1))).otherwise(F.array("points"))
    cut = arcs.select("line", F.posexplode(halves).alias("k", "part"), F.col("ring"), n.alias("n"))
    small = F.col("ring") & (F.col("n") <= 4)
    thin = stored(cut.select("line", "k", F.when(small, F.col("part")).otherwise(geometry.simplified(F.col("part"), tolerance)).alias("part"), F.col("part").alias("full")), "thin")
    while True:
        # arcs that came to lie on one another would leave nothing between them: they keep their points
        ways = thin.select("line", "k", (F.size("part") < F.size("full")).alias("less"), F.explode(F.transform(F.slice("part", F.lit(1), F.size("part") - 1), lambda p, i: F.struct(F.least(p, F.get("part", i + 1)).alias("a"), F.greatest(p, F.get("part", i + 1)).alias("b")))).alias("s"))
        twice = ways.groupBy("s").count().where("count > 1").select("s")
        again = stored(ways.join(twice, "s", "left_semi").where("less").select("line", "k").distinct().withColumn("again", F.lit(True)), "again")
        if again.isEmpty():
            break
        before, thin = thin, stored(thin.join(again, ["line", "k"], "left").select("line", "k", F.when(F.col("again"), F.col("full")).otherwise(F.col("part")).alias("part"), "full"), "thin")
        released(before, again)
    steps = thin.select("line", F.explode(F.transform(F.slice("part", F.lit(1), F.size("part") - 1), lambda p, i: F.struct(p.alias("a"), F.get("part", i + 1).alias("b")))).alias("e")).join(told, "line")
    beside = steps.select(F.explode(F.array(F.struct(F.col("l").alias("area"), F.col("e.a").alias("a"), F.col("e.b").alias("b")), F.struct(F.col("r").alias("area"), F.col("e.b").alias("a"), F.col("e.a").alias("b")))).alias("s"))
    return beside.select(F.col("s.area").alias(area_id), F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")).where(F.col(area_id).isNotNull())


def cut_alike(edges: DataFrame, by: list[str]) -> DataFrame:
    """Axis-parallel boundaries cut at each other's corners, so that both sides of a shared border have equal points."""
    upright = F.col("x1") == F.col("x2")
    on = F.when(upright, F.col("x1")).otherwise(F.col("y1"))
    low, high = (F.when(upright, f("y1", "y2")).otherwise(f("x1", "x2")) for f in (F.least, F.greatest))
    # an edge meets the corners of at most three stretches of its line, which are as long as the next power of two
    level = F.ceil(F.log2(high - low)).cast("int")
    given = stored(edges.withColumns({"_row": F.monotonically_increasing_id(), "up": upright, "on": on, "low": low, "high": high, "level": level}), "given")
    corners = given.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("p.*").distinct()
    stretch = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("level")))
    # lengths have few powers, whatever the number of edges
    levels = [r.level for r in given.where("level is not null").select("level").distinct().collect()]
    marks = corners.select(F.explode(F.array(F.struct(F.lit(True).alias("up"), F.col("x").alias("on"), F.col("y").alias("at")), F.struct(F.lit(False).alias("up"), F.col("y").alias("on"), F.col("x").alias("at")))).alias("m")).select("m.*")
    marks = marks.withColumn("level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("stretch", stretch("at"))
    reach = given.select("_row", "up", "on", "low", "high", "level", F.explode(F.sequence(stretch("low"), stretch("high"))).alias("stretch"))
    inside = reach.join(marks, ["up", "on", "level", "stretch"]).where("low < at and at < high").groupBy("_row").agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    rows = given.join(inside, "_row", "left").withColumn("ends", F.concat(F.array("low"), F.coalesce("cuts", F.array().cast("array<double>")), F.array("high")))
    forward = F.when(F.col("up"), F.col("y1") < F.col("y2")).otherwise(F.col("x1") < F.col("x2"))
    steps = rows.select(*by, "up", "on", forward.alias("forward"), F.explode(F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda a, i: F.struct(a.alias("a"), F.get("ends", i + 1).alias("b")))).alias("s"))
    first, last = F.when(F.col("forward"), F.col("s.a")).otherwise(F.col("s.b")), F.when(F.col("forward"), F.col("s.b")).otherwise(F.col("s.a"))
    at = lambda v: (F.when(F.col("up"), F.col("on")).otherwise(v), F.when(F.col("up"), v).otherwise(F.col("on")))
    return steps.select(*by, at(first)[0].alias("x1"), at(first)[1].alias("y1"), at(last)[0].alias("x2"), at(last)[1].alias("y2"))


def coast_areas(coast: DataFrame, points: str, box: tuple[float, float, float, float], land: bool) -> DataFrame:
    """The boundary (x1, y1, x2, y2) of the land, or the sea, inside a box (G12), inside on the left.

    ``coast``: directed lines with the land on the left, which may end anywhere outside the box or join at their ends.
    They are clipped to the box, and along its border, anticlockwise, the place where one leaves is joined to the next
    where one enters. A box without any coast has no boundary. Crossing coasts are not repaired.
    """
    x0, y0, x1, y1 = box
    line = F.col(points) if land else F.reverse(points)
    pairs = F.transform(F.slice(line, F.lit(1), F.size(line) - 1), lambda p, i: F.struct(p.alias("a"), F.get(line, i + 1).alias("b")))
    steps = coast.where(F.size(points) >= 2).select(F.explode(pairs).alias("s")).select(*[F.col(f"s.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    enter, leave = F.lit(0.0), F.lit(1.0)
    for d, a, low, high in ((dx, F.col("ax"), x0, x1), (dy, F.col("ay"), y0, y1)):
        s, e = (F.lit(low) - a) / F.nullif(d, F.lit(0.0)), (F.lit(high) - a) / F.nullif(d, F.lit(0.0))
        outside = (d == 0) & ((a <= low) | (a >= high))
        enter = F.when(outside, 2.0).otherwise(F.greatest(enter, F.least(s, e)))
        leave = F.when(outside, -1.0).otherwise(F.least(leave, F.greatest(s, e)))
    inside = steps.withColumns({"t0": enter, "t1": leave}).where("t0 < t1")
    # an end that lies on the border takes the border's own coordinate
    hold = lambda c, low, high: F.when(F.abs(c - low) < 1e-9 * (high - low), F.lit(float(low))).when(F.abs(c - high) < 1e-9 * (high - low), F.lit(float(high))).otherwise(c)
    at = lambda t, k: F.struct(hold(F.col("ax") + F.col(t) * dx, x0, x1).alias("x"), hold(F.col("ay") + F.col(t) * dy, y0, y1).alias("y")).alias(k)
    given = lambda p, t, whole, k: F.when(F.col(t) == whole, F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))).otherwise(at(t, k)).alias(k)
    kept = stored(inside.select(given("a", "t0", 0.0, "a"), given("b", "t1", 1.0, "b")), "coast")
    width, height = float(x1 - x0), float(y1 - y0)

    def place(p: Column) -> Column:
        """How far along the border, anticlockwise from the lower left corner; null inside."""
        return (
            F.when(p["y"] == y0, p["x"] - x0).when(p["x"] == x1, width + p["y"] - y0).when(p["y"] == y1, width + height + x1 - p["x"]).when(p["x"] == x0, 2 * width + height + y1 - p["y"])
        )

    corners = [(x0, y0, 0.0), (x1, y0, width), (x1, y1, width + height), (x0, y1, 2 * width + height)]
    spark = coast.sparkSession
    turns = spark.createDataFrame([(float(x), float(y), s, 1) for x, y, s in corners], "x double, y double, s double, kind int")
    outs = kept.select(F.col("b.x").alias("x"), F.col("b.y").alias("y"), place(F.col("b")).alias("s"), F.lit(0).alias("kind")).where("s is not null")
    ins = kept.select(F.col("a.x").alias("x"), F.col("a.y").alias("y"), place(F.col("a")).alias("s"), F.lit(2).alias("kind")).where("s is not null")
    # only the places where the coast crosses the border are in this window
    around = outs.unionByName(ins).unionByName(turns)
    w = Window.orderBy("s", "kind")
    last = F.last(F.when(F.col("kind") != 1, F.col("kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ordered = stored(around.withColumns({"state": last, "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}), "border")
    ends = ordered.where("kind != 1").agg(F.max_by("kind", F.struct("s", "kind")).alias("k"), F.count(F.lit(1)).alias("n")).first()
    head = ordered.agg(F.min_by(F.struct("x", "y"), F.struct("s", "kind")).alias("p")).first()["p"]
    closing = F.coalesce("nx", F.lit(head["x"])), F.coalesce("ny", F.lit(head["y"]))
    # from where a coast leaves until the next one enters the inside is beside the border
    state = F.coalesce("state", F.lit(ends["k"] if ends["n"] else 2))
    border = ordered.where(state == 0).select(F.col("x").alias("x1"), F.col("y").alias("y1"), closing[0].alias("x2"), closing[1].alias("y2")).where("x1 != x2 or y1 != y2")
    return kept.select(F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).unionByName(border)
