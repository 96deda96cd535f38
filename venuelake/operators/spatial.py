"""Spatial joins on grid cells: candidates meet by an equi join on cells, and an exact distance decides.

Cells are at least as wide as the radius, so the 3 x 3 cells around a point hold every partner. The side that is
probed is repeated nine times; choose the smaller one. The other side keeps one row per point, and adaptive
execution splits cells that hold too many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import metres
from ..stored import stored

#: Metres of a degree of latitude, a little less than any formula here takes it for.
_DEGREE = 110000.0


def _cells(lat: Column, lng: Column, radius: float, widest_lat: float) -> tuple[Column, Column]:
    import math

    high = radius / _DEGREE
    return F.floor(lat / high), F.floor(lng / (high / math.cos(math.radians(widest_lat))))


def within(
    left: DataFrame, right: DataFrame, radius: float, left_at: tuple[str, str], right_at: tuple[str, str],
    distance: Callable[[Column, Column, Column, Column], Column] = metres, how: str = "inner", strict: bool = False, widest_lat: float = 60.0,
) -> DataFrame:
    """Pairs within ``radius`` metres (or the left rows with or without such a partner), with ``distance``.

    ``widest_lat``: no latitude is further from the equator. Null coordinates match nothing.
    """
    la, lo = _cells(F.col(left_at[0]), F.col(left_at[1]), radius, widest_lat)
    ra, ro = _cells(F.col(right_at[0]), F.col(right_at[1]), radius, widest_lat)
    around = F.explode(F.array(*[F.struct((ra + i).alias("_ca"), (ro + j).alias("_co")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    placed = left.withColumns({"_la": la, "_lo": lo})
    probing = right.withColumn("_cell", around).select("*", "_cell._ca", "_cell._co").drop("_cell")
    d = distance(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    near = (d < radius) if strict else (d <= radius)
    joined = placed.join(probing, (F.col("_la") == F.col("_ca")) & (F.col("_lo") == F.col("_co")) & near, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_la", "_lo")
    return joined.withColumn("distance", d).drop("_la", "_lo", "_ca", "_co")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as shuffles have: adaptive execution would judge by its bytes, and a small side whose join has many candidates would be a few tasks' work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def nearest_k(pairs: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` partners of each group, with ``rank`` from 1."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


#: How often the radius of ``nearest_others`` is halved where points are dense, and metres of a degree, a little more than any formula here takes it for.
HALVINGS, _LONG_DEGREE = 10, 111700.0


def nearest_others(points: DataFrame, key: str, at: tuple[str, str], k: int, radius: float, distance: Callable[[Column, Column, Column, Column], Column] = metres, widest_lat: float = 60.0) -> DataFrame:
    """(key, other, distance, rank): the ``k`` nearest other points nearer than ``radius`` metres, ties to the smallest ``other``.

    Points at one place are looked up once, and no place gives more than its ``k + 1`` smallest keys. Where a cell of side
    ``radius / 2^n`` holds more than ``k`` of them, the extent of its places bounds the distance to the last one wanted,
    and only the 3 x 3 cells of the least side that holds the bound are read, so dense places don't meet all that is
    within the radius. Null coordinates match nothing; keys are distinct.
    """
    sides = [radius / 2**n for n in range(HALVINGS + 1)]

    def cells(lat: Column, lng: Column) -> Column:
        parts = [(F.lit(n), *_cells(lat, lng, side, widest_lat)) for n, side in enumerate(sides)]
        return F.array(*[F.struct(n.alias("_l"), a.alias("_a"), o.alias("_o")) for n, a, o in parts])

    given = points.select(F.col(key).alias("_key"), F.col(at[0]).alias("_lat"), F.col(at[1]).alias("_lng")).where("_lat is not null and _lng is not null")
    least = nearest_k(given, ["_lat", "_lng"], [F.col("_key")], k + 1)
    places = stored(least.groupBy("_lat", "_lng").agg(F.sort_array(F.collect_list("_key")).alias("_keys")), "places")
    celled = places.withColumn("_cell", F.explode(cells(F.col("_lat"), F.col("_lng"))))
    box = celled.groupBy("_cell").agg(
        F.sum(F.size("_keys")).alias("_n"), F.min("_lat").alias("_s"), F.max("_lat").alias("_e"), F.min("_lng").alias("_w"), F.max("_lng").alias("_o"), F.min(F.abs("_lat")).alias("_low")
    ).where(F.col("_n") > k)
    across = F.hypot(F.col("_e") - F.col("_s"), (F.col("_o") - F.col("_w")) * F.cos(F.radians("_low"))) * _LONG_DEGREE
    bounds = celled.join(box.select("_cell", across.alias("_across")), "_cell").groupBy("_lat", "_lng").agg(F.min("_across").alias("_bound"))
    level = F.coalesce(*[F.when(F.col("_bound") <= side, F.lit(n)) for n, side in reversed(list(enumerate(sides)))], F.lit(0))
    around = lambda cell: F.explode(F.array(*[F.struct(cell["_l"].alias("_l"), (cell["_a"] + i).alias("_a"), (cell["_o"] + j).alias("_o")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    looking = places.select("_lat", "_lng").join(bounds, ["_lat", "_lng"], "left").withColumn("_cell", F.get(cells(F.col("_lat"), F.col("_lng")), level))
    d = distance(F.col("_lat"), F.col("_lng"), F.col("_rlat"), F.col("_rlng"))
    known = celled.select("_cell", F.col("_lat").alias("_rlat"), F.col("_lng").alias("_rlng"), "_keys")
    pairs = spread(looking.select("_lat", "_lng", around(F.col("_cell")).alias("_cell"))).join(known, "_cell").withColumn("distance", d).where(F.col("distance") < radius)
    # of equally near keys the smallest ones count, so k + 1 places hold all that is wanted, the point itself included
    few = nearest_k(pairs.withColumn("_first", F.col("_keys")[0]), ["_lat", "_lng"], [F.col("distance"), F.col("_first")], k + 1)
    each = few.select("_lat", "_lng", "distance", F.explode("_keys").alias("other"))
    best = nearest_k(each, ["_lat", "_lng"], [F.col("distance"), F.col("other")], k + 1).drop("rank")
    others = given.join(best, ["_lat", "_lng"]).where("_key != other").select(F.col("_key").alias(key), "other", "distance")
    return nearest_k(others, [key], [F.col("distance"), F.col("other")], k)


#: Radii in metres of the levels that nearest_one searches on; the last one covers any two points.
LEVELS = [100.0 * 4**i for i in range(11)]


def nearest_one(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], order: str, take: list[str], key: list[str], widest_lat: float | None = None) -> DataFrame:
    """Each left row with the nearest right row at any distance (J04); ties go to the smallest ``order``.

    On each level one right row of a cell stands for it: the nearest of those around a left row bounds its distance.
    All right rows are then looked at on the first level whose radius holds that bound, by an equi join on cells.
    Rows without coordinates are left out. ``widest_lat``: no latitude is further from the equator; else it is looked up.
    """
    if widest_lat is None:
        most = [df.agg(F.max(F.abs(F.col(at[0])))).first()[0] for df, at in ((left, left_at), (right, right_at))]
        widest_lat = min(max([x for x in most if x is not None], default=0.0), 89.9999)
    around = lambda cell: F.explode(F.array(*[F.struct(cell["_l"].alias("_l"), (cell["_a"] + i).alias("_a"), (cell["_o"] + j).alias("_o")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))

    def cells(lat: Column, lng: Column) -> Column:
        parts = []
        for n, radius in enumerate(LEVELS):
            a, o = _cells(lat, lng, radius, widest_lat)
            parts.append(F.struct(F.lit(n).alias("_l"), a.alias("_a"), o.alias("_o")))
        return F.array(*parts)

    at = left.select(*key, F.col(left_at[0]).alias("_lat"), F.col(left_at[1]).alias("_lng")).where("_lat is not null and _lng is not null")
    known = right.select(F.col(right_at[0]).alias("_rlat"), F.col(right_at[1]).alias("_rlng"), F.col(order).alias("_order"), F.struct(*take).alias("_take"))
    known = known.where("_rlat is not null and _rlng is not null").withColumn("_cell", F.explode(cells(F.col("_rlat"), F.col("_rlng"))))
    d = metres(F.col("_lat"), F.col("_lng"), F.col("_rlat"), F.col("_rlng"))

    one = known.groupBy("_cell").agg(F.min(F.struct("_rlat", "_rlng")).alias("_p")).select(around(F.col("_cell")).alias("_cell"), "_p._rlat", "_p._rlng")
    bound = at.withColumn("_cell", F.explode(cells(F.col("_lat"), F.col("_lng")))).join(one, "_cell").groupBy(*key, "_lat", "_lng").agg(F.min(d).alias("_bound"))
    # a little wider, so that rounding can't put a partner outside
    level = F.coalesce(*[F.when(F.col("_bound") * 1.000001 <= r, F.lit(n)) for n, r in enumerate(LEVELS)], F.lit(len(LEVELS) - 1))
    probing = bound.withColumn("_cell", around(F.get(cells(F.col("_lat"), F.col("_lng")), level)))
    best = F.min_by("_take", F.struct(d.alias("d"), F.col("_order").alias("o"))).alias("_best")
    return probing.join(known, "_cell").groupBy(*key).agg(best).select(*key, "_best.*")


def grid_anti(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], cell: float, d_lat: float, d_lng: float) -> DataFrame:
    """Left rows without a right row within a box of degrees (J11); the cell is at least as wide as the box."""
    floor = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.array(*[F.struct((floor(right_at[0]) + i).alias("_ca"), (floor(right_at[1]) + j).alias("_co")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    probing = right.withColumn("_cell", around).select("*", "_cell._ca", "_cell._co").drop("_cell")
    near = (F.abs(F.col(left_at[0]) - F.col(right_at[0])) <= d_lat) & (F.abs(F.col(left_at[1]) - F.col(right_at[1])) <= d_lng)
    return left.join(probing, (floor(left_at[0]) == F.col("_ca")) & (floor(left_at[1]) == F.col("_co")) & near, "left_anti")
