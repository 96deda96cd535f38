"""Geodesy and rounding expressions. Coordinates are degrees, world units are Web Mercator pixels at zoom 18."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORLD = 256.0 * 2**18
#: Fixed radii: build-time metres, query-time metres.
R_BUILD, R_QUERY = 6371008.8, 6371000.0


def proj(lng: Column, lat: Column) -> Column:
    """struct<x, y> in world units."""
    s = F.sin(F.radians(lat))
    return F.struct(
        ((lng + 180.0) / 360.0 * WORLD).alias("x"),
        ((0.5 - F.ln((1 + s) / (1 - s)) / (4 * F.pi())) * WORLD).alias("y"),
    )


def unproj(x: Column, y: Column) -> Column:
    """struct<lng, lat>."""
    return F.struct((x / WORLD * 360.0 - 180.0).alias("lng"), F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / WORLD)))).alias("lat"))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular metres."""
    x = F.radians(lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * R_BUILD


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * R_QUERY * F.asin(F.sqrt(a))


def flat_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a plane scaled at the first point."""
    x = (lng2 - lng1) * 111320.0 * F.cos(F.radians(lat1))
    y = (lat2 - lat1) * 111320.0
    return F.sqrt(x * x + y * y)


def metres_per_unit(lat: Column) -> Column:
    return F.cos(F.radians(lat)) * 40075016.686 / WORLD


def tile(lng: Column, lat: Column, zoom: int) -> Column:
    """struct<x, y> of the slippy tile."""
    n, r = float(2**zoom), F.radians(lat)
    return F.struct(
        F.floor((lng + 180.0) / 360.0 * n).alias("x"),
        F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * n).alias("y"),
    )


def tile_of_units(x: Column, size: int) -> Column:
    """Index of the cell of ``size`` world units."""
    return F.floor(x / size)


def min_zoom(area: Column, pixels: float = 1.0, low: int = 10, high: int = 17) -> Column:
    """First zoom at which an area covers ``pixels`` squared (M09); nothing to show is shown last."""
    z = F.ceil(18 - F.log(4.0, area / (pixels * pixels)))
    return F.when(area <= 0, high).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), z))).cast("int")


#: Fixed heights in metres of kinds of building; others are 8.
HEIGHTS = {
    "house": 7, "detached": 7, "residential": 10, "apartments": 14, "commercial": 14, "retail": 9, "office": 24, "hotel": 30, "public": 12,
    "school": 14, "warehouse": 8, "industrial": 9, "temple": 9, "shrine": 6, "roof": 4, "garage": 3, "shed": 3, "train_station": 12,
}


def building_height(height: Column, levels: Column, kind: Column) -> Column:
    """Metres from a height (2 to 300), else levels (3 to 300), else the kind."""
    by_kind = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in HEIGHTS.items()], F.lit(8))
    # greatest and least pass nulls over
    within = lambda c, low: F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(300), F.bround(c).cast("int"))))
    return F.coalesce(within(height.cast("double"), 2), within(levels.cast("int") * F.lit(3.3) + 1, 3), by_kind).cast("int")


def lerp(a: Column, b: Column, u: Column) -> Column:
    """From a to b by a share."""
    return a + (b - a) * u


def ease(u: Column) -> Column:
    """Cubic, slow at both ends."""
    return F.when(u < 0.5, 4 * u * u * u).otherwise(1 - F.pow(2 - 2 * u, F.lit(3)) / 2)


def ease_out(u: Column) -> Column:
    return 1 - F.pow(1 - u, F.lit(3))


def to_pixels(x: Column, y: Column, lat: float, lng: float, half_metres: float, size: int) -> Column:
    """struct<px, py> in a square sheet around a place."""
    centre, scale = proj(F.lit(lng), F.lit(lat)), size / 2 / half_metres * metres_per_unit(F.lit(lat))
    return F.struct(((x - centre["x"]) * scale + size / 2).alias("px"), ((y - centre["y"]) * scale + size / 2).alias("py"))


def from_pixels(px: Column, py: Column, lat: float, lng: float, half_metres: float, size: int) -> Column:
    """struct<x, y> in world units of a place on the sheet."""
    centre, scale = proj(F.lit(lng), F.lit(lat)), size / 2 / half_metres * metres_per_unit(F.lit(lat))
    return F.struct(((px - size / 2) / scale + centre["x"]).alias("x"), ((py - size / 2) / scale + centre["y"]).alias("y"))


def polar_offset(lat: Column, lng: Column, angle: Column, radius: Column) -> Column:
    """struct<lat, lng> moved by metres in a direction."""
    return F.struct(
        (lat + F.sin(angle) * radius / 111320.0).alias("lat"),
        (lng + F.cos(angle) * radius / (111320.0 * F.cos(F.radians(lat)))).alias("lng"),
    )


def walk_minutes(m: Column) -> Column:
    """At 80 m a minute, halves up, one at least."""
    return F.greatest(F.lit(1), F.floor(m / 80 + 0.5))


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive box."""
    return lat.between(south, north) & lng.between(west, east)


def signed_area(ring: Column) -> Column:
    """Shoelace sum over an array of struct<x, y>, closed by itself."""
    moved = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, moved, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x) / 2


def ring_centre(ring: Column) -> Column:
    """struct<x, y>: the centre of area of a ring (G11); of its points where it has none."""
    moved = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    # from the first point on, so that large coordinates don't cancel
    x0, y0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    cross = lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    twice = add(F.zip_with(ring, moved, cross))
    part = lambda n, o: add(F.zip_with(ring, moved, lambda a, b: (a[n] + b[n] - 2 * o) * cross(a, b)))
    mean = lambda n: add(ring[n]) / F.size(ring)
    flat = F.abs(twice) < 1e-12
    return F.struct(
        F.when(flat, mean("x")).otherwise(x0 + part("x", x0) / (3 * twice)).alias("x"),
        F.when(flat, mean("y")).otherwise(y0 + part("y", y0) / (3 * twice)).alias("y"),
    )
