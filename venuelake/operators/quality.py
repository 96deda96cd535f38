"""Data-quality rules as a table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import metres_per_unit, signed_area


def violations(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, rule, severity) for each rule that a row breaks, in one pass (Q01). A condition that is null is no breach."""
    broken = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, c in rules]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("v")).select(key, "v.rule", "v.severity")


#: Fixed bounds of the map area (south, west, north, east), and columns that no row lacks.
AREA = (35.50, 139.24, 35.84, 139.94)
REQUIRED = ["name", "kind", "area", "social", "solo", "status"]


def row_rules(parents: Column) -> list[tuple[str, str, Column]]:
    """The rules of a venue (Q01): lat, lng, yokocho, REQUIRED, ward, gsi, geo, near_m, sources. ``parents``: the parent is known."""
    south, west, north, east = AREA
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    inside = (F.col("lat") > south) & (F.col("lat") < north) & (F.col("lng") > west) & (F.col("lng") < east)
    bad_link = F.exists(F.coalesce("sources", F.array().cast("array<string>")), lambda u: ~u.rlike("^https?://"))
    return [
        ("outside", "error", ~F.coalesce(inside, F.lit(False))),
        ("unknown parent", "error", some("yokocho") & ~parents),
        *[(f"missing {c}", "error", ~some(c)) for c in REQUIRED],
        ("bad source", "error", bad_link),
        ("ward differs", "note", some("ward") & some("gsi") & ~F.contains("gsi", F.col("ward")) & (F.coalesce("geo", F.lit("")) != "manual")),
        ("far from a station", "note", F.coalesce(F.col("near_m") > 1500, F.lit(True))),
        ("no source", "note", (F.col("status") == "open") & (F.coalesce(F.size("sources"), F.lit(0)) <= 0)),
    ]


def outline_numbers(outlines: DataFrame, key: str, rings: str, lat: str) -> DataFrame:
    """(key, parts, m2): how many parts of an outline there are, and their area (Q03)."""
    areas = F.transform(rings, lambda r: F.abs(signed_area(r)))
    total = F.aggregate(areas, F.lit(0.0), lambda s, x: s + x) * F.pow(metres_per_unit(F.col(lat)), F.lit(2))
    return outlines.select(key, F.size(rings).alias("parts"), F.bround(total).cast("long").alias("m2"))


def serious(found: DataFrame) -> int:
    """How many errors there are; a run should fail if any."""
    return found.where("severity = 'error'").count()
