"""Map elements from stored query responses (S06-S08), with the filters that a remote query would push down.

Nothing is fetched: a job writes responses to a folder, and Spark reads the folder, a task for some files. The filters
are plain columns, so they are evaluated in the scan's stage and unused parts of an element are not parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AT = "struct<lat: double, lon: double>"
ELEMENT = (
    f"struct<type: string, id: bigint, lat: double, lon: double, center: {_AT}, bounds: struct<minlat: double, minlon: double, maxlat: double, maxlon: double>, "
    f"tags: map<string, string>, geometry: array<{_AT}>, members: array<struct<type: string, ref: bigint, role: string, geometry: array<{_AT}>>>>"
)

#: Fixed tag values of places to drink, eat or stay at.
DRINK_AMENITY = ["bar", "pub", "restaurant", "izakaya", "biergarten", "cafe", "fast_food", "nightclub", "food_court", "karaoke_box"]
DRINK_SHOP = ["alcohol", "wine", "beverages", "butcher", "seafood", "deli", "convenience", "general", "confectionery"]
STAY = ["hostel", "guest_house", "hotel", "motel"]


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(file, elements, failed): a response failed if it can't be read, has no elements, or its remark tells of an error."""
    raw = spark.read.schema(f"elements array<{ELEMENT}>, remark string").option("multiLine", True).json(path)
    failed = F.col("elements").isNull() | F.coalesce(F.lower("remark").contains("error"), F.lit(False))
    return raw.select(F.col("_metadata.file_path").alias("file"), "elements", failed.alias("failed"))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of all responses that did not fail; of an element that several files have the whole row of the first file."""
    found = responses(spark, path).where(~F.col("failed")).select("file", F.posexplode("elements").alias("place", "e"))
    one = found.groupBy(F.col("e.type").alias("type"), F.col("e.id").alias("id")).agg(F.min_by("e", F.struct("file", "place")).alias("e"))
    return one.select("type", "id", *[f"e.{c}" for c in found.schema["e"].dataType.names if c not in ("type", "id")])


def place(lat: str = "lat", lon: str = "lon") -> Column:
    """struct<lat, lng> of an element: its own point, its centre, or the middle of its bounds; null without any."""
    y = F.coalesce(F.col(lat), F.col("center.lat"), (F.col("bounds.minlat") + F.col("bounds.maxlat")) / 2)
    x = F.coalesce(F.col(lon), F.col("center.lon"), (F.col("bounds.minlon") + F.col("bounds.maxlon")) / 2)
    return F.when(y.isNotNull() & x.isNotNull(), F.struct(y.alias("lat"), x.alias("lng")))


def tagged(tags: Column, equal: dict[str, str | list[str]] | None = None, like: dict[str, str] | None = None, present: tuple[str, ...] = (), absent: tuple[str, ...] = ()) -> Column:
    """Every condition on tags holds (S07): equal to a value or in a list, like a pattern, there, not there. Never null."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    out = F.lit(True)
    for k, v in (equal or {}).items():
        out &= F.coalesce(tag(k).isin(v) if isinstance(v, list) else tag(k) == v, F.lit(False))
    for k, pattern in (like or {}).items():
        out &= F.coalesce(tag(k).rlike(pattern), F.lit(False))
    for k in present:
        out &= tag(k).isNotNull()
    for k in absent:
        out &= tag(k).isNull()
    return out


def is_tunnel(tags: Column) -> Column:
    """Ways below ground or under a roof."""
    return tagged(tags, {"tunnel": ["yes", "building_passage", "covered"]}) | tagged(tags, {"location": "underground"})


def is_station(tags: Column, name: Column) -> Column:
    """Railway stations and halts, and stops that a train serves; no cable cars, piers, buildings or parts of a station."""
    rail = tagged(tags, {"railway": ["station", "halt"]})
    for k in ("train", "subway", "light_rail", "monorail", "tram"):
        rail |= tagged(tags, {k: "yes"})
    other = tagged(tags, {"station": "funicular"}) | tagged(tags, present=("building",)) | tagged(tags, {"amenity": "ferry_terminal"})
    return rail & ~other & ~F.coalesce(name.rlike("(駅舎|構内|改札口?|出口|船着場)$"), F.lit(False))


def is_business(tags: Column, is_area: Column) -> Column:
    """Places to drink, eat or stay at; areas may be anything."""
    listed = tagged(tags, {"amenity": DRINK_AMENITY}) | tagged(tags, {"shop": DRINK_SHOP}) | tagged(tags, {"tourism": STAY})
    return F.coalesce(is_area, F.lit(False)) | listed
