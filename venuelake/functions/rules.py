"""Decision rules: the first condition that holds decides, so their order is the meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import scrub


def first_rule(*rules: tuple[Column, object], default: object = None) -> Column:
    """The value of the first condition that is true; null conditions are not."""
    out = None
    for condition, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def position(preset: Column, base: Column, level: Column, match: Column, match_m: Column, pin: Column, pin_m: Column, gate: Column) -> Column:
    """struct<at, geo> by precedence (C02): preset, else a match within the gate, else the geocode, which a near pin replaces if coarse."""
    coarse = level.isin("block", "town", "district")
    at = first_rule(
        (preset.isNotNull(), F.struct(preset.alias("at"), F.lit("manual").alias("geo"))),
        (match.isNotNull() & (match_m <= gate), F.struct(match.alias("at"), F.lit("matched").alias("geo"))),
        (coarse & pin.isNotNull() & (pin_m < 600), F.struct(pin.alias("at"), F.lit("pin").alias("geo"))),
        (base.isNotNull(), F.struct(base.alias("at"), F.lit("geocoded").alias("geo"))),
    )
    return at


#: Metres that a pin may lie off its outline.
OFF_OUTLINE = 8


def outline_position(at: Column, gap_m: Column, centre: Column) -> Column:
    """struct<at, geo> of ``position``, or the outline's centre if the pin lies further than 8 m off the outline.

    Without an outline, and so without a gap, nothing moves; without a position there is nothing to move.
    """
    off = at.isNotNull() & (gap_m > OFF_OUTLINE) & centre.isNotNull()
    return F.when(off, F.struct(centre.alias("at"), F.lit("outline").alias("geo"))).otherwise(at)


def review_reasons(base: Column, match_m: Column, gate: Column, pin_m: Column, level: Column, is_area: Column) -> Column:
    """Everything about a position that a person should look at."""
    return F.array_compact(F.array(
        F.when(base.isNull(), "no geocode"),
        F.when(~is_area & (match_m > 100) & (match_m <= gate), F.concat(F.lit("match "), F.bround(match_m).cast("int").cast("string"), F.lit("m from address"))),
        F.when(match_m > gate, "match too far"),
        F.when(pin_m > 120, F.concat(F.lit("pin "), F.bround(pin_m).cast("int").cast("string"), F.lit("m"))),
        F.when(~level.isin("number", "block"), F.concat(F.lit("address only to "), level)),
    ))


#: Fixed classes of ways, and the first zoom of each class.
ROADS = {
    "motorway": 20, "trunk": 21, "primary": 22, "secondary": 23, "tertiary": 24, "residential": 25, "unclassified": 25, "living_street": 25,
    "pedestrian": 26, "service": 27, "footway": 28, "path": 28, "cycleway": 28, "track": 28, "corridor": 28, "steps": 29,
}
ROAD_ZOOMS = {20: 10, 21: 10, 22: 11, 23: 12, 24: 13, 25: 15, 26: 15, 27: 16, 28: 16, 29: 16}
#: Fixed classes of green areas and of railways.
PARK, FOREST, CEMETERY, GRASS = 2, 3, 4, 5
RAIL_NATIONAL, RAIL, SUBWAY, LIGHT = 40, 41, 42, 43
#: Fixed first zoom and rank of places.
PLACES = {"city": (10, 3), "town": (11, 2), "suburb": (12, 2)}


def _of(c: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()])


def road_class(highway: Column, tunnel: Column) -> Column:
    """struct<cls, minz>: links show two zooms later, tunnels are 100 classes up (C06); null for other ways."""
    cls = _of(F.regexp_replace(highway, "_link$", ""), ROADS)
    zoom = _of(cls, ROAD_ZOOMS) + F.when(highway.endswith("_link"), 2).otherwise(0)
    hidden = F.coalesce(tunnel, F.lit("no")) != "no"
    return F.when(cls.isNotNull(), F.struct((cls + F.when(hidden, 100).otherwise(0)).alias("cls"), zoom.alias("minz")))


def poi_kind(shop: Column, amenity: Column, cuisine: Column) -> Column:
    """Shop, bar, beer garden, grill by its cuisine, else a tavern."""
    return first_rule(
        (F.coalesce(shop, F.lit("")) != "", "酒屋"), (amenity == "bar", "バー"), (amenity == "biergarten", "ビアガーデン"),
        (cuisine.rlike("yakitori|yakiton|motsu"), "焼き鳥・もつ焼き"), default="居酒屋",
    )


def green_class(leisure: Column, landuse: Column) -> Column:
    """Class of a green area."""
    return first_rule((leisure.isin("park", "garden") | (landuse == "recreation_ground"), PARK), (landuse == "cemetery", CEMETERY), (landuse == "grass", GRASS), default=FOREST)


def rail_class(railway: Column, operator: Column) -> Column:
    """Class of a railway: by its kind, then by the operator's name, goods traffic apart."""
    national = operator.rlike("JR|東日本旅客鉄道|東海旅客鉄道|Japan Railway") & ~operator.contains("貨物")
    return first_rule((railway == "subway", SUBWAY), (railway.isin("light_rail", "monorail", "tram", "narrow_gauge"), LIGHT), (national, RAIL_NATIONAL), default=RAIL)


def place_rank(place: Column) -> Column:
    """struct<minz, rank> of a city, town or suburb, else null."""
    zoom, rank = _of(place, {k: z for k, (z, _) in PLACES.items()}), _of(place, {k: r for k, (_, r) in PLACES.items()})
    return F.when(zoom.isNotNull(), F.struct(zoom.alias("minz"), rank.alias("rank")))


def station_rank(is_hub: Column, operators: Column) -> Column:
    """struct<minz, rank>: hubs, three operators, two, one."""
    entry = lambda z, r: F.struct(F.lit(z).alias("minz"), F.lit(r).alias("rank"))
    return first_rule((is_hub, entry(11, 3)), (operators >= 3, entry(12, 2)), (operators == 2, entry(13, 1)), default=entry(13, 0))


def label_visible(zoom_of: Column, zoom: Column | float) -> Column:
    """A label is drawn from a third of a zoom before its own on."""
    return zoom_of <= F.floor(F.lit(zoom) + 0.35 if not isinstance(zoom, Column) else zoom + 0.35)


def fallback_area(area: Column, nearest: Column, ward: Column, city: str) -> Column:
    """The area, else the nearest station, else the ward, else the city (C04); empty texts count as none."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(area), some(nearest), some(ward), F.lit(city))


def pinned(official: Column, own: Column) -> Column:
    """struct<at, pinned> of an operator's pin, else a listing's (P07); null without either."""
    return first_rule(
        (official.isNotNull(), F.struct(official.alias("at"), F.lit("official").alias("pinned"))),
        (own.isNotNull(), F.struct(own.alias("at"), F.lit("listing").alias("pinned"))),
    )


#: Fixed attributes of map elements that are kept.
KEPT_TAGS = ["amenity", "shop", "highway", "landuse", "place", "building", "name:en", "tourism", "leisure"]


def kept_tags(tags: Column) -> Column:
    """The attributes that matter for a match."""
    return F.map_filter(tags, lambda k, v: k.isin(KEPT_TAGS))


#: Fixed kinds of business that a name may be matched with.
AMENITIES = ["bar", "pub", "restaurant", "izakaya", "biergarten", "cafe", "fast_food", "nightclub", "food_court", "karaoke_box"]
SHOPS = ["alcohol", "wine", "beverages", "butcher", "seafood", "deli", "convenience", "general", "confectionery"]
STAYS = ["hostel", "guest_house", "hotel", "motel"]


def is_business(amenity: Column, shop: Column, tourism: Column) -> Column:
    """Not a clinic, a street or an office of the same name."""
    return F.coalesce(amenity.isin(AMENITIES), F.lit(False)) | F.coalesce(shop.isin(SHOPS), F.lit(False)) | F.coalesce(tourism.isin(STAYS), F.lit(False))


#: Fixed lengths of enrichment texts, and how many of each list are kept.
SHORT, LONG, RULE, DISH, PRICE = 60, 400, 80, 60, 40
RULES, DISHES, LINKS = 8, 6, 4


def is_link(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^https?://\S+$"), F.lit(False))


def enrichment(fields: dict[str, tuple[Column, int]], rules: Column, menu: Column, links: Column, urls: dict[str, Column] | None = None,
               fix: Column | None = None, status: Column | None = None) -> dict[str, Column]:
    """Cleaned enrichment columns (P10): texts within their limits, rules, dishes with a name, whole links, fixes, known states."""
    out = {k: scrub(c, n) for k, (c, n) in fields.items()}
    out["rules"] = F.slice(F.filter(F.transform(rules, lambda r: scrub(r, RULE)), lambda r: r.isNotNull()), 1, RULES)
    dishes = F.transform(menu, lambda m: F.struct(scrub(m["n"], DISH).alias("n"), scrub(m["p"], PRICE).alias("p")))
    out["menu"] = F.slice(F.filter(dishes, lambda m: m["n"].isNotNull()), 1, DISHES)
    out["sources_add"] = F.slice(F.transform(F.filter(links, is_link), lambda u: F.trim(u)), 1, LINKS)
    for k, c in (urls or {}).items():
        out[k] = F.when(is_link(c), F.trim(c))
    if fix is not None:
        out["fix"] = F.map_filter(F.transform_values(fix, lambda _, v: scrub(v, LONG)), lambda _, v: v.isNotNull())
    if status is not None:
        out["status"] = F.when(status.isin("open", "closed", "uncertain"), status)
    return out


def link_map(**urls: Column) -> Column:
    """map<name, url> of the links that are links."""
    every = F.map_from_arrays(F.array(*[F.lit(k) for k in urls]), F.array(*urls.values()))
    return F.map_filter(every, lambda k, v: F.coalesce(v.rlike("^https?://"), F.lit(False)))
