"""Queries of projections, merges, rules and labels over the rows of the driver's tables, each with SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, hours, names, rules, text
from ..operators import geometry, merge, resolve, spatial, tiles
from ..session import ship_package
from ..sources import files, sinks
from ..stored import new_folder, stored
from . import research
from .catalog import query
from .views import VENUES_SQL, table, venues

_LIST = "array_to_string({}, '|')"


@query(f"""SELECT source || '-' || doc_id AS id, source AS name, 'bar' AS kind, CASE WHEN lang = 'en' THEN 'open' ELSE 'uncertain' END AS status,
CAST(CASE WHEN doc_id % 5 = 0 THEN 3 ELSE least(5, greatest(1, n_chars % 9)) END AS INT) AS social, CAST(CASE WHEN doc_id % 3 = 0 THEN n_chars END AS INT) AS budget_min, lang = 'fr' AS hiru, doc_id % 2 = 0 AS english,
{_LIST.format("string_split(coalesce(text, ''), ' ')[1:12]")} AS tags, 'https://' || source || '|http://x/' || doc_id AS sources, CASE WHEN lang = 'de' THEN 'a|de' ELSE 'a|' || lang END AS members,
CASE WHEN doc_id % 2 = 1 THEN 1.5 ELSE CAST(doc_id AS DOUBLE) END AS lat, CASE WHEN doc_id % 2 = 1 THEN 'official' ELSE 'listing' END AS pinned FROM documents""")
def venue_projection(spark, sf):
    """Raw rows to the columns of a venue: ids, texts, ratings, numbers, flags, lists and pins."""
    raw = table(spark, sf, "documents").selectExpr(
        "concat(' ', upper(source), '_', doc_id, '! ') AS id", "concat('　', source, ' ') AS name", "lang AS kind", "if(lang = 'en', 'open', lang) AS status",
        "if(doc_id % 5 = 0, 'x', CAST(n_chars % 9 AS STRING)) AS social", "if(doc_id % 3 = 0, CAST(n_chars AS STRING), source) AS budget_min", "lang = 'fr' AS hiru",
        "if(doc_id % 2 = 0, 'menu', '  ') AS english", "split(coalesce(text, ''), ' ') AS tags", "array(source, concat('https://', source), null, concat('http://x/', doc_id)) AS sources",
        "array(' a ', '', lang) AS members", "array(CAST(doc_id AS DOUBLE), 0D) AS pin", "if(doc_id % 2 = 1, array(1.5D, 2.5D), null) AS official_pin",
    )
    made = research.projected(raw)
    joined = {c: F.array_join(c, "|") for c in ("tags", "sources", "members")}
    return made.withColumns(joined).select("id", "name", "kind", "status", "social", "budget_min", "hiru", "english", "tags", "sources", "members", "lat", "pinned")


@query("""WITH a AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '不明' WHEN 'O' THEN o_orderpriority END AS pay, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS seats, nullif(o_totalprice, 0) AS score FROM orders),
b AS (SELECT s_suppkey AS id, s_name AS pay, CAST(s_nationkey AS BIGINT) AS seats, CASE WHEN s_acctbal > 0 THEN 'fee' ELSE '' END AS charge FROM supplier),
e AS (SELECT n_nationkey AS id, n_name AS charge, CASE WHEN n_regionkey > 0 THEN n_name ELSE '' END AS catch FROM nation)
SELECT c_custkey AS id, coalesce(CASE WHEN a.pay <> '不明' THEN a.pay END, b.pay, nullif(c_mktsegment, 'BUILDING')) AS pay,
CASE WHEN a.pay <> '不明' THEN '食べログ' WHEN b.pay IS NOT NULL THEN 'ホットペッパー' WHEN c_mktsegment <> 'BUILDING' THEN '調査' END AS pay_source,
coalesce(a.seats, b.seats) AS seats, coalesce(nullif(b.charge, ''), e.charge) AS charge, CASE WHEN b.charge <> '' THEN 'ホットペッパー' WHEN e.charge IS NOT NULL THEN '口コミ' END AS charge_source,
nullif(e.catch, '') AS catch, a.score FROM customer LEFT JOIN a ON a.id = c_custkey LEFT JOIN b ON b.id = c_custkey LEFT JOIN e ON e.id = c_custkey""")
def facts_of_sources(spark, sf):
    """Research, two listings and reviews of every customer in one row, with the source of each fact."""
    own = table(spark, sf, "customer").selectExpr("c_custkey AS id", "if(c_mktsegment = 'BUILDING', '－', c_mktsegment) AS payment", "'bar' AS kind")
    a = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN '不明' WHEN 'O' THEN o_orderpriority END AS pay", "if(o_orderkey % 3 > 0, o_custkey, null) AS seats", "o_totalprice AS score")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS pay", "CAST(s_nationkey AS BIGINT) AS seats", "if(s_acctbal > 0, 'fee', '') AS charge")
    e = table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS charge", "if(n_regionkey > 0, n_name, '') AS catch").withColumn("id", F.col("id").cast("long"))
    info = research.merged_info(own, a, b, e)
    src = lambda k: F.try_element_at("src", F.lit(k))
    return info.select("id", "pay", src("pay").alias("pay_source"), "seats", "charge", src("charge").alias("charge_source"), "catch", "score")


_STOP = ", ".join(f"'{w}'" for w in [*names.STOP, "bar"])


@query(f"""WITH w AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS whole, string_split(p_name, ' ') AS w FROM part),
c AS (SELECT id, whole AS core, 0 AS pos FROM w UNION ALL SELECT id, unnest(w), unnest(range(1, len(w) + 1)) FROM w UNION ALL SELECT id, replace(whole, 'bar', ''), 99 FROM w),
d AS (SELECT id, core, min(pos) AS pos FROM c WHERE length(core) >= 4 AND core NOT IN ({_STOP}) GROUP BY id, core)
SELECT id, string_agg(core, ',' ORDER BY length(core) DESC, pos) AS cores FROM d GROUP BY id""")
def cores_of_parts(spark, sf):
    """What of a part's name tells it apart (ST07, ST08)."""
    ship_package(spark)
    none = F.array().cast("array<string>")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    # parts of one name have the same cores; written, else the filter on cores would be asked of every part
    found = stored(spatial.spread(parts.select("p_name").distinct()), "names").select("p_name", F.array_join(names.name_cores("p_name", none, none), ",").alias("cores"))
    return parts.join(found.where("cores != ''"), "p_name").select("id", "cores")


@query("""SELECT o_orderkey AS id, substr(regexp_replace('注文' || o_orderpriority || '（税込）' || o_orderstatus, '（.*?）', '', 'g'), 1, 16) AS label,
CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '年' || month(o_orderdate) || '月開店' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS opened,
CASE WHEN o_custkey % 1800 >= 1440 THEN '翌' ELSE '' END || (o_custkey % 1800 % 1440 // 60) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS clock FROM orders""")
def labels_of_orders(spark, sf):
    """Short labels, opening dates, clocks (P15, D19, ST27)."""
    o = table(spark, sf, "orders")
    label = F.concat(F.lit("注文"), "o_orderpriority", F.lit("（税込）"), "o_orderstatus")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(".", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))).otherwise(F.year("o_orderdate").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), text.short_label(label).alias("label"), text.opening_text(date).alias("opened"), hours.clock(F.col("o_custkey") % 1800).alias("clock"))


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING=' || c_nationkey || ';x=2' WHEN c_mktsegment < 'BUILDING' THEN c_mktsegment || '=' || c_nationkey || ';BUILDING=1;x=2' ELSE 'BUILDING=1;' || c_mktsegment || '=' || c_nationkey || ';x=2' END AS filled,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING=' || c_nationkey || ',1;x=2' WHEN c_mktsegment < 'BUILDING' THEN c_mktsegment || '=' || c_nationkey || ';BUILDING=1;x=2' ELSE 'BUILDING=1;' || c_mktsegment || '=' || c_nationkey || ';x=2' END AS extended, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS kept FROM customer""")
def maps_of_customers(spark, sf):
    """Defaults for maps, lists of two maps one behind the other, attributes that are kept."""
    c = table(spark, sf, "customer")
    own = F.create_map("c_mktsegment", F.array("c_nationkey"))
    other = F.create_map(F.lit("BUILDING"), F.array(F.lit(1)), F.lit("x"), F.array(F.lit(2)))
    # in the order of the keys
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), ";")
    tags = F.create_map(F.when(F.col("c_custkey") % 2 == 0, "shop").otherwise("name"), "c_name")
    return c.select(F.col("c_custkey").alias("id"), listed(merge.map_defaults(own, other)).alias("filled"), listed(merge.map_extended(own, other)).alias("extended"), F.size(rules.kept_tags(tags)).alias("kept"))


_WAYS = "SELECT p_partkey AS id, p_partkey * 7 % 1000 AS x, p_partkey * 13 % 900 AS y, p_size AS s, p_partkey % 4 AS k FROM part"


@query(f"""WITH w AS ({_WAYS}) SELECT id, CAST(floor((x + s / 2.0) / 100) AS BIGINT) AS tx, CAST(floor((y + s / 2.0) / 100) AS BIGINT) AS ty, floor((x + s / 2.0) / 100) * 100 - 25.0 AS x0, floor((y + s / 2.0) / 100) * 100 + 125.0 AS y1,
CAST(CASE WHEN k = 3 THEN NULL ELSE 4 END AS INT) AS corners, CASE WHEN k < 3 THEN s * s >= 40 END AS large, CASE k WHEN 0 THEN 'building' WHEN 1 THEN 'way' WHEN 2 THEN 'area' ELSE 'poi' END AS kind FROM w""")
def ways_to_tiles(spark, sf):
    """Closed and open ways, their least areas, classes and tiles."""
    w = table(spark, sf, "part").selectExpr("p_partkey AS id", "CAST(p_partkey * 7 % 1000 AS DOUBLE) AS x", "CAST(p_partkey * 13 % 900 AS DOUBLE) AS y", "CAST(p_size AS DOUBLE) AS s", "p_partkey % 4 AS k")
    at = lambda a, b: F.struct((F.col("x") + a * F.col("s")).alias("x"), (F.col("y") + b * F.col("s")).alias("y"))
    closed = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))
    w = w.withColumn("points", F.when(F.col("k") == 3, F.array(at(0, 0), at(1, 1))).otherwise(closed))
    tags = F.when(F.col("k") == 0, F.create_map(F.lit("building"), F.lit("yes"))).when(F.col("k") == 1, F.create_map(F.lit("highway"), F.lit("path"))).when(F.col("k") == 2, F.create_map(F.lit("landuse"), F.lit("retail"))).otherwise(F.create_map(F.lit("amenity"), F.lit("bar")))
    ring = geometry.way_ring(F.col("points"))
    placed = tiles.assigned(w.withColumn("line", geometry.way_line(F.col("points"))), "line", 100)
    return placed.select(
        "id", "tx", "ty", F.col("x0").cast("double").alias("x0"), F.col("y1").cast("double").alias("y1"), F.when(ring.isNotNull(), F.size(ring)).alias("corners"),
        F.when(ring.isNotNull(), geometry.large_enough(ring)).alias("large"), geometry.element_class(F.when(F.col("k") == 3, "node").otherwise("way"), tags).alias("kind"),
    )


@query("""WITH t AS (SELECT o_orderkey, p_partkey * 7 % 1000 // 200 AS tx, p_partkey * 13 % 900 // 200 AS ty, p_brand, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderkey % 10 = 0),
f AS (SELECT tx, ty, string_agg(p_brand, ',' ORDER BY l_linenumber, o_orderkey, p_brand) AS f FROM t WHERE l_linenumber <= 4 GROUP BY ALL),
l AS (SELECT tx, ty, string_agg(p_brand, ',' ORDER BY o_orderkey, p_brand) AS l FROM t WHERE l_linenumber = 5 GROUP BY ALL), p AS (SELECT tx, ty, string_agg(p_brand, ',' ORDER BY o_orderkey, p_brand) AS p FROM t WHERE l_linenumber > 5 GROUP BY ALL)
SELECT tx, ty, tx * 200 AS ox, f, l, p FROM f FULL JOIN l USING (tx, ty) FULL JOIN p USING (tx, ty)""")
def tile_parts(spark, sf):
    """Features by class, labels and places of each tile."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").where("o_orderkey % 10 = 0"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = lines.selectExpr("floor(p_partkey * 7 % 1000 / 200) AS tx", "floor(p_partkey * 13 % 900 / 200) AS ty", "l_linenumber AS cls", "o_orderkey AS ord", "p_brand AS feature", "p_brand AS item")
    made = tiles.tile_contents(t.where("cls <= 4"), t.where("cls = 5"), t.where("cls > 5"), 200)
    return made.select("tx", "ty", "ox", *[F.array_join(c, ",").alias(c) for c in "flp"])


@query("""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'motorway_link' WHEN 1 THEN 'footway' WHEN 2 THEN 'steps' WHEN 3 THEN 'raceway' ELSE 'motorway' END AS way, p_size AS z FROM part)
SELECT id, CAST(CASE way WHEN 'motorway_link' THEN 20 WHEN 'motorway' THEN 20 WHEN 'footway' THEN 28 WHEN 'steps' THEN 29 END AS INT) + CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END AS road,
CAST(CASE WHEN id % 4 = 0 THEN 2 WHEN id % 4 = 1 THEN 4 WHEN id % 4 = 2 THEN 5 ELSE 3 END AS INT) AS green, CAST(CASE WHEN id % 4 = 0 THEN 42 WHEN id % 4 = 1 THEN 43 WHEN id % 4 = 2 THEN 40 ELSE 41 END AS INT) AS rail,
CAST(CASE WHEN id % 7 = 0 THEN 11 WHEN z >= 3 THEN 12 WHEN z = 2 THEN 13 ELSE 13 END AS INT) AS station, CAST(CASE id % 4 WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 12 END AS INT) AS place,
CASE id % 4 WHEN 0 THEN 10 <= floor(z / 4.0 + 0.35) WHEN 1 THEN 11 <= floor(z / 4.0 + 0.35) WHEN 2 THEN 12 <= floor(z / 4.0 + 0.35) END AS shown,
CASE WHEN id % 3 = 0 THEN 'A' || z WHEN id % 3 = 1 THEN 'S' || z WHEN id % 2 = 0 THEN 'W' ELSE '東京' END AS area FROM c""")
def classes_of_parts(spark, sf):
    """Roads, greens, railways, stations, places and when they are labelled, and areas to fall back on."""
    p = table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("id") % n).cast("int"))
    road = rules.road_class(pick(5, "motorway_link", "footway", "steps", "raceway", "motorway"), F.when(F.col("id") % 3 == 0, "yes"))
    rail = pick(4, "subway", "tram", "rail", "rail")
    place = rules.place_rank(pick(4, "city", "town", "suburb", "quarter"))
    area = rules.fallback_area(F.when(F.col("id") % 3 == 0, F.concat(F.lit("A"), "p_size")).otherwise(""), F.when(F.col("id") % 3 == 1, F.concat(F.lit("S"), "p_size")), F.when(F.col("id") % 2 == 0, "W"), "東京")
    return p.select(
        "id", road["cls"].alias("road"), rules.green_class(pick(4, "park", "x", "x", "x"), pick(4, "x", "cemetery", "grass", "wood")).alias("green"),
        rules.rail_class(rail, pick(4, "x", "x", "JR東日本", "JR貨物")).alias("rail"), rules.station_rank(F.col("id") % 7 == 0, F.col("p_size"))["minz"].alias("station"),
        place["minz"].alias("place"), F.when(place.isNotNull(), rules.label_visible(place["minz"], F.col("p_size") / 4)).alias("shown"), area.alias("area"),
    )


@query("""SELECT l_orderkey AS id, string_agg(CAST(s_suppkey * 10 AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0 GROUP BY 1""")
def ids_of_labels(spark, sf):
    """The suppliers of an order as labels, and their ids in the order of the lines; unknown labels are left out."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: F.concat(F.lit("S"), s["l_suppkey"])).alias("labels"))
    known = table(spark, sf, "supplier").where("s_acctbal >= 0").selectExpr("concat('S', s_suppkey) AS label", "s_suppkey AS sid")
    asked = lines.select(F.col("id").alias("order"), F.explode(F.array_distinct("labels")).alias("label")).join(known, "label").select("order", "label", (F.col("sid") * 10).cast("string").alias("id"))
    found = resolve.labelled_ids(lines.withColumnRenamed("id", "order"), "order", "labels", asked)
    return found.select(F.col("order").alias("id"), F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {VENUES_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN id % 4 = 0 THEN NULL ELSE lng END AS lng, CASE id % 4 WHEN 1 THEN '号' WHEN 2 THEN '丁目' WHEN 3 THEN '町' END AS level FROM venues""")
def stored_answers(spark, sf):
    """Stored answers of a geocoder: the first hit's place, and how exact its title is."""
    title = F.when(F.col("id") % 4 == 1, "北区赤羽一丁目２番３号").when(F.col("id") % 4 == 2, "北区赤羽一丁目").otherwise("北区赤羽")
    hit = F.struct(F.struct(F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.struct(title.alias("title")).alias("properties"))
    none = F.array().cast("array<struct<geometry:struct<coordinates:array<double>>,properties:struct<title:string>>>")
    body = F.to_json(F.when(F.col("id") % 4 == 0, none).otherwise(F.array(hit, hit)))
    return files.geocoded(venues(spark, sf).select("id", body.alias("body")), "id", "body").select("id", "lat", "lng", "level")


@query("SELECT c_custkey AS id, '{\"id\":' || c_custkey || CASE WHEN c_custkey % 3 > 0 THEN ',\"name\":\"' || c_name || '\"' ELSE '' END || CASE WHEN c_nationkey > 9 THEN ',\"nation\":' || c_nationkey ELSE '' END || '}' AS record FROM customer")
def records_written(spark, sf):
    """The sparse record of each row, written and read back."""
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "if(c_custkey % 3 > 0, c_name, null) AS name", "if(c_nationkey > 9, c_nationkey, null) AS nation")
    folder = new_folder(spark, "records")
    sinks.write_records(c, folder, "id")
    return spark.read.parquet(folder)


@query(f"""WITH {VENUES_SQL} SELECT CAST(floor(round_even(avg(lat), 6) * 1e4 + 0.6649) AS BIGINT) AS la, CAST(floor(round_even(avg(lng), 6) * 1e4 + 0.6649) AS BIGINT) AS lo FROM venues GROUP BY floor(lat / 0.035), floor(lng / 0.035)""")
def centres_of_cells(spark, sf):
    """The mean place of each cell that has venues (K08), cut where no mean of some venues lies."""
    c = sinks.centres(venues(spark, sf), F.col("lat"), F.col("lng"), 0.035)
    return c.select(F.floor(F.col("lat") * 1e4 + 0.6649).alias("la"), F.floor(F.col("lng") * 1e4 + 0.6649).alias("lo"))


@query("SELECT p_type, p_size >= 13 AS detail, count(*) AS n FROM part GROUP BY ALL")
def two_basemaps(spark, sf):
    """Features of the whole area, and those that are seen from near only."""
    p = table(spark, sf, "part").selectExpr("p_type", "p_partkey AS cls", "p_size AS zoom")
    low, high = sinks.by_resolution(p, "zoom")
    both = low.withColumn("detail", F.lit(False)).unionByName(high.withColumn("detail", F.lit(True)))
    return both.groupBy("p_type", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, CAST(round(10 * u * 1000) AS BIGINT) AS straight, CAST(round(CASE WHEN u < 0.5 THEN 4 * u * u * u ELSE 1 - pow(2 - 2 * u, 3) / 2 END * 1000) AS BIGINT) AS eased, CAST(round((1 - pow(1 - u, 3)) * 1000) AS BIGINT) AS out FROM (SELECT event_id, event_id % 16 / 16.0 AS u FROM events)")
def steps_of_events(spark, sf):
    """Straight and cubic steps."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 16 / 16.0).alias("u"))
    long = lambda c: F.round(c * 1000).cast("long")
    u = F.col("u")
    return e.select("id", long(geo.lerp(F.lit(0.0), F.lit(10.0), u)).alias("straight"), long(geo.ease(u)).alias("eased"), long(geo.ease_out(u)).alias("out"))


@query("SELECT c_custkey AS id, (c_custkey % 14 + 8) * 60 AS opens, CASE WHEN c_custkey % 5 > 2 THEN 1740 WHEN c_custkey % 3 < c_custkey % 14 + 8 THEN c_custkey % 3 * 60 + 1440 ELSE c_custkey % 3 * 60 END AS closes, c_custkey % 24 * 60 + 30 AS half FROM customer")
def clocks_of_customers(spark, sf):
    """Japanese and twelve-hour clocks read from texts."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    opens, last = F.concat(F.col("id") % 14 + 8, F.lit("時")), F.when(F.col("id") % 5 > 2, "始発").otherwise(F.concat(F.col("id") % 3, F.lit(":00")))
    h = F.col("id") % 24
    twelve = F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":30 "), F.when(h >= 12, "PM").otherwise("AM"))
    o = hours.clock_ja(opens)
    return c.select("id", o.cast("long").alias("opens"), hours.clock_ja(last, o).cast("long").alias("closes"), hours.clock12(twelve).cast("long").alias("half"))


@query("""SELECT n_nationkey AS id, CASE WHEN length(regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')) >= 4 THEN regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') END AS romaji,
n_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '駅前' END AS station, CASE WHEN n_regionkey = 0 THEN 'AREA' ELSE n_name END AS area, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|北区|新橋|港区|赤羽' ELSE n_name || '|新橋|港区|赤羽' END AS words FROM nation""")
def places_of_nations(spark, sf):
    """Names in Latin letters, stations, areas, place words (ST09, ST11, ST14, ST20)."""
    ship_package(spark)
    n = table(spark, sf, "nation")
    africa = [r.n_name for r in n.where("n_regionkey = 0").collect()]  # the aliases of a plan are a fixed table
    station = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit("（JR）駅")).otherwise(F.lit("駅前")))
    ward = F.when(F.col("n_nationkey") % 2 == 0, "北区")
    words = names.place_words(F.col("n_name"), F.lit(""), ward, F.lit("JR新橋駅・A"), F.lit("東京都港区赤羽三丁目２-1"))
    area = names.canon_area(F.concat("n_name", F.lit("（東口）")), {a: "AREA" for a in africa})
    return n.select(F.col("n_nationkey").alias("id"), names.romaji_places(F.concat("n_name", F.lit(" Station"))).alias("romaji"), names.station_name(station).alias("station"), area.alias("area"), F.array_join(words, "|").alias("words"))


# --- files, marks and tags --------------------------------------------------------------------------------------


@query("""SELECT n_nationkey AS id, n_name AS name, r_name AS region, 'nations' AS stem, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS place FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 4""")
def nations_from_files(spark, sf):
    """A file with an array for each region, read together: rows keep their place, a private file is left out, its region is looked up."""
    folder = new_folder(spark, "arrays")
    n = table(spark, sf, "nation")
    rows = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))), lambda r: r))
    for r in table(spark, sf, "region").collect():  # a file is named by its region
        own = n.where(F.col("n_regionkey") == r.r_regionkey).agg(rows.alias("value"))
        name = "_hidden" if r.r_regionkey == 4 else f"nations{r.r_regionkey}"
        own.coalesce(1).write.text(f"{folder}/{name}")
    found = None
    for r in table(spark, sf, "region").collect():
        path = f"{folder}/nations{r.r_regionkey}"
        if r.r_regionkey != 4:
            one = files.json_rows(spark, path, "id int, name string").select("id", "name", F.lit(f"nations{r.r_regionkey}").alias("stem"), F.col("ord.pos").alias("place"))
            found = one if found is None else found.unionByName(one)
    lookup = {f"nations{r.r_regionkey}": r.r_name for r in table(spark, sf, "region").collect()}
    return found.select("id", "name", files.stem_lookup(F.col("stem"), lookup, "?").alias("region"), F.lit("nations").alias("stem"), "place")


@query("""SELECT s_suppkey AS id, s_name AS name, 'array' AS kind FROM supplier WHERE s_nationkey >= 12 UNION ALL SELECT s_suppkey, s_name, 'map' FROM supplier WHERE s_nationkey < 12 UNION ALL SELECT -1, 'one', 'optional'""")
def records_of_any_shape(spark, sf):
    """Arrays of records, records in a map by id, one optional object, and a file that is not there."""
    folder = new_folder(spark, "shapes")
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.struct(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("r"), "s_nationkey")
    s.where("s_nationkey >= 12").agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.text(f"{folder}/array")
    s.where("s_nationkey < 12").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "r")))).alias("value")).coalesce(1).write.text(f"{folder}/map")
    spark.range(1).select(F.lit('{"id": "s-1", "name": "one"}').alias("value")).coalesce(1).write.text(f"{folder}/optional")
    name = F.try_variant_get("record", "$.name", "string").alias("name")
    array = files.json_any(spark, f"{folder}/array", "id", text.slug).select("id", name, F.lit("array").alias("kind"))
    keyed = files.json_map(spark, f"{folder}/map").select("id", name, F.lit("map").alias("kind"))
    one = files.optional_json(spark, f"{folder}/optional", "id string, name string").withColumn("kind", F.lit("optional"))
    none = files.optional_json(spark, f"{folder}/missing", "id string, name string").withColumn("kind", F.lit("missing"))
    return array.unionByName(keyed).unionByName(one).unionByName(none).select(F.substring("id", 2, 20).cast("long").alias("id"), "name", "kind")


@query("""SELECT o_orderkey AS id, CASE WHEN c_acctbal >= 0 THEN c_name END AS answer, c_custkey IS NULL AS pending FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'""")
def answers_and_pending(spark, sf):
    """Lookups that a stored cache answers, empty answers too, and those that are pending, through a log of tab-separated values."""
    folder = new_folder(spark, "cache")
    files.write_tsv(table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("answer")), folder)
    cache = files.tsv(spark, folder, "key long, answer string")
    done, pending = files.cached_lookup(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key")), cache, "key")
    return done.select("id", "answer", F.lit(False).alias("pending")).unionByName(pending.select("id", F.lit(None).cast("string").alias("answer"), F.lit(True).alias("pending")))


@query("""SELECT page_id AS id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id END AS original, page_id % 30 < 24 AS stale, page_id % 3 = 0 AS loose FROM pages""")
def marks_of_pages(spark, sf):
    """Escaped links, originals of translated notes, stale notes, names with gaps (ST23, ST16, F17, ST10)."""
    k = F.col("page_id")
    note = F.when(k % 2 == 0, F.concat(F.lit("Original text page "), k, F.lit(" Translated seite"))).otherwise("nothing")
    said = F.concat(F.lit("2019年と"), k % 30 + 2000, F.lit("年の記事"))
    stale = text.stale_note(F.concat(k % 30 + 2000, F.lit("年の記事")), 2024)
    gaps = F.when(k % 3 == 0, "山・田 屋").otherwise("山と田屋")
    return table(spark, sf, "pages").select(k.alias("id"), text.escape_html(F.col("url")).alias("escaped"), names.original_text(note).alias("original"), (stale & said.isNotNull()).alias("stale"), gaps.rlike(names.loose("山田屋")).alias("loose"))


@query("""SELECT s_suppkey AS id, '03-' || (1000 + s_suppkey % 9000) || '-5678' AS phone, CASE WHEN s_suppkey % 2 = 0 THEN 3.0 + s_suppkey % 10 / 10.0 END AS rating, 'https://shop' || s_suppkey || '.example' AS web FROM supplier""")
def contacts_of_suppliers(spark, sf):
    """Phone, rating and the first link that leads elsewhere (ST19)."""
    k = F.col("s_suppkey")
    rating = F.when(k % 2 == 0, F.concat(F.lit("rating: 3."), k % 10)).otherwise("")
    page = F.concat(rating, F.lit(" tel 03-"), k % 9000 + 1000, F.lit('-5678 <a href="https://own.example/x"><a href="https://shop'), k, F.lit('.example"><a href="https://last.example">'))
    c = names.contact(page, "own.example")
    return table(spark, sf, "supplier").select(k.alias("id"), c["phone"].alias("phone"), F.round(c["rating"], 1).alias("rating"), c["web"].alias("web"))


@query("""SELECT p_partkey AS id, p_partkey % 6 = 0 AS tunnel, p_partkey % 6 IN (1, 2) AS station, p_partkey % 6 = 3 OR p_partkey % 7 = 0 AS business, p_partkey % 6 = 4 AND p_size > 25 AS both FROM part""")
def tags_of_parts(spark, sf):
    """Tunnels, stations, businesses and combined conditions by tags."""
    from ..sources import elements

    k = F.col("p_partkey")
    pick = lambda *maps: F.get(F.array(*[F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in maps]), (k % 6).cast("int"))
    tags = pick({"tunnel": "covered"}, {"railway": "halt"}, {"train": "yes", "tunnel": "no"}, {"shop": "wine"}, {"name": "x", "level": "3"}, {"railway": "station", "building": "yes"})
    sized = F.map_concat(tags, F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    both = elements.tagged(sized, {"name": ["x", "y"]}, {"size": "^(2[6-9]|[3-9][0-9])$"}, present=("level",), absent=("railway",))
    return table(spark, sf, "part").select(k.alias("id"), elements.is_tunnel(tags).alias("tunnel"), elements.is_station(tags, F.lit("A")).alias("station"), elements.is_business(tags, k % 7 == 0).alias("business"), both.alias("both"))


@query(f"""WITH {VENUES_SQL}, d AS (SELECT id, id * 13 % 900 AS m, CASE id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'block' WHEN 2 THEN 'town' END AS level, id % 5 = 0 AS is_area FROM venues),
g AS (SELECT *, CASE WHEN is_area THEN 700 WHEN level = 'number' THEN 150 WHEN level = 'block' THEN 300 ELSE 700 END AS gate FROM d)
SELECT id, CAST(greatest(1, floor(m / 80.0 + 0.5)) AS BIGINT) AS walk, CAST(gate AS BIGINT) AS gate, m <= gate AS within,
concat_ws('; ', CASE WHEN NOT is_area AND m > 100 AND m <= gate THEN 'match ' || m || 'm from address' END, CASE WHEN m > gate THEN 'match too far' END, CASE WHEN id % 3 = 0 THEN 'pin 121m' END, CASE WHEN level = 'town' THEN 'address only to town' END) AS reasons FROM g""")
def reviews_of_positions(spark, sf):
    """Walking minutes, the gate of a match by the level of its address or for an area, and what a person should look at."""
    k = F.col("id")
    level = F.when(k % 4 == 0, "number").when(k % 4 == 1, "block").when(k % 4 == 2, "town")
    m, is_area = (k * 13 % 900).cast("double"), k % 5 == 0
    gate = resolve.gate(level, is_area)
    reasons = rules.review_reasons(F.lit(1), m, gate, F.when(k % 3 == 0, 121.0), level, is_area)
    return venues(spark, sf).select("id", geo.walk_minutes(m).cast("long").alias("walk"), gate.cast("long").alias("gate"), (m <= gate).alias("within"), F.array_join(reasons, "; ").alias("reasons"))


@query("""WITH c AS (SELECT 'name' AS field, count(c_name) AS n FROM customer UNION ALL SELECT 'budget', count(*) FILTER (c_acctbal >= 0) FROM customer UNION ALL SELECT 'segment', count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) FROM customer)
SELECT field, n, row_number() OVER (ORDER BY n DESC, field) AS place FROM c""")
def statistics_in_order(spark, sf):
    """How many rows know each field, the most known first."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("budget"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).alias("segment"))
    return merge.coverage_in_order(c, ["name", "budget", "segment"])


@query(f"""WITH {VENUES_SQL}, v AS (SELECT 'outside' AS rule, 'error' AS severity, NOT (lat > 3.551e1 AND lat < 3.58e1) AS hit FROM venues UNION ALL SELECT 'no budget', 'note', budget_max IS NULL FROM venues)
SELECT severity, count(*) AS n, CAST((SELECT count(*) FROM v WHERE hit AND severity = 'error') AS BIGINT) AS serious FROM v WHERE hit GROUP BY severity""")
def outcomes_of_rules(spark, sf):
    """Breaches by severity, and how many there are that should fail a run."""
    from ..operators import quality

    found = quality.violations(venues(spark, sf), "id", [("outside", "error", ~((F.col("lat") > 35.51) & (F.col("lat") < 35.8))), ("no budget", "note", F.col("budget_max").isNull())])
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn("serious", F.lit(quality.serious(found)).cast("long"))


@query(f"WITH {VENUES_SQL} SELECT id FROM venues WHERE CASE WHEN id % 3 = 0 THEN NULL ELSE social >= 3 END")
def flagged_venues(spark, sf):
    """A flag that may be unknown counts as false."""
    from .query import VenueQuery

    v = venues(spark, sf).withColumn("f", F.when(F.col("id") % 3 != 0, F.col("social") >= 3))
    return VenueQuery(v).flag("f").df.select("id")
