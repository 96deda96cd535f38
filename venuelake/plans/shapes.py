"""Queries on shapes, orders and states across rows, over the driver's tables, each with SQL that gets there another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, geometry, greedy, planar, windows
from .catalog import query
from .views import table

_SQUARES = "SELECT p_type, p_partkey * 7 % 150 AS x, p_partkey * 13 % 110 AS y, 1 + p_size % 9 AS s FROM part"
_CELLS = "SELECT DISTINCT {g} AS g, x + i AS x, y + j AS y FROM q, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(10)) AS j) WHERE i < s AND j < s"


def _covered(group: str) -> str:
    """Area, length of the border, and outer rings less holes of squares, by the unit cells that they cover."""
    return f"""WITH q AS ({_SQUARES}), c AS ({_CELLS.format(g=group)}),
n AS (SELECT c.g, c.x, c.y, (SELECT count(*) FROM c d WHERE d.g = c.g AND abs(d.x - c.x) + abs(d.y - c.y) = 1) AS near FROM c),
k AS (SELECT g, x + i AS x, y + j AS y, count(*) AS n, bool_or(i = j) AS a, bool_or(i <> j) AS b FROM c, (VALUES (0), (1)) t(i), (VALUES (0), (1)) u(j) GROUP BY ALL),
t AS (SELECT g, CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND NOT (a AND b) THEN 2 ELSE 0 END) // 4 AS BIGINT) AS rings FROM k GROUP BY g)
SELECT g, count(*) AS area, CAST(sum(4 - near) AS BIGINT) AS border, t.rings FROM n JOIN t USING (g) GROUP BY g, t.rings"""


def _squares(spark, sf):
    q = table(spark, sf, "part").selectExpr("p_type", "CAST(p_partkey * 7 % 150 AS DOUBLE) AS x", "CAST(p_partkey * 13 % 110 AS DOUBLE) AS y", "CAST(1 + p_size % 9 AS DOUBLE) AS s")
    corner = lambda a, b: F.struct((F.col("x") + a * F.col("s")).alias("x"), (F.col("y") + b * F.col("s")).alias("y"))
    return q.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


def _measured(edges):
    found = planar.ring_areas(planar.rings(edges, ["g"], places=False), ["g"])
    rings = found.groupBy("g").agg(F.sum(F.when(F.col("area") > 0, 1).otherwise(-1)).alias("rings"))
    size = planar.area(edges, ["g"]).select("g", F.round("area").cast("long").alias("area"), F.round("perimeter").cast("long").alias("border"))
    return size.join(rings, "g")


@query(_covered("p_type"))
def dissolve_by_type(spark, sf):
    """Overlapping squares of each type dissolved: area, border, outer rings less holes."""
    q = _squares(spark, sf).select(F.col("p_type").alias("g"), "ring")
    return _measured(planar.stored(planar.dissolved(q, ["g"], "ring", 16), "dissolved"))


@query(_covered("'all'"))
def dissolve_all(spark, sf):
    """All squares as one group, which is dealt to the cells that it covers."""
    q = _squares(spark, sf).select(F.lit("all").alias("g"), "ring")
    return _measured(planar.stored(planar.dissolved(q, ["g"], "ring", 8), "dissolved"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice > 440000 AS spur FROM orders), e AS (SELECT max(k) AS top FROM o),
r AS (SELECT k, coalesce(sum(CASE WHEN spur AND k > 0 THEN 1 ELSE 0 END) OVER (ORDER BY k), 0) AS run FROM o),
m AS (SELECT min(k) AS first, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY run)
SELECT first, first + n AS last, n, 0 AS height FROM m WHERE first > 0 OR NOT (SELECT spur FROM o WHERE k = 0)
UNION ALL SELECT 0, n, n + 1, 1 FROM m WHERE first = 0 AND (SELECT spur FROM o WHERE k = 0)
UNION ALL SELECT k, k, 1, 1 FROM o WHERE spur AND k > 0""")
def line_merge_orders(spark, sf):
    """A street of one piece for each order, in either direction, with side streets where the price is high.

    The street is one line between two side streets, whatever the number of its pieces.
    """
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_totalprice > 440000 AS spur", "o_custkey % 2 = 1 AS back")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    ahead = F.array(at(F.col("k"), 0), at(F.col("k") + 1, 0))
    pieces = o.select(F.lit("street").alias("kind"), F.when(F.col("back"), F.reverse(ahead)).otherwise(ahead).alias("points"))
    sides = o.where("spur").select(F.lit("street").alias("kind"), F.array(at(F.col("k"), 0), at(F.col("k"), 1)).alias("points"))
    parts = chains.merged_lines(pieces.unionByName(sides), ["kind"], "points")
    ends = parts.select("line", F.explode("points").alias("p"))
    box = ends.groupBy("line").agg(F.min("p.x").alias("first"), F.max("p.x").alias("last"), F.max("p.y").alias("height"))
    count = parts.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return box.join(count, "line").select(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n", F.col("height").cast("int").alias("height"))


@query("SELECT CAST(32 * (count(*) // 30 + 2) AS BIGINT) AS area, CAST(0 AS BIGINT) AS unequal, TRUE AS fewer FROM customer")
def shared_borders(spark, sf):
    """Blocks of a city, one for each customer, and a rim around them, dissolved by nation, their borders simplified once for both sides.

    The areas still add up to all blocks, and every edge has one area on each side but those around the rim.
    """
    customers = table(spark, sf, "customer")
    top = customers.agg(F.floor(F.max("c_custkey") / 30) + 1).first()[0]
    c = customers.selectExpr("c_nationkey AS nation", "CAST(c_custkey % 30 AS DOUBLE) AS x", "CAST(floor(c_custkey / 30) AS DOUBLE) AS y")
    sides = spark.range(-1, top + 1).selectExpr("explode(array(-1.0D, 30.0D)) AS x", "CAST(id AS DOUBLE) AS y")
    ends = spark.range(0, 30).selectExpr("CAST(id AS DOUBLE) AS x", f"explode(array(-1.0D, {float(top)}D)) AS y")
    c = c.unionByName(sides.unionByName(ends).select(F.lit(-1).alias("nation"), "x", "y"))
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    blocks = c.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))
    borders = planar.stored(planar.cut_alike(planar.dissolved(blocks, ["nation"], "ring", 16), ["nation"]), "borders")
    thin = planar.stored(planar.simplified_borders(borders, "nation", 0.8), "thin")
    beside = thin.groupBy(F.least(planar.end_point(1), planar.end_point(2)).alias("a"), F.greatest(planar.end_point(1), planar.end_point(2)).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(planar.end_point(1) < planar.end_point(2), 1).otherwise(-1)).alias("balance")
    )
    rim = ((F.col("a.x") == F.col("b.x")) & F.col("a.x").isin(-1.0, 31.0)) | ((F.col("a.y") == F.col("b.y")) & F.col("a.y").isin(-1.0, float(top + 1)))
    unequal = beside.agg(F.count_if(~((F.col("n") == 2) & (F.col("balance") == 0)) & ~rim).alias("unequal"))
    total = thin.agg(F.round(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).cast("long").alias("area"), F.count(F.lit(1)).alias("after"))
    before = borders.agg(F.count(F.lit(1)).alias("before"))
    return total.crossJoin(unequal).crossJoin(before).select("area", "unequal", (F.col("after") < F.col("before")).alias("fewer"))


@query("SELECT c_custkey AS id, CAST(2 * w * (a + b) * 1000 AS BIGINT) AS strip, CAST((a + 2 * 5 - 2 * w) * (b + 2 * 5 - 2 * w) * 1000 AS BIGINT) AS closed FROM (SELECT c_custkey, 20 + c_custkey % 40 AS a, 20 + c_custkey % 17 AS b, 1 + c_custkey % 3 AS w FROM customer)")
def buffers(spark, sf):
    """Strips along L-shaped streets, flat at their ends and mitred at the corner, and rectangles moved out and back in."""
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "CAST(20 + c_custkey % 40 AS DOUBLE) AS wide", "CAST(20 + c_custkey % 17 AS DOUBLE) AS tall", "1 + c_custkey % 3 AS w")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, by, w = F.lit(0), ["wide", "tall", "w"], F.col("w").cast("double")
    # equal streets and rectangles have equal buffers
    shapes = c.select(*by).distinct()
    street = shapes.withColumn("points", F.array(at(zero, zero), at(F.col("wide"), zero), at(F.col("wide"), F.col("tall"))))
    box = shapes.withColumn("points", F.array(at(zero, zero), at(F.col("wide"), zero), at(F.col("wide"), F.col("tall")), at(zero, F.col("tall"))))
    strips = planar.dissolved(planar.line_strips(street, by, "points", w), by, "ring", 64)
    closed = planar.buffered(planar.buffered(planar.dissolved(box, by, "points", 64), by, 5.0, 64), by, w, 64, inwards=True)
    area = lambda e, name: planar.area(e, by).select(*by, F.round(F.col("area") * 1000).cast("long").alias(name))
    return c.join(area(strips, "strip").join(area(closed, "closed"), by), by).select("id", "strip", "closed")


_COAST = "SELECT s_suppkey AS k, 20 + abs(s_acctbal) % 60 AS y FROM supplier"


@query(f"""WITH s AS ({_COAST}), e AS (SELECT max(k) AS top FROM s),
t AS (SELECT sum((a.y + b.y) / 2) AS land FROM s a JOIN s b ON b.k = a.k + 1)
SELECT CAST(round(land + (SELECT count(*) FROM s WHERE k % 10 = 5) * 4.0) AS BIGINT) AS land, CAST(round(top * 120 - land - (SELECT count(*) FROM s WHERE k % 10 = 5) * 4.0) AS BIGINT) AS sea FROM t, e""")
def land_and_sea(spark, sf):
    """A coast from supplier to supplier with the land below, and islands north of it; land and sea fill the box."""
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "20 + abs(s_acctbal) % 60 AS y")
    after = s.selectExpr("k - 1 AS k", "y AS y2")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    # the land is on the left where the coast runs from right to left
    coast = s.join(after, "k").select(F.array(at(F.col("k") + 1, F.col("y2")), at(F.col("k"), F.col("y"))).alias("points"))
    low = lambda d: F.lit(100.0 + d)
    ring = F.array(at(F.col("k"), low(0)), at(F.col("k") + 1, low(0)), at(F.col("k") + 1, low(4)), at(F.col("k"), low(4)), at(F.col("k"), low(0)))
    whole = coast.unionByName(s.where("k % 10 = 5").select(ring.alias("points")))
    top = float(table(spark, sf, "supplier").agg(F.max("s_suppkey")).first()[0])
    size = lambda land, name: planar.coast_areas(whole, "points", (0.0, 0.0, top, 120.0), land).agg(F.round(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).cast("long").alias(name))
    return size(True, "land").crossJoin(size(False, "sea"))


@query("""WITH a AS (SELECT n_nationkey AS id, 14 * (3 + n_nationkey % 5) + 8 AS len FROM nation),
h AS (SELECT c_nationkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, 4 + c_custkey % 3 AS s FROM customer),
f AS (SELECT h.id, n, s FROM h JOIN a USING (id) WHERE n * 14 <= len),
u AS (SELECT a.id, len * 4 + coalesce(sum(s * s), 0) AS area, 2 * (len + 4) + coalesce(sum(2 * s), 0) AS border FROM a LEFT JOIN f USING (id) GROUP BY a.id, len)
SELECT id, CAST(1 AS BIGINT) AS parts, CAST(area + border + 4 AS BIGINT) AS m2 FROM u""")
def alley_outlines(spark, sf):
    """An alley for each nation with the houses of its customers that front it, closed and measured.

    Houses stand side by side along a street of one house every 14 metres; those beyond the end of the alley don't front it.
    """
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n = table(spark, sf, "nation").selectExpr("n_nationkey AS id", "14 * (3 + n_nationkey % 5) + 8 AS len", "n_nationkey * 1000 AS up")
    alleys = n.select("id", F.array(at(F.lit(0), F.col("up")), at(F.col("len"), F.col("up"))).alias("points"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id"), (4 + F.col("c_custkey") % 3).alias("s"), place.alias("n"))
    x, y, s = F.col("n") * 14, F.col("id") * 1000 + 2, F.col("s")
    houses = c.select(F.col("c_custkey").alias("house"), F.array(at(x, y), at(x + s, y), at(x + s, y + s), at(x, y + s)).alias("points"))
    pairs = geometry.fronting_pairs(houses, alleys, "house", ["id"], 2.0, 900.0)
    shapes = houses.join(pairs, "house").select("id", "points")
    found = planar.outlines(alleys, shapes, "id", 4.0, 1000.0, 64_000)
    return found.groupBy("id").agg(F.count_if(F.col("area") > 0).alias("parts"), F.round(F.sum("area")).cast("long").alias("m2"))


@query("""WITH RECURSIVE k AS (SELECT c_custkey AS o, CAST(c_custkey % 97 AS VARCHAR) AS k1, c_mktsegment || CAST(c_custkey % 89 AS VARCHAR) AS k2, CAST(c_nationkey * 40 + c_custkey % 31 AS VARCHAR) AS k3 FROM customer),
r(o, seen, kept) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), FALSE UNION ALL
  SELECT k.o, CASE WHEN list_has_any(seen, [k1, k2, k3]) THEN seen ELSE list_concat(seen, [k1, k2, k3]) END, NOT list_has_any(seen, [k1, k2, k3]) FROM r JOIN k ON k.o = r.o + 1)
SELECT o AS id FROM r WHERE kept""")
def greedy_dedup(spark, sf):
    """All customers in order, each with three keys in one space of keys."""
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "CAST(c_custkey % 97 AS STRING) AS k1", "concat(c_mktsegment, CAST(c_custkey % 89 AS STRING)) AS k2", "CAST(c_nationkey * 40 + c_custkey % 31 AS STRING) AS k3")
    return greedy.greedy_dedup(c, "id", ["k1", "k2", "k3"]).select("id")


_LEDGE = "SELECT c_mktsegment AS name, c_custkey AS o, CAST(c_acctbal AS DOUBLE) % 300 AS x, c_custkey * 37 % 200 AS y, c_nationkey % 2 = 0 AS below FROM customer"


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o) AS k FROM ({_LEDGE})),
r(name, k, xs, ys, os) AS (SELECT DISTINCT name, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]), CAST([] AS BIGINT[]) FROM p UNION ALL
  SELECT r.name, p.k, CASE WHEN near THEN xs ELSE list_append(xs, p.x) END, CASE WHEN near THEN ys ELSE list_append(ys, CAST(p.y AS DOUBLE)) END, CASE WHEN near THEN os ELSE list_append(os, p.o) END
  FROM r JOIN p ON p.name = r.name AND p.k = r.k + 1, LATERAL (SELECT len(list_filter(range(1, len(xs) + 1), lambda i: sqrt(pow(xs[i] - p.x, 2) + pow(ys[i] - p.y, 2)) < 40)) > 0 AS near)),
s AS (SELECT name, xs, ys, os FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1),
m AS (SELECT p.*, os[list_min(list_filter(range(1, len(xs) + 1), lambda i: sqrt(pow(xs[i] - p.x, 2) + pow(ys[i] - p.y, 2)) < 40))] AS cluster FROM p JOIN s USING (name))
SELECT name, cluster, count(*) AS n, CAST(round(coalesce(avg(x) FILTER (NOT below), avg(x)) * 1000) AS BIGINT) AS cx, CAST(round(coalesce(avg(y) FILTER (NOT below), avg(y)) * 1000) AS BIGINT) AS cy FROM m GROUP BY ALL""")
def greedy_clusters(spark, sf):
    """Customers of a segment in order, each with the first cluster that is near."""
    c = table(spark, sf, "customer").selectExpr("c_mktsegment AS name", "c_custkey AS o", "CAST(c_acctbal AS DOUBLE) % 300 AS x", "c_custkey * 37 % 200 AS y", "c_nationkey % 2 = 0 AS below")
    found = greedy.cluster_centres(c, "name", "o", "x", "y", 40.0, "below")
    return found.select("name", "cluster", "n", F.round(F.col("cx") * 1000).cast("long").alias("cx"), F.round(F.col("cy") * 1000).cast("long").alias("cy"))


@query("SELECT count(*) AS n, list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50, list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.9) AS INT) + 1] AS p90, list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.99) AS INT) + 1] AS p99 FROM lineitem")
def percentiles_of_all(spark, sf):
    """Exact percentiles of all lines as one group, by counting ranges."""
    return windows.selected_percentile(table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.9, 0.99])


@query("SELECT l_shipmode AS k, n, p50 FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n, list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50 FROM lineitem GROUP BY 1)")
def percentiles_by_group(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), "l_extendedprice")
    return windows.selected_percentile(lines, "l_extendedprice", [0.5], "k")


@query("WITH r AS (SELECT ts, max(event_id) AS key_id FROM events WHERE event_type <> 'click' GROUP BY ts) SELECT l.event_id, r.key_id FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN r ON l.ts >= r.ts")
def asof_one_key(spark, sf):
    """All events under one key: the scan is cut into parts of it."""
    e = table(spark, sf, "events").select(F.lit("all").alias("k"), "ts", "event_id", "event_type")
    left = e.where("event_type = 'click'").select("k", "ts", "event_id")
    right = e.where("event_type <> 'click'").select("k", "ts", F.col("event_id").alias("key_id"))
    return windows.as_of_segmented(left, right, "k", "ts", ["key_id"], "key_id", 16).select("event_id", "key_id")


@query("WITH g AS (SELECT event_id, value, sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS run FROM events) SELECT CAST(run AS BIGINT) AS run, count(*) AS n, min(event_id) AS first_id FROM g WHERE value >= 20 GROUP BY run")
def gap_runs_one_key(spark, sf):
    """Runs between gaps with all events under one key."""
    e = table(spark, sf, "events").select(F.lit("all").alias("k"), "event_id", "ts", F.when(F.col("value") >= 20, F.col("value")).alias("v"))
    found = windows.null_gap_runs_segmented(e, "k", ["ts", "event_id"], "v", 16)
    return found.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
