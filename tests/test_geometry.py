import random

from pyspark.sql import functions as F

from venuelake.functions import rules
from venuelake.operators import geometry as g
from venuelake.operators import spatial

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def test_clip():
    assert sorted(g.clip_ring(SQUARE, 5, 5, 20, 20)) == [(5, 5), (5, 10), (10, 5), (10, 10)]
    assert g.clip_ring(SQUARE, 20, 20, 30, 30) == []
    assert g.clip_line([(-5, 5), (15, 5), (15, 8), (5, 8)], 0, 0, 10, 10) == [[(0, 5), (10, 5)], [(10, 8), (5, 8)]]


def test_distances():
    assert g.contains(SQUARE, 5, 5) and not g.contains(SQUARE, 15, 5)
    assert g.line_distance([(0, 0), (10, 0)], 13, 4) == 5 and g.line_distance([(1, 1)], 4, 5) == 5
    assert g.centroid(SQUARE) == (5, 5)


def test_simplify_stays_near():
    rng = random.Random(2)
    line = [(float(i), rng.uniform(-3, 3)) for i in range(200)]
    short = g.simplify(line, 1.5)
    assert short[0] == line[0] and short[-1] == line[-1] and len(short) < len(line)
    assert all(g.line_distance(short, *p) <= 1.5 + 1e-9 for p in line)


def test_stitch():
    ring = g.stitch([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)], [(5, 5), (6, 6)]])
    assert [len(r) for r in ring] == [4, 2] and ring[0][0] == ring[0][-1]


def test_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    reasons = rules.review_reasons(F.lit(1), F.lit(900.0), F.lit(700.0), F.lit(130.0), F.lit("town"), F.lit(False))
    assert one(reasons) == ["match too far", "pin 130m", "address only to town"]
    assert [tuple(one(rules.station_rank(F.lit(h), F.lit(n)))) for h, n in ((True, 1), (False, 3), (False, 2), (False, 1))] == [(11, 3), (12, 2), (13, 1), (13, 0)]
    clean = rules.enrichment({"catch": (F.lit(" a  b "), 60)}, F.array(F.lit("x"), F.lit("不明")), F.array(F.struct(F.lit("").alias("n"), F.lit("1").alias("p"))), F.array(F.lit("https://a"), F.lit("b")))
    assert one(clean["catch"]) == "a b" and one(clean["rules"]) == ["x"] and one(clean["menu"]) == [] and one(clean["sources_add"]) == ["https://a"]


def test_pin_gap_and_polygons(spark):
    assert g.nearest_on_ring(SQUARE, 13, 14) == (10, 10) and g.nearest_on_ring(SQUARE, 4, -3) == (4, 0)
    rows = [(SQUARE, 5.0, 5.0), (SQUARE, 13.0, 14.0), (None, 1.0, 1.0), (SQUARE, None, 1.0), ([], 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>, x double, y double")
    got = [r.at.gap for r in df.select(g.pin_gap(F.col("ring"), F.col("x"), F.col("y")).alias("at")).collect()]
    assert got == [0.0, 5.0, None, None, None]
    hole = SQUARE[::-1]
    lists = spark.createDataFrame([([SQUARE, hole, SQUARE],), ([hole, SQUARE],), ([],), (None,)], "rings array<array<struct<x:double,y:double>>>")
    got = [None if r.p is None else [len(x) for x in r.p] for r in lists.select(g.polygons(F.col("rings")).alias("p")).collect()]
    assert got == [[2, 1], [1, 1], [], None]


def test_nearest_of_any_size(spark):
    """More known rows than could be broadcast, far and polar rows, ties and missing coordinates, against brute force."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    known = pd.DataFrame({"sid": np.arange(120_000), "slat": rng.normal(35.6, 0.2, 120_000), "slng": rng.normal(139.6, 0.3, 120_000)})
    known.loc[1, ["slat", "slng"]] = known.loc[0, ["slat", "slng"]].values
    known.loc[2, ["slat", "slng"]] = [89.9, 10.0]
    left = pd.DataFrame({"id": np.arange(60), "lat": rng.normal(35.6, 0.3, 60), "lng": rng.normal(139.6, 0.5, 60)})
    left.loc[0, ["lat", "lng"]] = known.loc[1, ["slat", "slng"]].values
    for i, at in enumerate([(-60.0, -170.0), (90.0, -179.0), (88.0, 100.0), (0.0, 0.0), (37.5, 139.6)]):
        left.loc[1 + i, ["lat", "lng"]] = at
    want = {}
    for r in left.itertuples():
        x = np.radians(known.slng - r.lng) * np.cos(np.radians((known.slat + r.lat) / 2))
        want[r.id] = int(np.hypot(x, np.radians(known.slat - r.lat)).values.argmin())
    given = spark.createDataFrame(left).union(spark.createDataFrame([(99, None, 1.0)], "id long, lat double, lng double"))
    stations = spark.createDataFrame(known).union(spark.createDataFrame([(-1, None, None)], "sid long, slat double, slng double"))
    near = spatial.nearest_one(given, stations, ("lat", "lng"), ("slat", "slng"), "sid", ["sid"], ["id"])
    assert {r.id: r.sid for r in near.collect()} == want and want[0] == 0
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert spatial.nearest_one(given, stations.limit(0), ("lat", "lng"), ("slat", "slng"), "sid", ["sid"], ["id"]).count() == 0
