"""Nearest points among copies and in dense places, against comparing all pairs."""

import random

from pyspark.sql import functions as F

from venuelake.functions import geo
from venuelake.operators import spatial
from venuelake.plans import catalog


def test_nearest_others(spark):
    rng = random.Random(3)
    rows = [(i, 35.6 + rng.randrange(40) / 1e4, 139.6 + rng.randrange(40) / 1e4) for i in range(300)]  # dense, some copies
    rows += [(1000 + i, 35.601, 139.601) for i in range(30)]  # many copies of one place
    rows += [(2000, 35.70, 139.6), (2001, 35.712, 139.6), (2002, -35.7, -139.6), (2003, None, 139.6)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double").repartition(5)
    other = df.toDF("other", "lat2", "lng2")
    pairs = df.crossJoin(other).where("id != other").withColumn("distance", geo.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).where("distance < 1500")
    want = spatial.nearest_k(pairs, ["id"], [F.col("distance"), F.col("other")], 4).select("id", "other", "distance", "rank").collect()
    got = spatial.nearest_others(df, "id", ("lat", "lng"), 4, 1500.0, geo.haversine).collect()
    assert len(want) > 1300 and sorted(got) == sorted(want)


def _tables(spark, tmp_path, customers, suppliers):
    """Venues and stations of these keys."""
    c = spark.createDataFrame([(k,) for k in customers], "c_custkey long")
    c.select("c_custkey", F.lit("n").alias("c_name"), F.lit(0).alias("c_nationkey"), F.lit("s").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_copies_of_places_are_joined_once(spark, tmp_path, monkeypatch):
    """Keys that differ by 119,000 lie at one place: the join meets each place once, and every copy gets its result."""
    given = []
    within = spatial.within
    monkeypatch.setattr(spatial, "within", lambda left, right, *a, **k: given.append((left.count(), right.count())) or within(left, right, *a, **k))
    sf = _tables(spark, tmp_path, [k + 119000 * i for k in range(40) for i in range(5)], [k + 119000 * i for k in range(2000) for i in range(2)])
    for name in ("knn_distinct_names", "fuzzy_member_link", "entity_match_rank"):
        given.clear()
        rows = catalog.QUERIES[name](spark, sf).collect()
        assert given == [(40, 2000)], name
        by_place = {}
        for r in rows:
            by_place.setdefault(r.id % 119000, {}).setdefault(r.id, []).append(tuple(r[c] for c in r.__fields__ if c not in ("id", "within")))
        assert by_place and all(len(x) == 5 and len({tuple(sorted(v)) for v in x.values()}) == 1 for x in by_place.values()), name
