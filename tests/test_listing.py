from pyspark.sql import functions as F

from venuelake.functions import listing
from venuelake.operators import geometry, resolve

POINTS = "array<struct<x:double,y:double>>"


def test_words(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    null = F.lit(None).cast("string")
    assert tuple(one(listing.payment_english(null))) == (None, None)
    assert tuple(one(listing.payment_english(F.lit("Credit card something")))) == (None, False)
    assert tuple(one(listing.payment_japanese(F.lit("カード不可 電子マネー可")))) == ("現金・電子マネー可", False)
    assert tuple(one(listing.payment_japanese(null))) == (None, None)
    assert one(listing.smoking_english(F.lit("There is a SMOKING AREA"))) == "分煙・喫煙所あり" and one(listing.smoking_english(null)) is None
    assert one(listing.smoking_japanese(F.lit("喫煙専用室あり"))) == "分煙・喫煙所あり" and one(listing.smoking_japanese(F.lit("全席禁煙"))) == "全席禁煙"
    assert one(listing.charge_text(null)) is None and one(listing.charge_text(F.lit("無し"))) == "チャージなし"
    assert one(listing.source_id(F.array(F.lit("https://a.example/x"), F.lit("https://a.example/12"), F.lit("https://a.example/13")), r"a\.example/(\d+)")) == "12"
    assert one(listing.source_id(F.array().cast("array<string>"), "(x)")) is None
    assert one(listing.not_a_street(null, null, null)) is False


def test_segment_distance():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert geometry.ring_segment_distance(square, (-1, 2), (9, 2)) == 0  # crosses, both ends outside
    assert geometry.ring_segment_distance(square, (1, 1), (2, 2)) == 0  # inside
    assert geometry.ring_segment_distance(square, (7, -5), (7, 9)) == 3  # passes by
    assert geometry.ring_segment_distance(square, (7, 8), (20, 30)) == 5  # end point, corner
    assert geometry.ring_segment_distance(square, (7, 2), (7, 2)) == 3  # a point


def test_fronting_and_split_edges(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    b = spark.createDataFrame([(1, square), (2, []), (3, None)], f"id long, points {POINTS}")
    line = spark.createDataFrame([([(-500.0, 14.0), (900.0, 14.0)],), ([(3.0, 3.0)],), (None,)], f"points {POINTS}")
    assert [r.id for r in geometry.fronting(b, line, "id", 6.0, 900.0).collect()] == [1]
    assert geometry.fronting(b, line, "id", 3.0, 900.0).count() == 0
    assert geometry.fronting(b, line.limit(0), "id", 6.0, 900.0).count() == 0
    cut = geometry.grid_split(b, "points", 4.0).collect()
    assert sorted((r.cx, r.cy) for r in cut) == [(x, y) for x in range(3) for y in range(3)]


def test_joins_with_nulls(spark):
    rows = spark.createDataFrame([(1, 5, None), (2, None, 6), (3, 9, 6), (4, None, None)], "id long, a long, b long")
    one = spark.createDataFrame([(5, 50.0), (None, 1.0)], "id long, lat double")
    two = spark.createDataFrame([(6, 60.0)], "id long, lat double")
    got = {r.id: r.lat for r in resolve.cross_check(rows, one, two, "a", "b", ["lat"]).collect()}
    assert got == {1: 50.0, 2: 60.0, 3: 60.0, 4: None}
    fixed = resolve.repaired(rows, spark.createDataFrame([(2, 7, None)], "id long, a long, b long"), "id", ["a", "b"])
    assert {tuple(r) for r in fixed.collect()} == {(1, 5, None), (2, 7, 6), (3, 9, 6), (4, None, None)}
    direct = spark.createDataFrame([(1, "d"), (2, None)], "key long, store string")
    hits = spark.createDataFrame([(1, "h", 0, 0), (2, "late", 1, 0), (2, "far", 0, 4), (2, "good", 0, 3), (3, "third", 2, 0)], "key long, store string, query long, place long")
    assert {tuple(r) for r in resolve.direct_else_search(direct, hits, F.lit(True)).collect()} == {(1, "d"), (2, "good")}


def test_japanese_order(spark):
    """By reading where there is one, else by name; kana in the order of the syllabary, the scripts folded together."""
    from venuelake.plans.query import japanese_order

    rows = [(1, "さかば", "酒場"), (2, "あさひ", "旭"), (3, "カモメ", "鴎"), (4, "", "いろは"), (5, "うめ", "梅"), (6, "", "アオ")]
    df = spark.createDataFrame(rows, "id int, kana string, name string")
    assert [r.id for r in df.orderBy(japanese_order(F.col("kana"), F.col("name")), "id").collect()] == [6, 2, 4, 5, 3, 1]
