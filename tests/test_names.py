from pyspark.sql import functions as F

from venuelake.functions import names
from venuelake.session import ship_package


def test_cores(spark):
    ship_package(spark)

    def cores(name, places=(), extra=(), stations=None):
        words = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        return spark.range(1).select(names.name_cores(F.lit(name).cast("string"), words(places), words(extra), None if stations is None else words(stations)).alias("c")).first().c

    assert cores("立ち飲み 山田屋 新橋店") == ["立ち飲み山田屋新橋店", "立ち飲み山田屋", "山田屋"]
    assert cores("新橋山田屋", ["新橋"]) == ["新橋山田屋", "山田屋"]
    assert cores("BAR") == [] and cores(None) == [] and cores("新橋", ["新橋"]) == []
    assert cores("カクウチ（Kakuuchi Base）") == ["カクウチ", "KakuuchiBase"]
    assert cores("鈴木酒店") == ["鈴木酒店", "鈴木"]
    assert cores("のんべい横丁") == ["のんべい横丁", "のんべい"]
    assert cores("串揚げ 田中 総本店", extra=["Tanaka", "The Bar Ox"]) == ["串揚げ田中総本店", "串揚げ", "田中", "TheBarOx", "Tanaka"][:3] + ["TheBarOx", "Tanaka"]
    assert cores("HAMAMATSUCHO", stations=["hamamatsucho"]) == [] and cores("ABC") == []
    assert names.romaji_place("Hamamatsuchō Station") == "hamamatsucho" and names.romaji_place("Eki") is None


def test_columns(spark):
    ship_package(spark)
    df = spark.createDataFrame([("新橋 山田屋", "新橋"), (None, None)], "n string, p string")
    got = df.select(names.name_cores("n", F.array("p"), F.array().cast("array<string>")).alias("c")).collect()
    assert "山田屋" in got[0].c and got[1].c == []
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    words = names.place_words(F.lit("烏森"), F.lit(None).cast("string"), F.lit("港区"), F.lit("JR新橋駅・内幸町駅"), F.lit("東京都港区新橋三丁目２-1"))
    assert one(words) == ["烏森", "港区", "新橋", "内幸町", "港区", "新橋"]
    assert one(names.station_reading(F.lit("シンバシえき"))) == "しんばし"
    assert one(names.canon_area(F.lit("新橋（東口）"), {"新橋": "しんばし"})) == "しんばし"
    assert one(names.station_name(F.lit("新橋（JR）駅"))) == "新橋"
    assert one(names.original_text(F.lit("Original text 立ち飲み Translated standing"))) == "立ち飲み"
    c = one(names.contact(F.lit('rating: 3.52 tel 03-1234-5678 <a href="https://own.example/x"><a href="https://shop.example">'), "own.example"))
    assert tuple(c) == ("03-1234-5678", 3.52, "https://shop.example")
    assert spark.range(1).where(F.lit("山・田 屋").rlike(names.loose("山田屋"))).count() == 1


def test_reconcile(spark):
    """All seven outcomes and all matches; the name's normal form, aliases, area or ward, the address key."""
    from venuelake.operators import resolve

    spots = [("a", "モツ焼 一", "北", "北区", "東京都北区赤羽1丁目2番3号 ビル", None), ("b", "もつ焼一", "西", "北区", "東京都北区赤羽１－２－３", "closed"), ("c", "別", None, None, "東京都北区赤羽1-2", None)]
    given = [
        (1, "もつ焼・一", None, "北", None, "a"), (2, "x", ["もつ焼一", None], "", None, "b"), (3, "別", None, "北", None, "c"), (4, "別", None, None, None, "zz"), (5, "違", None, None, None, "a"),
        (6, "もつ焼一", ["モツ焼一"], "北区", None, ""), (7, "もつ焼一", None, "西", None, None), (8, "もつ焼一", None, "南", "東京都北区赤羽1-2-3号室", None), (9, "無", None, None, "大阪府1-2", None), (10, None, None, None, None, None),
    ]
    c = spark.createDataFrame(given, "n int, name string, aliases array<string>, area string, address string, spot_id string")
    s = spark.createDataFrame(spots, "id string, name string, area string, ward string, address string, status string")
    got = {r.n: (r.state, r.matches) for r in resolve.reconcile(c, s, "n").collect()}
    assert got == {
        1: ("掲載あり", ["a"]), 2: ("閉店掲載", ["b"]), 3: ("参照不一致", ["c"]), 4: ("参照先なし", []), 5: ("参照不一致", ["a"]),
        6: ("候補一致・要確認", ["a", "b"]), 7: ("候補一致・要確認", ["b"]), 8: ("住所候補・要確認", ["a", "b"]), 9: ("一致未確認", []), 10: ("一致未確認", []),
    }


def test_each_part_is_computed_once(spark):
    """The list in order is named once in the plan, not once more for every element, and the fixed words come folded."""
    ship_package(spark)
    none = F.array().cast("array<string>")
    plan = spark.range(1).select(names.name_cores(F.col("id").cast("string"), none, none).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_sort(") == 1
    words = F.array(*map(F.lit, [*names.GENERIC, *names.SUFFIXES, *names.NO_CORE]))
    assert spark.range(1).select(F.transform(words, names._folded).alias("w")).first().w == names._TAKEN
