import datetime

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from venuelake.functions import geo, hours, hours_parse, text
from venuelake.operators import merge, tiles, windows
from venuelake.plans import catalog
from venuelake.plans.query import VenueQuery


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def week_in(row):
    return None if row is None else {k: [[r.o, r.c, r.lo] for r in v] for k, v in row.items()}


def test_days(spark):
    days = lambda x: one(spark, hours_parse.day_set(F.lit(x)))
    assert sorted(days("土〜月")) == ["mon", "sat", "sun"]
    assert days("平日") == ["mon", "tue", "wed", "thu", "fri"]
    assert days("祝前日") == ["prehol"]
    assert sorted(days("月曜日")) == ["mon", "sun"]
    assert sorted(days("祝日")) == ["hol", "sun"] and days("月曜") == ["mon"]
    assert days("毎日") == hours.DAYS and days("") == [] and days(None) is None


def test_ranges(spark):
    found = lambda x: [[r.o, r.c, r.lo] for r in one(spark, hours_parse.ranges(F.lit(x)))]
    assert found("18:00〜2:00") == [[1080, 1560, None]]
    assert found("17:00〜始発") == [[1020, 1740, None]]
    assert found("17:00-17:00") == [[1020, 2460, None]]
    assert found("17時〜翌1時 12時30分〜14:00(L.O.13:30)") == [[1020, 1500, None], [750, 840, 810]]
    assert found("電話で") == []


def test_free_hours(spark):
    free = lambda x, closed=None: week_in(one(spark, hours_parse.parse_free(F.lit(x).cast("string"), F.lit(closed).cast("string"))))
    assert free("不定") is None and free("日により 17:00〜23:00") is None and free(None) is None and free("") is None
    week = free("11:00〜14:00、17:00〜22:00")
    assert set(week) == {*hours.DAYS, "hol"} and all(v == [[660, 840, None]] for v in week.values())
    week = free("月〜金 17:00〜23:00、土 15:00〜22:00", "日")
    assert week["mon"] == [[1020, 1380, None]] and week["sat"] == [[900, 1320, None]] and week["sun"] == []
    assert "sun" not in free("月 17:00〜23:00", "第2日")
    late = free("17:00〜23:00（金・土は翌4:00まで）", "正月")
    assert late["mon"] == late["hol"] == [[1020, 1380, None]] and late["fri"] == late["sat"] == [[1020, 1680, None]]
    both = free("17:00〜23:00、日 15:00〜21:00")
    assert both["mon"] == [[1020, 1380, None]] and both["sun"] == [[900, 1260, None]] and set(both) == {*hours.DAYS, "hol"}
    assert free("月 17:00〜23:00（火14:00〜）") == {"mon": [[1020, 1380, None]]}
    assert free("17時頃〜翌朝（2019年時点の記事）")["mon"] == [[1020, 1740, None]]


def test_split_top(spark):
    parts = lambda x: one(spark, hours_parse.split_top(F.lit(x)))
    assert parts("a、b（c、d(e、f)、g）h／i") == ["a", "b（c、d(e、f)、g）h", "i"]
    assert parts("a（b、c") == ["a（b、c"] and parts("、 ,") == [] and parts("a）、b") == ["a）", "b"]


def test_english_hours(spark):
    english = lambda x: week_in(one(spark, hours_parse.parse_english(F.lit(x))))
    assert english("Mon, Tue 12:30 AM - 12:00 PM Sun Closed") == {"mon": [[30, 720, None]], "tue": [[30, 720, None]], "sun": []}
    week = english("Mon 5:00 PM - 11:00 PM L.O. Food 10:00 PM Drinks 10:30 PM Public Holiday 3:00 PM - 9:00 PM Fri Open 24 hours")
    assert week == {"mon": [[1020, 1380, 1350]], "fri": [[0, 1440, None]], "hol": [[900, 1260, None]]}


def test_listing(spark):
    def listing(x, closed=None):
        row = spark.range(1).select(hours_parse.parse_listing(F.lit(x), F.lit(closed).cast("string")).alias("w"), hours_parse.listing_dormant(F.lit(x), F.lit(closed).cast("string")).alias("d")).first()
        return week_in(row.w), row.d

    week, dormant = listing("月 17:00-23:00 月 11:00-14:00")
    assert not dormant and week["mon"] == [[1020, 1380, None], [660, 840, None]]
    week, _ = listing("16:00～23:00", "日")
    assert week["sun"] == [] and week["mon"] == week["hol"] == [[960, 1380, None]]
    week, _ = listing("火～金: 16:30～22:30 （料理L.O. 22:00） 土: 12:00～翌0:00", "月")
    assert week["tue"] == week["fri"] == [[990, 1350, 1320]] and week["sat"] == [[720, 1440, None]] and week["mon"] == [] and "sun" not in week
    assert listing("日: 00:00～00:30", "月") == (None, True) and listing("", "月") == (None, False)


def test_parsers_stay_in_the_jvm(spark):
    """But for the Unicode form, no part of a parser is Python."""
    df = spark.createDataFrame([("月 17:00-23:00", "日")], "h string, c string")
    plan = lambda c: df.select(c)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan(hours_parse.parse_listing(F.col("h"), F.col("c"))) and "Python" not in plan(hours_parse.parse_english(F.col("h")))


def week_of(**days):
    entry = lambda r: F.struct(*[F.lit(v).cast("int").alias(n) for n, v in zip(("o", "c", "lo"), r)])
    pairs = []
    for k, v in days.items():
        pairs += [F.lit(k), F.array(*[entry(r) for r in v]) if v else F.array().cast(hours.RANGES)]
    return F.create_map(*pairs)


def state(spark, now, uncertain=False, holidays=(), **days):
    return one(spark, hours.open_state(week_of(**days), F.lit(uncertain), F.to_timestamp(F.lit(now)), list(holidays)))


def test_spill_over_midnight(spark):
    s = state(spark, "2024-01-02 01:30:00", mon=[(1020, 1560, None)])  # a Tuesday
    assert s.open and s.until == 120 and s.left == 30
    assert state(spark, "2024-01-02 00:10:00", mon=[(1500, 1740, None)]).open  # opens at 25:00, counted from midnight


def test_holiday_presence(spark):
    listed = state(spark, "2024-01-01 20:00:00", holidays=["2024-01-01"], hol=[], mon=[(1020, 1380, None)])
    assert not listed.open and listed.closed_today
    assert state(spark, "2024-01-01 20:00:00", holidays=["2024-01-01"], mon=[(1020, 1380, None)]).open


def test_unknown_states(spark):
    assert state(spark, "2024-01-01 20:00:00", uncertain=True, mon=[(1020, 1380, None)]) is None
    assert state(spark, "2024-01-03 20:00:00", mon=[(1020, 1380, None)]) is None
    assert one(spark, hours.state_label(F.lit(None).cast("struct<open:boolean,left:int,opens_at:int,next_open:int,next_days:int>"))) == "unknown"


def test_numbers(spark):
    assert [one(spark, text.clamp(F.lit(x).cast("string"), 1, 5, 3)) for x in ("9", "x", None, "0", "3.5")] == [5, 3, 3, 1, 3]
    assert one(spark, geo.min_zoom(F.lit(0.0))) == 17
    assert one(spark, geo.walk_minutes(F.lit(100.0))) == 1 and one(spark, geo.walk_minutes(F.lit(120.0))) == 2
    assert one(spark, hours.clock12(F.lit("12:30 AM"))) == 30 and one(spark, hours.clock12(F.lit("12:00 PM"))) == 720
    assert one(spark, hours.clock_ja(F.lit("2:00"), F.lit(1080))) == 1560 and one(spark, hours.clock_ja(F.lit("始発"))) == 1740


def test_texts(spark):
    assert one(spark, text.clean_text(F.lit("　 あ　"))) == "あ" and one(spark, text.clean_text(F.lit("　"))) is None
    assert one(spark, text.slug(F.lit("Hello, World!"))) == "hello-world"
    assert one(spark, text.clean_address(F.lit("〒100-0001 北区赤羽１ー2−3 ビル5F"))) == "北区赤羽1-2-3"
    assert one(spark, text.clean_address(F.lit("赤羽1丁目2番3号 ビル"))) == "赤羽1丁目2"
    assert tuple(one(spark, text.address_key(F.lit("東京都八王子市旭町1-2")))) == ("八王子市", "旭町", ["1", "2"])
    assert tuple(one(spark, text.address_key(F.lit("東京都北区上十条２丁目30番13号")))) == ("北区", "上十条", ["2", "30", "13"])
    assert one(spark, text.address_key(F.lit("東京都北区"))) is None
    assert tuple(one(spark, text.yen_range(F.lit("JPY 2,000")))) == (2000, None) and tuple(one(spark, text.yen_range(F.lit("- JPY 999")))) == (None, 999)
    assert one(spark, text.short_label(F.lit("三千円（税込）から"))) == "三千円から" and one(spark, text.opening_text(F.lit("2010.4.1"))) == "2010年4月開店"
    assert one(spark, text.has_all_tokens(text.search_document(F.lit("ﾋﾞｰﾙ Ｂar")), "ビール ＢＡＲ")) is True
    assert one(spark, text.stale_note(F.lit("2019年と2021年"), 2024)) is True
    assert one(spark, text.split_top(F.lit("a、b（c、d）、e"))) == ["a", "b（c、d）", "e"]


def test_references_of_the_sql(spark, tmp_path):
    """A page that is cut inside a reference: the query leaves what its SQL leaves, the operator by itself reads it."""
    pages = ["<p>a&quot", "&quot b&quot;&amp &amp;&am", "&amp;lt;&lt&lt;&gt&gt;", "&nbsp;&#65;&copy&copy;&middot&middot;&ampmiddot;", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(db.execute(catalog.SQL["html_to_text_entities"]).fetchall())
    assert dict(map(tuple, catalog.QUERIES["html_to_text_entities"](spark, str(tmp_path)).collect())) == want and want[0] == "a&quot"
    assert one(spark, text.html_to_text(F.lit("<p>a&quot"))) == 'a"' and one(spark, text.html_to_text(F.lit("&#65;&eacute; &lt"), entities=False)) == "&#65;&eacute; &lt"
    assert one(spark, text.html_to_text(F.lit("&#65;&eacute; &lt"))) == "Aé <"


def test_percentile_by_index(spark):
    df = spark.range(1, 11)
    assert df.agg(windows.index_percentile(F.col("id"), 0.5).alias("m"), windows.index_percentile(F.col("id"), 0.9).alias("p")).first() == (6, 10)
    assert tuple(windows.ranked_percentile(df, "id", [0.5, 0.9]).first()) == (10, 6, 10)


def test_split_with_overlap(spark):
    assert one(spark, windows.split_overlap(F.array(*map(F.lit, range(5))), 2)) == [[0, 1, 2], [2, 3, 4]]


def test_precedence_keeps_zero(spark):
    assert tuple(one(spark, merge.first_known((F.lit("－"), "A"), (F.lit(" 未確認 "), "B"), (F.lit("none"), "C")))) == ("none", "C")
    f = merge.first_known((F.lit("不明"), "A"), (F.lit("0"), "B"), (F.lit("x"), "C"))
    assert tuple(one(spark, f)) == ("0", "B")


def test_cheap_and_card(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 2500, False), (3, None, True), (4, 2501, False)], "id long, b int, cash boolean")
    assert [r.id for r in VenueQuery(df).cheap("b", 2500).df.collect()] == [2]
    assert [r.id for r in VenueQuery(df).not_true("cash").df.collect()] == [2, 4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**8, 10**8), st.integers(-10**8, 10**8)), min_size=1, max_size=20))
def test_polyline_round_trip(points):
    want = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
    assert tiles.decode_points(tiles.encode_points(points)) == want


def test_sources(spark, tmp_path):
    from venuelake.sources import files

    (tmp_path / "a.json").write_text('[{"id": "x", "n": 1}, {"id": "y"}]')
    (tmp_path / "b.json").write_text("not json")
    rows = files.json_rows(spark, f"{tmp_path}/*.json", "id string, n int").orderBy("ord").collect()
    assert [(r.id, r.n, r.stem) for r in rows] == [("x", 1, "a"), ("y", None, "a")]
    (tmp_path / "m.json").write_text('{"k1": {"v": 1}, "k2": {}}')
    assert sorted(r.id for r in files.json_map(spark, f"{tmp_path}/m.json").select("id").collect()) == ["k1", "k2"]
    assert files.optional_json(spark, f"{tmp_path}/none.json", "id string").count() == 0
    keyed = files.json_any(spark, f"{tmp_path}/a.json", "id", text.slug).select("id")
    assert sorted(r.id for r in keyed.collect()) == ["x", "y"]


def test_streaming_sessions(spark, tmp_path):
    from venuelake.streaming import events

    base = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, base), (1, base + datetime.timedelta(minutes=5)), (1, base + datetime.timedelta(hours=3))], "user long, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream, "ts", "1 hour", ["user"], late="10 minutes", n=F.count(F.lit(1))).writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("SELECT n FROM out").collect()] == [2]
    assert sorted(r.n for r in events.sessions(df, "ts", "1 hour", ["user"]).collect()) == [1, 2]
