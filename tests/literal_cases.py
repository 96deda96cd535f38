"""Small literal tables with expected values for parsers and rules. ``test_cases`` runs them.

Each case gives (n, out): its number, and what comes of it as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.functions import geo, hours, hours_parse, names, rules, text
from venuelake.operators import geometry, merge, quality, resolve, tiles, windows
from venuelake.session import ship_package
from venuelake.sources import files, sinks
from venuelake.plans import research

QUERIES: dict[str, Callable[[SparkSession], DataFrame]] = {}
EXPECTED: dict[str, list[str | None]] = {}


def cases(name: str, doc: str, schema: str, table: list[tuple], expected: list[str | None]):
    """Register a table: the decorated function makes ``out`` of a DataFrame with ``n`` and the columns of ``schema``."""

    def register(f: Callable[[DataFrame], DataFrame | Column]):
        def run(spark: SparkSession) -> DataFrame:
            ship_package(spark)
            df = spark.createDataFrame([(i, *row) for i, row in enumerate(table)], f"n int, {schema}")
            made = f(df)
            made = df.select("n", made.alias("out")) if isinstance(made, Column) else made
            return made.select("n", F.col("out").cast("string").alias("out"))

        run.__doc__, run.__name__ = doc, name
        QUERIES[name] = run
        EXPECTED[name] = expected
        return f

    return register


def _all(days: list[str], ranges: str) -> str:
    return ",".join(f'"{d}":[{ranges}]' for d in days)


def _range(o: int, c: int, lo: int | None = None) -> str:
    return f'{{"o":{o},"c":{c}' + (f',"lo":{lo}}}' if lo is not None else "}")


WEEKDAYS, WEEK = hours.DAYS[:5], hours.DAYS


@cases(
    "hours_free_cases", "D03-D05, F18: free texts with notes, exceptions, closings.", "hours string, closed string",
    [
        ("日により 17:00〜23:00", None), ("17:00〜23:00（金・土は翌4:00まで）", "正月"), ("17:00〜23:00、日 15:00〜21:00", None), ("11:00〜14:00、17:00〜22:00", None),
        ("月〜金 17:00〜23:00(L.O.22:30)、土 15:00〜22:00", "日"), ("月〜土11:30〜14:00、16:00〜20:00", "日曜"), ("17:00〜24:00（土16:00〜18:00、日祝〜22:00）", "第2月"),
        ("17時頃〜翌朝（2019年時点の記事）", None), ("月 17:00〜23:00（火14:00〜）", None), ("平日１７：００～２３：００", "祝前日"), ("18:00〜2:00（土・祝14:00〜）", None), (None, "月"), ("電話で確認", None),
    ],
    [
        None,
        "{" + _all(WEEK[:4], _range(1020, 1380)) + "," + _all(["fri", "sat"], _range(1020, 1680)) + "," + _all(["sun", "hol"], _range(1020, 1380)) + "}",
        "{" + _all(WEEK[:6], _range(1020, 1380)) + "," + _all(["sun"], _range(900, 1260)) + "," + _all(["hol"], _range(1020, 1380)) + "}",
        "{" + _all([*WEEK, "hol"], _range(660, 840)) + "}",
        "{" + _all(WEEKDAYS, _range(1020, 1380, 1350)) + "," + _all(["sat"], _range(900, 1320)) + "," + _all(["sun"], "") + "}",
        "{" + _all(WEEK[:6], _range(690, 840) + "," + _range(960, 1200)) + "," + _all(["sun"], "") + "}",
        "{" + _all(WEEKDAYS, _range(1020, 1440)) + "," + _all(["sat"], _range(960, 1080)) + "," + _all(["sun", "hol"], _range(1020, 1320)) + "}",
        "{" + _all([*WEEK, "hol"], _range(1020, 1740)) + "}",
        "{" + _all(["mon"], _range(1020, 1380)) + "}",
        "{" + _all(WEEKDAYS, _range(1020, 1380)) + "," + _all(["prehol"], "") + "}",
        "{" + _all(WEEKDAYS, _range(1080, 1560)) + "," + _all(["sat"], _range(840, 1560)) + "," + _all(["sun"], _range(1080, 1560)) + "," + _all(["hol"], _range(840, 1560)) + "}",
        None,
        None,
    ],
)
def _free(df):
    return F.to_json(hours_parse.parse_free(F.col("hours"), F.col("closed")))


@cases(
    "hours_english_cases", "D01, D06: last orders of food and drinks, holidays, whole days.", "hours string",
    [
        ("Mon, Tue 12:30 AM - 12:00 PM Sun Closed",), ("Mon 5:00 PM - 11:00 PM L.O. Food 10:00 PM Drinks 10:30 PM Public Holiday 3:00 PM - 9:00 PM",),
        ("Fri 6:00 PM - 2:00 AM L.O. 1:00 AM",), ("Sat Open 24 hours Sat 5:00 PM - 5:00 PM",), ("Wed 11:00 AM - 2:00 PM 5:00 PM - 10:00 PM ■ Closed in August",), ("by appointment",),
    ],
    [
        "{" + _all(["mon", "tue"], _range(30, 720)) + "," + _all(["sun"], "") + "}",
        "{" + _all(["mon"], _range(1020, 1380, 1350)) + "," + _all(["hol"], _range(900, 1260)) + "}",
        "{" + _all(["fri"], _range(1080, 1560, 1500)) + "}",
        "{" + _all(["sat"], _range(1020, 2460)) + "}",
        "{" + _all(["wed"], _range(660, 840) + "," + _range(1020, 1320)) + "}",
        None,
    ],
)
def _english(df):
    return F.to_json(hours_parse.parse_english(F.col("hours")))


@cases(
    "hours_listing_cases", "D07-D09, F19: both forms of a listing, closing days, pages left up.", "hours string, closed string",
    [
        ("16:00～23:00", "日"), ("火～金: 16:30～22:30 （料理L.O. 22:00） 土: 12:00～翌0:00", "月"), ("月・火 17:00-23:00 月 11:00 - 14:00 L.O. 13:30", "水※"),
        ("日: 00:00～00:30", "月"), ("金～月、祝前日: 18:00～翌2:00【備考】火 9:00～10:00", "不定休"), ("", "月"),
    ],
    [
        "{" + _all(WEEK[:6], _range(960, 1380)) + "," + _all(["sun"], "") + "," + _all(["hol"], _range(960, 1380)) + "} false",
        "{" + _all(["mon"], "") + "," + _all(WEEK[1:5], _range(990, 1350, 1320)) + "," + _all(["sat"], _range(720, 1440)) + "} false",
        "{" + _all(["mon"], _range(1020, 1380) + "," + _range(660, 840, 810)) + "," + _all(["tue"], _range(1020, 1380)) + "," + _all(["wed"], "") + "} false",
        "- true",
        "{" + _all(["mon", "fri", "sat", "sun", "prehol"], _range(1080, 1560)) + "} false",
        "- false",
    ],
)
def _listing(df):
    week = F.coalesce(F.to_json(hours_parse.parse_listing(F.col("hours"), F.col("closed"))), F.lit("-"))
    return F.concat_ws(" ", week, hours_parse.listing_dormant(F.col("hours"), F.col("closed")).cast("string"))


@cases(
    "hours_summary_cases", "W01: days with equal hours and last orders in one group.", "hours string, closed string",
    [("月〜金 17:00〜23:00(L.O.22:30)、土 15:00〜22:00", "日"), ("月・火 17:00〜23:00、水 17:00〜23:00(L.O.22:30)", None), ("18:00〜2:00", "祝前日"), ("月〜日 17:00〜23:00", "土日祝")],
    ["月〜金 17:00〜23:00（L.O.22:30）／土 15:00〜22:00／日 定休", "月・火 17:00〜23:00／水 17:00〜23:00（L.O.22:30）", "月〜日・祝 18:00〜26:00／祝前日 定休", "月〜金 17:00〜23:00／土・日・祝 定休"],
)
def _summary(df):
    return df.select("n", hours_parse.parse_free(F.col("hours"), F.col("closed")).alias("w")).select("n", hours.hours_text(F.col("w")).alias("out"))


@cases(
    "address_cases", "ST12, ST13, J13: cleaned addresses, their keys, and whether they are one place.", "a string, b string",
    [
        ("〒115-0045 東京都北区赤羽１丁目２番３号 ビル2F", "東京都北区赤羽1-2-3"), ("東京都北区上十条2-30-13", "東京都北区上十条２丁目３０"), ("東京都八王子市旭町1-2", "東京都八王子市旭町1-3"),
        ("東京都港区新橋2ー8−1", "東京都港区新橋2-8"), ("東京都北区", "東京都北区"), ("東京都北区赤羽2-30", "東京都北区赤羽2-31"),
    ],
    [
        "東京都北区赤羽1丁目2 北区 赤羽 1-2-3 true", "東京都北区上十条2-30-13 北区 上十条 2-30-13 true", "東京都八王子市旭町1-2 八王子市 旭町 1-2 false",
        "東京都港区新橋2-8-1 港区 新橋 2-8-1 true", "東京都北区 false", "東京都北区赤羽2-30 北区 赤羽 2-30 false",
    ],
)
def _address(df):
    a, b = text.address_key(F.col("a")), text.address_key(F.col("b"))
    return F.concat_ws(" ", text.clean_address(F.col("a")), a["ward"], a["town"], F.array_join(a["numbers"], "-"), resolve.same_place(a, b).cast("string"))


@cases(
    "name_core_cases", "ST07, ST08: what of a name tells it apart.", "name string, places array<string>, extra array<string>",
    [
        ("立ち飲み 山田屋 新橋店", [], []), ("新橋山田屋", ["新橋"], []), ("BAR", [], []), ("カクウチ（Kakuuchi Base）", [], []), ("鈴木酒店", [], []), ("渋谷のんべい横丁", ["渋谷"], []),
        ("田中", [], ["Tanaka", "The Bar Ox"]), ("新橋", ["新橋"], []), ("ABC", [], []), (None, None, None),
    ],
    [
        "立ち飲み山田屋新橋店,立ち飲み山田屋,山田屋", "新橋山田屋,山田屋", "", "カクウチ,KakuuchiBase", "鈴木酒店,鈴木", "渋谷のんべい横丁,渋谷のんべい,のんべい横丁", "田中,TheBarOx,Tanaka", "", "", "",
    ],
)
def _cores(df):
    return F.array_join(names.name_cores("name", "places", "extra"), ",")


@cases("romaji_place_cases", "ST09: stations in Latin letters.", "name string", [("Hamamatsuchō Station",), ("Eki",), ("Ōji-eki",), ("Akabane",), (None,)], ["hamamatsucho", None, None, "akabane", None])
def _romaji(df):
    return names.romaji_places("name")


@cases(
    "place_word_cases", "ST14, ST20, ST11: place words, station names, areas.", "area string, label string, ward string, station string, address string",
    [("烏森", None, "港区", "JR新橋駅・内幸町駅", "東京都港区新橋三丁目２-1"), ("", "下町", None, None, "大阪府1-2"), (None, None, None, "赤羽駅", "東京都北区赤羽1-2")],
    ["烏森,港区,新橋,内幸町,港区,新橋", "下町", "赤羽,北区,赤羽"],
)
def _place_words(df):
    return F.array_join(names.place_words(*map(F.col, ("area", "label", "ward", "station", "address"))), ",")


@cases(
    "normal_form_cases", "ST01-ST06: the four forms of a name.", "name string",
    [("ＡＢＣ　Bar",), ("ﾗｰﾒﾝ・「ゆ」",), ("Straße-1",), ("ヴィラ～２",)],
    ["abcbar|abcbar|abcbar|ABCBar", "らーめん「ゆ」|らめんゆ|らめん「ゆ」|ラーメンゆ", "straße-1|straße1|strasse1|Straße-1", "ゔぃら~2|ゔぃら2|ゔぃら~2|ヴィラ~2"],
)
def _forms(df):
    c = F.col("name")
    return F.concat_ws("|", text.norm_search(c), text.norm_name(c), text.norm_ledger(c), text.raw_core(c))


@cases(
    "match_score_cases", "J08: score and hit of a candidate's name.", "cores array<string>, name string",
    [(["やまだや", "やまだ"], "やまだや"), (["やまだや", "やまだ"], "さかばやまだ"), (["やまだや"], "まだや"), (["やまだや"], "まだ"), ([], "やまだや"), (["ばん"], "ばんび")],
    ["3 4", "2 3", "2 0", "0 0", "0 0", "2 2"],
)
def _score(df):
    m = resolve.match_score(F.col("cores"), F.col("name"))
    return F.concat_ws(" ", m["score"], m["hit"])


@cases(
    "best_match_cases", "J08: near the exact address a candidate wins by distance, elsewhere by its name.", "k string, sid int, score int, hit int, metres double, level string",
    [
        ("a", 1, 3, 3, 100.0, "town"), ("a", 2, 2, 5, 10.0, "town"), ("b", 1, 3, 5, 60.0, "number"), ("b", 2, 2, 5, 30.0, "number"), ("c", 1, 2, 3, 81.0, "number"), ("d", 1, 3, 3, 200.0, "block"),
        ("e", 1, 2, 0, 300.0, "town"),
    ],
    ["a 1", "b 2", "d 1", "e 1"],
)
def _best(df):
    best = resolve.best_match(df, "k", F.col("score"), F.col("metres"), F.col("hit"), resolve.is_close(F.col("level"), F.col("metres")), ["sid"], "sid")
    order = {"a": 0, "b": 1, "d": 2, "e": 3}
    place = F.coalesce(*[F.when(F.col("k") == k, F.lit(v)) for k, v in order.items()])
    return best.select(place.alias("n"), F.concat_ws(" ", "k", "sid").alias("out"))


@cases(
    "class_cases", "C05-C07: classes of ways, greens, railways, places, stations, businesses.", "a string, b string, c string, hub boolean, ops int",
    [("motorway_link", "park", "subway", True, 1), ("footway", "cemetery", "tram", False, 3), ("steps", "grass", "JR東日本", False, 2), ("raceway", "wood", "JR貨物", False, 1)],
    ["20/12 2 42 11/3", "28/16 4 43 12/2", "29/16 5 40 13/1", "- 3 41 13/0"],
)
def _classes(df):
    road, hub = rules.road_class(F.col("a"), F.lit(None).cast("string")), rules.station_rank(F.col("hub"), F.col("ops"))
    green = rules.green_class(F.when(F.col("b") == "park", F.col("b")), F.col("b"))
    pair = lambda s, x, y: F.concat_ws("/", s[x], s[y])
    return F.concat_ws(" ", F.coalesce(F.nullif(pair(road, "cls", "minz"), F.lit("")), F.lit("-")), green, rules.rail_class(F.col("c"), F.coalesce("c", F.lit(""))), pair(hub, "minz", "rank"))


@cases("place_rank_cases", "C07, F20: places and when their labels are drawn.", "p string, zoom double", [("city", 9.7), ("town", 10.6), ("suburb", 12.0), ("quarter", 20.0)], ["10/3 true", "11/2 false", "12/2 true", None])
def _places(df):
    r = rules.place_rank(F.col("p"))
    return F.when(r.isNotNull(), F.concat_ws(" ", F.concat_ws("/", r["minz"], r["rank"]), rules.label_visible(r["minz"], F.col("zoom")).cast("string")))


@cases("fallback_area_cases", "C04: area, nearest station, ward, city.", "a string, s string, w string", [("赤羽", "x", "y"), ("", "王子", "y"), (None, None, "北区"), (None, "", None)], ["赤羽", "王子", "北区", "東京"])
def _area(df):
    return rules.fallback_area(F.col("a"), F.col("s"), F.col("w"), "東京")


@cases("pin_precedence_cases", "P07: the operator's pin before a listing's.", "o array<double>, p array<double>", [([1.0, 2.0], [3.0, 4.0]), (None, [3.0, 4.0]), (None, None)], ["official 1.0", "listing 3.0", None])
def _pins(df):
    p = rules.pinned(F.col("o"), F.col("p"))
    return F.when(p.isNotNull(), F.concat_ws(" ", p["pinned"], p["at"][0]))


@cases(
    "enrichment_cases", "P10: limits, placeholders, dishes, whole links, fixes, states.", "v string, url string, status string",
    [("  a  b ", "https://a.example/x ", "closed"), ("不明", "https://a b", "gone"), ("x" * 90, "ftp://a", None)],
    [
        '{"catch":"a b","rules":["a b"],"menu":[{"n":"a b","p":"a b"}],"sources_add":["https://a.example/x"],"web":"https://a.example/x","fix":{"desc":"a b"},"status":"closed"}',
        '{"rules":[],"menu":[],"sources_add":[],"fix":{}}',
        f'{{"catch":"{"x" * 60}","rules":["{"x" * 80}"],"menu":[{{"n":"{"x" * 60}","p":"{"x" * 40}"}}],"sources_add":[],"fix":{{"desc":"{"x" * 90}"}}}}',
    ],
)
def _enrichment(df):
    v = F.col("v")
    made = rules.enrichment({"catch": (v, rules.SHORT)}, F.array(v), F.array(F.struct(v.alias("n"), v.alias("p"))), F.array("url"), {"web": F.col("url")}, F.create_map(F.lit("desc"), v), F.col("status"))
    return F.to_json(F.struct(*[c.alias(k) for k, c in made.items()]))


@cases("placeholder_cases", "N01: six words and the empty text say nothing; 0 and words of other operators do.", "a string, b string",
       [("不明", "x"), (" 未確認 ", "x"), ("要確認", "x"), ("—", "x"), ("-", "x"), ("－", "x"), ("", "x"), ("0", "x"), ("none", "x"), ("-", "")], ["B x"] * 7 + ["A 0", "A none", None])
def _known(df):
    f = merge.first_known((F.col("a"), "A"), (F.col("b"), "B"))
    return F.when(f.isNotNull(), F.concat_ws(" ", f["source"], f["value"]))


@cases("yen_range_cases", "ST18: one amount leaves an end open.", "v string", [("JPY 1,000 - JPY 1,999",), ("JPY 2,000",), ("- JPY 999",), ("free",)], ["1000 1999", "2000 -", "- 999", "- -"])
def _yen(df):
    r = text.yen_range(F.col("v"))
    return F.concat_ws(" ", *[F.coalesce(r[k].cast("string"), F.lit("-")) for k in ("low", "high")])


@cases("label_cases", "P15, D19, ST22, ST27: short labels, opening dates, hosts, clocks.", "a string, b string, url string, m int",
       [("三千円（税込）から", "2010.4.1", "https://www.insta.example/x", 1500), ("あ" * 20, "2011年", "https://shop.example", 65)], ["三千円から|2010年4月開店|Insta|翌1:00", "あ" * 16 + "|2011年|shop.example|1:05"])
def _labels(df):
    return F.concat_ws("|", text.short_label(F.col("a")), text.opening_text(F.col("b")), text.host_label(F.col("url"), {"insta.example": "Insta"}), hours.clock(F.col("m")))


@cases("map_cases", "N04, N11: defaults, lists extended, attributes kept.", "a map<string,array<int>>, b map<string,array<int>>", [({"x": [1]}, {"x": [2], "y": [3]}), (None, {"shop": [1]}), ({"name": [1]}, {})], ['x=1;y=3 x=1,2;y=3 0', 'shop=1  1', 'name=1 name=1 0'])
def _maps(df):
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), ";")
    a, b = F.col("a"), F.col("b")
    kept = F.size(rules.kept_tags(b))
    return F.concat_ws(" ", listed(merge.map_defaults(a, b)), F.coalesce(listed(merge.map_extended(a, b)), F.lit("")), kept.cast("string"))


@cases(
    "row_rule_cases", "Q01: all rules of a row.",
    "id string, name string, kind string, area string, social int, solo int, status string, lat double, lng double, yokocho string, known boolean, ward string, gsi string, geo string, near_m int, sources array<string>",
    [
        ("a", "n", "bar", "x", 3, 3, "open", 35.6, 139.5, None, None, "北区", "東京都北区", "gsi", 100, ["https://a"]), ("b", "", None, "x", 3, None, "open", 35.9, 139.5, "p", False, "北区", "東京都港区", "gsi", 1501, []),
        ("c", "n", "bar", "x", 3, 3, "closed", 35.6, 139.5, "p", True, "北区", "東京都港区", "manual", None, ["ftp://a", "https://b"]),
    ],
    [None, "missing kind,missing name,missing solo,outside,unknown parent;far from a station,no source,ward differs", "bad source;far from a station"],
)
def _row_rules(df):
    found = quality.violations(df, "n", quality.row_rules(F.coalesce("known", F.lit(False))))
    part = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.col("rule")))), ",")
    each = found.groupBy("n").agg(F.concat_ws(";", part("error"), part("note")).alias("out"))
    return df.select("n").join(each, "n", "left")


@cases("geocoder_cases", "S09, C01: the first hit of a stored answer.", "q string, body string",
       [("a", '[{"geometry":{"coordinates":[139.5,35.5]},"properties":{"title":"北区赤羽一丁目２番３号"}},{"geometry":{"coordinates":[1,2]}}]'), ("b", "[]"), ("c", "null"), ("d", '[{"geometry":{"coordinates":[139.0,35.0]},"properties":{"title":"北区赤羽一丁目"}}]')],
       ["35.5 139.5 号", "-", "-", "35.0 139.0 丁目"])
def _geocoder(df):
    g = files.geocoded(df, "n", "body")
    return g.select("n", F.coalesce(F.nullif(F.concat_ws(" ", "lat", "lng", "level"), F.lit("")), F.lit("-")).alias("out"))


@cases("ease_cases", "M12: straight and cubic steps.", "u double", [(0.0,), (0.25,), (0.5,), (0.75,), (1.0,)], ["0.0 0.0 0.0", "2.5 0.0625 0.578125", "5.0 0.5 0.875", "7.5 0.9375 0.984375", "10.0 1.0 1.0"])
def _ease(df):
    u = F.col("u")
    return F.concat_ws(" ", geo.lerp(F.lit(0.0), F.lit(10.0), u), geo.ease(u), geo.ease_out(u))


@cases("sheet_cases", "G21, J25: places on a sheet and back; members and others in view.", "x double, parent string", [(0.0, "s"), (30.0, None), (60.0, "s")], ["500 true member", "750 true other", "1000 true -"])
def _sheet(df):
    # at the equator, so that a unit has the same length everywhere; 120 units wide
    k = geo.metres_per_unit(F.lit(0.0))
    half = 40075016.686 / geo.WORLD * 60
    centre = geo.proj(F.lit(0.0), F.lit(0.0))
    p = geo.to_pixels(centre["x"] + F.col("x"), centre["y"], 0.0, 0.0, half, 1000)
    back = geo.from_pixels(p["px"], p["py"], 0.0, 0.0, half, 1000)
    px = F.round(p["px"], 3)
    flag = F.coalesce(resolve.on_sheet(px, F.round(p["py"], 3), 1000, F.lit("s"), F.col("parent")), F.lit("-"))
    return F.concat_ws(" ", px.cast("int"), ((F.abs(back["x"] - centre["x"] - F.col("x")) < 1e-6) & (k > 0)).cast("string"), flag)


_POINTS = "array<struct<x:double,y:double>>"


@cases("way_ring_cases", "G01, F16, G22: ways and rings, least areas, classes of elements.", f"p {_POINTS}, kind string, tags map<string,string>",
       [([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0)], "way", {"building": "yes"}), ([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "way", {"highway": "path"}),
        ([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], "node", {"amenity": "marketplace"}), ([None, (0.0, 0.0)], "node", {})],
       ["4 3 true building", "3 - - way", "5 4 false area", "1 - - poi"])
def _ways(df):
    p = F.col("p")
    ring = geometry.way_ring(p)
    some = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.concat_ws(" ", F.size(geometry.way_line(p)), some(F.when(ring.isNotNull(), F.size(ring))), some(F.when(ring.isNotNull(), geometry.large_enough(ring))), geometry.element_class(F.col("kind"), F.col("tags")))


_SQUARE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0)]]
_HOLE = [[(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 2.0)]]


@cases("relation_cases", "G02, G03: polygons of a relation's ways, holes in the ring that holds them.", f"o array<{_POINTS}>, i array<{_POINTS}>",
       [(_SQUARE, _HOLE), (_SQUARE[:1], []), ([], _HOLE), ([*_SQUARE, [None, (1.0, 1.0)]], []), (_SQUARE, [[(20.0, 20.0), (21.0, 20.0), (21.0, 21.0), (20.0, 20.0)]])], ["0:4,3", "-", "-", "-", "0:4"])
def _relations(df):
    made = df.select("n", geometry.relation_polygons(F.col("o"), F.col("i")).alias("p"))
    each = geometry.flattened(made, "p").select("n", F.concat_ws(":", "part", F.array_join(F.transform("p", lambda r: F.size(r)), ",")).alias("one"))
    return df.select("n").join(each.groupBy("n").agg(F.array_join(F.array_sort(F.collect_list("one")), " ").alias("one")), "n", "left").select("n", F.coalesce("one", F.lit("-")).alias("out"))


@cases("tile_cases", "G16, G11: the tile of a line and of an area, and its clip box.", f"p {_POINTS}",
       [([(0.0, 0.0), (90.0, 10.0), (210.0, 20.0)],), ([(-10.0, 0.0), (-10.0, 8.0), (-2.0, 8.0), (-2.0, 0.0)],)], ["1 0 75.0 -25.0 225.0 125.0 / 1 0", "-1 0 -125.0 -25.0 25.0 125.0 / -1 0"])
def _tiles(df):
    line, ring = tiles.assigned(df, "p", 100), tiles.assigned(df, "p", 100, area=True)
    both = line.join(ring.select("n", F.concat_ws(" ", "tx", "ty").alias("a")), "n")
    return both.select("n", F.concat_ws(" ", "tx", "ty", "x0", "y0", "x1", "y1", F.lit("/"), "a").alias("out"))


@cases("chain_cases", "G15: parts go on from the last one kept; short parts leave the place alone.", f"p array<{_POINTS}>",
       [([[(101.0, 201.0), (102.0, 202.0)], [(102.0, 202.0), (102.4, 202.2)], [(103.0, 202.0), (104.0, 202.0), (104.0, 205.0)]],), ([],)], ["101 201,102 202|103 202,104 202,104 205", ""])
def _chain(df):
    """Decoded again from the origin, each from the last point of the one before."""
    made = df.select("n", tiles.chain(F.col("p"), 2, F.lit(100), F.lit(200)).alias("t"))

    def decode(frames):
        for f in frames:
            out = []
            for n, parts in zip(f["n"], f["t"]):
                at, lines = (100, 200), []
                for part in parts:
                    points = tiles.decode_points(part, at)
                    at = points[-1]
                    lines.append(",".join(f"{x} {y}" for x, y in points))
                out.append((n, "|".join(lines)))
            yield _frame(out)

    return made.mapInPandas(decode, "n int, out string")


def _frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=["n", "out"])


@cases("tile_content_cases", "K04, A12: what a tile holds, by class; empty tiles have no row.", "layer string, tx int, cls int, feature string",
       [("f", 1, 28, "b"), ("f", 1, 24, "a"), ("l", 2, 0, "label"), ("p", 1, 0, "poi")], ["1 100 a,b  poi", "2 200  label "])
def _contents(df):
    own = lambda k: df.where(F.col("layer") == k).select("tx", F.lit(0).alias("ty"), "cls", F.col("n").alias("ord"), "feature", F.col("feature").alias("item"))
    made = tiles.tile_contents(own("f"), own("l"), own("p"), 100)
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return made.select((F.col("tx") - 1).alias("n"), F.concat_ws(" ", "tx", "ox", listed("f"), listed("l"), listed("p")).alias("out"))


@cases("label_id_cases", "J22: ids of labels in their order; unknown labels are left out.", "labels array<string>", [(["W2", "B1", "W1"],), (["X9"],)], ["w20 b10 w10", None])
def _label_ids(df):
    lookup = df.sparkSession.createDataFrame([(k, label, i) for k in (0, 1) for label, i in (("W1", "w10"), ("W2", "w20"), ("B1", "b10"))], "n int, label string, id string")
    found = resolve.labelled_ids(df, "n", "labels", lookup).select("n", F.array_join("ids", " ").alias("out"))
    return df.select("n").join(found, "n", "left")


@cases("outline_number_cases", "Q03: parts and square metres of an outline.", f"r array<{_POINTS}>, lat double",
       [([[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]], 60.0), ([], 0.0)], ["1 892", "0 0"])
def _outlines(df):
    # a unit is 0.59716 m at the equator, half of that at 60 degrees: 10,000 square units are 891.5 m2
    return quality.outline_numbers(df, "n", "r", "lat").select("n", F.concat_ws(" ", "parts", "m2").alias("out"))


@cases("centre_cases", "K08, A05: the mean place of each cell, in order.", "lat double, lng double", [(0.0071, 0.0001), (0.0001, 0.0002), (0.0003, 0.0004)], ["2.0E-4 3.0E-4", "0.0071 1.0E-4"])
def _centres(df):
    c = sinks.centres(df, F.col("lat"), F.col("lng"))
    place = F.when(F.col("lat") < 0.001, 0).otherwise(1)
    return c.select(place.alias("n"), F.concat_ws(" ", "lat", "lng").alias("out"))


@cases(
    "projection_cases", "P01-P07: raw research to the columns of a venue.",
    "id string, name string, name_kana string, kind string, social string, solo int, budget_min string, hiru boolean, english string, tags array<string>, sources array<string>, "
    "members array<string>, status string, pin array<double>, official_pin array<double>",
    [
        (" Bar_One! ", "　A ", "", "snack", "9", None, "1000", None, " ", [str(i) for i in range(14)], ["https://a", "b", None, "http://c"], [" x ", "", None], "shut", [35.5, 139.5], [35.25, 139.25]),
        (None, " ", "ka", None, "x", 0, "x", True, "yes", None, None, None, "closed", [35.5, 139.5], None),
        ("a-b", "n", None, "sakaba", "-1", 4, None, False, None, [], [], [], None, None, None),
    ],
    [
        '{"id":"bar-one","name":"A","kind":"bar","status":"uncertain","social":5,"solo":3,"budget_min":1000,"hiru":false,"english":false,"tags":["0","1","2","3","4","5","6","7","8","9","10","11"],'
        '"sources":["https://a","http://c"],"members":["x"],"lat":35.25,"lng":139.25,"pinned":"official"}',
        '{"id":"","kana":"ka","kind":"bar","status":"closed","social":3,"solo":1,"hiru":true,"english":true,"tags":[],"sources":[],"members":[],"lat":35.5,"lng":139.5,"pinned":"listing"}',
        '{"id":"a-b","name":"n","kind":"sakaba","status":"uncertain","social":1,"solo":4,"hiru":false,"english":false,"tags":[],"sources":[],"members":[]}',
    ],
)
def _projection(df):
    # the projection keeps no other column, so that the number of the case goes along as a text that it keeps
    made = research.projected(df.withColumn("checked", F.col("n").cast("string")))
    return made.select(F.col("checked").cast("int").alias("n"), F.to_json(F.struct(*[c for c in made.columns if c != "checked"])).alias("out"))


_WEEK = "map<string,array<struct<o:int,c:int,lo:int>>>"


@cases(
    "info_merge_cases", "J01, N01-N03, C11: research, two listings and reviews into one row of facts.",
    f"hours string, closed string, kind string, payment string, status string, a struct<week:{_WEEK},hours:string,pay:string,cash_only:boolean,seats:int,score:double,url:string,web:string>, "
    f"b struct<week:{_WEEK},hours:string,closed:string,pay:string,cash_only:boolean,seats:int,charge:string>, "
    "e struct<charge:string,web:string,insta:string,catch:string,rules:array<string>,menu:array<struct<n:string,p:string>>,status:string,fix:map<string,string>,sources_add:array<string>>",
    [
        (
            "17:00〜23:00", "日", "bar", "現金のみ", "open", ({"mon": [(1020, 1380, None)]}, "月 17:00–23:00", "不明", None, 8, 0.0, "https://t", "ftp://w"),
            ({"tue": [(60, 90, None)]}, "x", "火", "カード", False, 9, "300円"),
            ("お通し", "https://e", "https://i", "c", ["", "r"], [("", "1"), ("n", "2")], "closed", {"desc": "d", "other": "o", "talk": ""}, ["x", "https://s"]),
        ),
        ("17:00〜23:00", "日", "bar", "現金のみ", "closed", None, None, None),
        ("17:00〜23:00（2019年時点）", None, "bar", "", "open", None, ({}, "y", "", "—", None, None, None), (None, None, "x", "", [], [], "gone", None, [])),
        ("17:00〜23:00", None, "yokocho", None, None, None, ({"tue": [(60, 90, 80)]}, "火 1:00–1:30", None, None, True, None, None), None),
        (None, None, None, None, None, None, None, None),
    ],
    [
        '{"week":{"mon":[{"o":1020,"c":1380}]},"hours":"月 17:00–23:00","hours_research":"17:00〜23:00","closed":"日","pay":"カード","seats":8,"charge":"300円","cash_only":false,'
        '"links":{"tabelog":"https://t","insta":"https://i"},"catch":"c","rules":["r"],"menu":[{"n":"n","p":"2"}],"status_note":"closed","fix_desc":"d","sources_add":["https://s"],'
        '"src":{"hours":"食べログ","closed":"調査","pay":"ホットペッパー","seats":"食べログ","charge":"ホットペッパー","catch":"口コミ・記事"}}',
        '{"week":{' + _all(WEEK[:6], _range(1020, 1380)) + "," + _all(["sun"], "") + "," + _all(["hol"], _range(1020, 1380))
        + '},"week_from_text":true,"hours":"17:00〜23:00","closed":"日","pay":"現金のみ","cash_only":true,"src":{"hours":"調査","closed":"調査","pay":"調査"}}',
        '{"hours":"17:00〜23:00（2019年時点）","src":{"hours":"調査"}}',
        '{"week":{"tue":[{"o":60,"c":90,"lo":80}]},"hours":"火 1:00–1:30","hours_research":"17:00〜23:00","cash_only":true,"src":{"hours":"ホットペッパー"}}',
        '{"src":{}}',
    ],
)
def _info_merge(df):
    side = lambda c: df.where(F.col(c).isNotNull()).select("n", f"{c}.*")
    info = research.merged_info(df.drop("a", "b", "e"), side("a"), side("b"), side("e"), "n")
    return info.select("n", F.to_json(F.struct(*[c for c in info.columns if c != "n"])).alias("out"))


@cases("outline_position_cases", "C02: a pin that lies off its outline moves to the outline's centre.", "at string, gap double, centre string",
       [("p", 8.0, "c"), ("p", 8.5, "c"), ("p", None, None), (None, 9.0, "c")], ["p gsi", "c outline", "p gsi", None])
def _outline_position(df):
    at = F.when(F.col("at").isNotNull(), F.struct("at", F.lit("gsi").alias("geo")))
    moved = rules.outline_position(at, F.col("gap"), F.col("centre"))
    return F.when(moved.isNotNull(), F.concat_ws(" ", moved["at"], moved["geo"]))


@cases("keyframe_cases", "J23, M12: between two keyframes, at cuts, outside the first and the last, without any.", "k string, t double",
       [("a", 0.0), ("a", 1.0), ("a", 3.0), ("a", 4.0), ("a", 5.0), ("a", 9.0), ("b", 1.0), ("a", None), ("a", 0.5)], ["10", "15", "17.5", "100", "150", "200", None, None, "12.5"])
def _keyframes(df):
    frames = df.sparkSession.createDataFrame([("a", 0.0, 0, 10.0), ("a", 2.0, 1, 20.0), ("a", 2.0, 2, 15.0), ("a", 4.0, 3, 20.0), ("a", 4.0, 4, 100.0), ("a", 6.0, 5, 200.0)], "k string, t double, o int, v double")
    found = windows.interpolated(df, frames, "k", "t", ["v"], "o")
    return found.select("n", F.regexp_replace(F.col("v").cast("string"), r"\.0$", "").alias("out"))
