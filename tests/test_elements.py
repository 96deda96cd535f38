import json

from pyspark.sql import functions as F

from venuelake.plans import site
from venuelake.sources import elements as el


def test_responses_and_filters(spark, tmp_path):
    node = {"type": "node", "id": 1, "lat": 35.5, "lon": 139.5, "tags": {"amenity": "bar", "name": "x"}}
    way = {"type": "way", "id": 2, "center": {"lat": 35.0, "lon": 139.0}, "tags": {"railway": "station", "name": "東口改札"}}
    area = {"type": "relation", "id": 3, "bounds": {"minlat": 1.0, "minlon": 2.0, "maxlat": 3.0, "maxlon": 4.0}, "tags": {"tunnel": "covered", "subway": "yes"}}
    bare = {"type": "node", "id": 4}
    (tmp_path / "a.json").write_text(json.dumps({"elements": [node, way]}))
    (tmp_path / "b.json").write_text(json.dumps({"elements": [way, area, bare]}))
    (tmp_path / "c.json").write_text(json.dumps({"elements": [{"type": "node", "id": 9}], "remark": "runtime Error: timed out"}))
    (tmp_path / "d.json").write_text("not json")
    path = f"{tmp_path}/*.json"
    assert sorted(r.file[-6:] for r in el.responses(spark, path).where("failed").collect()) == ["c.json", "d.json"]
    found = el.elements(spark, path)
    got = {r.id: r for r in found.select("id", el.place().alias("p"), el.is_tunnel(F.col("tags")).alias("t"), el.is_station(F.col("tags"), F.col("tags")["name"]).alias("s"), el.is_business(F.col("tags"), F.lit(False)).alias("b")).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert [tuple(got[i].p) for i in (1, 2, 3)] == [(35.5, 139.5), (35.0, 139.0), (2.0, 3.0)] and got[4].p is None
    assert [(got[i].t, got[i].s, got[i].b) for i in (1, 2, 3, 4)] == [(False, False, True), (False, False, False), (True, True, False), (False, False, False)]
    keep = el.tagged(F.col("tags"), {"amenity": ["bar", "pub"]}, {"name": "^x"}, ("name",), ("shop",))
    assert [r.id for r in found.where(keep).collect()] == [1]


def test_published_without_facts(spark):
    v = spark.createDataFrame([(1, "a。b", ["u"]), (2, "", [])], "id long, desc string, sources array<string>")
    none = spark.createDataFrame([], "id long, fix_desc string, sources_add array<string>, catch string")
    got = {r.id: r for r in site.published(v, none).collect()}
    assert (got[1].desc, got[1].sources, got[1].catch) == ("a。b", ["u"], None) and got[2].desc is None and got[2].sources is None
    short = {r.id: r.desc for r in site.index(site.published(v, none), ["id"]).collect()}
    assert short == {1: "a。", 2: None}
