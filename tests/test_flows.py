"""The connector's pushed filters, and the running open set with late rows and a restart."""

import datetime
import json

from pyspark.sql import functions as F

from venuelake.session import ship_package
from venuelake.sources import connector
from venuelake.streaming import open_set


def test_pushed_filters(spark, tmp_path):
    ship_package(spark)
    rows = [{"type": "node", "id": i, "lat": i * 1.0, "lon": -i * 1.0, "tags": {"shop": "wine" if i % 2 else "books"}} for i in range(40)]
    rows += [{"type": "way", "id": 100, "center": {"lat": 3.0, "lon": 3.0}}, {"type": "relation", "id": 101, "tags": None}]
    for k in range(4):
        (tmp_path / f"part{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k::4]) + "\n")
    (tmp_path / "whole.json").write_text(json.dumps({"elements": [{"type": "node", "id": 200, "lat": 5.5, "lon": 0.0, "tags": {"shop": "wine"}}]}))
    (tmp_path / "_ignored.json").write_text("{")
    load = lambda: connector.load(spark, f"file://{tmp_path}", ["shop"])
    assert load().count() == 43 and load().where("id = 100").first().lat == 3.0
    box = load().where("lat >= 5 AND lat < 9 AND tag_shop = 'wine'")
    assert sorted(r.id for r in box.collect()) == [5, 7, 200]
    plan = box._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "BatchScan" in line)
    assert "Filter" not in plan.replace(scan, "") and "tag_shop" in scan
    assert sorted(r.id for r in load().where("tag_shop IS NULL OR id IN (1, 2)").collect()) == [1, 2, 100, 101]
    assert load().where(F.length("tag_shop") == 5).where("kind = 'node'").count() == 20


def test_reader_checks_only_what_it_knows():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

    reader = connector.StoredReader("x", ["shop"])
    left = list(reader.pushFilters([EqualTo(("tag_shop",), "a"), StringContains(("tag_shop",), "a"), IsNotNull(("id",)), EqualTo(("other",), 1), In(("kind",), ("node",)), GreaterThan(("lat",), 1.0)]))
    assert [type(f) for f in left] == [StringContains, EqualTo] and len(reader.pushed) == 4
    assert not connector.holds(GreaterThan(("lat",), 1.0), None) and connector.holds(In(("kind",), ("node",)), "node")


def expected(events, hours, until):
    """Every opening and closing after a venue's first event, up to a time."""
    out = []
    for v, (o, c, off) in hours.items():
        mine = [t for w, t in events if w == v]
        if not mine:
            continue
        day = min(mine).replace(hour=0, minute=0, second=0, microsecond=0) - datetime.timedelta(days=2)
        while day <= until:
            if day.weekday() != off:
                for m, opens in ((o, True), (c, False)):
                    at = day + datetime.timedelta(minutes=m)
                    if min(mine) < at <= until:
                        out.append((v, at, opens))
            day += datetime.timedelta(days=1)
    return sorted(out)


def test_running_open_set_restarts(spark, tmp_path):
    """Two runs on one checkpoint; the second brings a late row that starts a venue earlier."""
    open_set.use_rocksdb(spark)
    hours = {1: (600, 1320, 6), 2: (1080, 1560, 0), 3: (0, 60, 2)}
    table = spark.createDataFrame([(v, *h) for v, h in hours.items()], "venue long, o int, c int, off int")
    at = lambda d, h, m=0: datetime.datetime(2024, 1, d, h, m)
    first = [(1, at(1, 9)), (2, at(1, 20)), (1, at(2, 12)), (2, at(3, 1, 30))]
    second = [(3, at(3, 1, 10)), (2, at(3, 1, 20)), (1, at(4, 23)), (3, at(6, 12))]
    source, out, state = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    told = []
    for step, until in ((first, at(3, 0, 30)), (second, at(6, 11))):
        spark.createDataFrame(step, "venue long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema("venue long, ts timestamp").parquet(source)
        stream = open_set.changes(events, table, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        stream.awaitTermination()
        told += step
        got = sorted((r.venue, r.at, r.open) for r in spark.read.schema(open_set.CHANGES).parquet(out).collect())
        assert got == expected(told, hours, until)
