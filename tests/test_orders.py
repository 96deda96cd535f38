"""Choices and scans that depend on order, against going through the rows one after the other."""

import math
import random

import pytest

from venuelake.operators import greedy, windows


@pytest.mark.parametrize("keys", [30, 400])
def test_greedy_dedup(spark, keys):
    rng = random.Random(keys)
    rows = [(i, *(None if rng.random() < 0.2 else f"k{rng.randrange(keys)}" for _ in range(3)), "same") for i in range(300)]
    rows += [(400 + i, "hot", f"u{i}", None, "x") for i in range(100)] + [(None, "hot", None, None, "x"), (900, None, None, None, "x"), (901, "o", None, None, "x")]
    seen, want = set(), []
    for o, *ks, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        mine = {k for k in ks if k is not None}
        if not mine & seen:
            seen |= mine
            want.append(o)
    df = spark.createDataFrame(rows, "o long, a string, b string, c string, k string").repartition(3)
    got = greedy.greedy_dedup(df, "o", ["a", "b", "c"])
    assert sorted(r.o for r in got.collect()) == want and got.columns == df.columns
    assert greedy.greedy_dedup(df.limit(0), "o", ["a", "b"]).count() == 0


def test_clusters(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([True, False, None])) for i in range(250)]
    rows += [(300 + i, "dense", rng.uniform(0, 0.5), 3.0, False) for i in range(100)] + [(500, None, 0.0, 0.0, False), (501, "a", None, 0.0, False), (502, "edge", 0.0, 0.0, False), (503, "edge", 10.0, 0.0, False)]
    clusters = {}
    for o, name, x, y, below in rows:
        if name is None or x is None:
            continue
        own = clusters.setdefault(name, [])
        for c in own:
            if math.hypot(c[0][1] - x, c[0][2] - y) < 10:
                c.append((o, x, y, below))
                break
        else:
            own.append([(o, x, y, below)])
    want = {}
    for name, own in clusters.items():
        for c in own:
            top = [m for m in c if not m[3]] or c
            want[name, c[0][0]] = (len(c), round(sum(m[1] for m in top) / len(top), 9), round(sum(m[2] for m in top) / len(top), 9))
    df = spark.createDataFrame(rows, "o long, name string, x double, y double, below boolean").repartition(3)
    got = {(r["name"], r.cluster): (r.n, round(r.cx, 9), round(r.cy, 9)) for r in greedy.cluster_centres(df, "name", "o", "x", "y", 10.0, "below").collect()}
    assert got == want
    assert greedy.cluster_centres(df.limit(0), "name", "o", "x", "y", 10.0).count() == 0


def test_selected_percentile(spark):
    rng = random.Random(1)
    values = {"a": [rng.choice([1.5, -2.0, 1e300, 5e-324, 7.0]) for _ in range(200)], "b": [rng.gauss(0, 1) for _ in range(999)], "c": [3.0], None: [1.0, 2.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: (r.n, r.p0, r.p50, r.p99) for r in windows.selected_percentile(df, "v", [0.0, 0.5, 0.99], "k", 8).collect()}
    assert got == {k: (len(vs), *(sorted(vs)[int(len(vs) * s)] for s in (0.0, 0.5, 0.99))) for k, vs in values.items()}
    everything = sorted(v for vs in values.values() for v in vs)
    assert tuple(windows.selected_percentile(df, "v", [0.9]).first()) == (len(everything), everything[int(len(everything) * 0.9)])


def test_one_key_in_many_tasks(spark):
    """The segmented scans give what the windows give, and no task of a scan holds the whole key."""
    rng = random.Random(2)
    rows = [("hot" if i % 10 else None, rng.randrange(500), i, rng.choice([None, i * 1.0]), "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, ts long, id long, v double, more string")
    left, right = df.where("id % 3 = 0").select("k", "ts", "id", "more"), df.where("id % 3 <> 0").selectExpr("k", "ts", "id AS key_id", "v")
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(windows.as_of_segmented(left, right, "k", "ts", ["key_id", "v"], "key_id", 9)) == key(windows.as_of(left, right, "k", "ts", ["key_id", "v"], "key_id"))
    a, b = windows.null_gap_runs_segmented(df, "k", ["ts", "id"], "v", 9), windows.null_gap_runs(df, "k", ["ts", "id"], "v")
    assert key(a.select(*b.columns)) == key(b)
    parts = windows.segmented(df, "k", ["ts", "id"], 9).groupBy("_part").count().collect()
    assert len(parts) >= 8 and max(r["count"] for r in parts) < 1000
    assert windows.as_of_segmented(left.limit(0), right, "k", "ts", ["v"], "key_id", 4).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 1000, "x") for i in range(1000)], "v long, _i string").drop("_i")
    assert [(r.v, r.n) for r in windows.numbered(df, ["v"], "n", 7).orderBy("v").collect()] == [(v, v + 1) for v in range(1000)]
    assert windows.numbered(df.limit(0), ["v"], "n").count() == 0


def test_centres_do_not_depend_on_the_order(spark):
    """The mean of the members' numbers as written, not of a sum rounded member by member."""
    from decimal import Decimal

    rng = random.Random(5)
    rows = [(i, "a", rng.randrange(1, 3000) / 100, rng.randrange(1, 3000) / 100) for i in range(2000)]
    want = [float(sum(Decimal(str(r[k])) for r in rows)) / len(rows) for k in (2, 3)]
    for n in (1, 7):
        df = spark.createDataFrame(rows, "o long, name string, x double, y double").repartition(n)
        got = greedy.cluster_centres(df, "name", "o", "x", "y", 100.0).collect()
        assert [(r.cluster, r.n, r.cx, r.cy) for r in got] == [(0, 2000, *want)]
