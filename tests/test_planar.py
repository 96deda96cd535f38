"""Chains, dissolves, buffers, borders and coasts against formulae and unit cells."""

import random

import pytest
from pyspark.sql import functions as F

from venuelake.operators import chains, planar

POINTS = "array<struct<x:double,y:double>>"


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


def square(x, y, s):
    return ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))


def test_chain_of_100_000(spark):
    """One chain through rows in any order, and two rings."""
    n = 100_000
    chain = spark.range(n).select(F.col("id"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next"))
    ring_ids = spark.range(10).select((F.col("id") + n).alias("id"), (F.pmod(F.col("id") + 3, F.lit(10)) + n).alias("next"))
    alone = spark.range(n + 10, n + 11).select("id", F.col("id").alias("next"))
    found = chains.ranked(chain.unionByName(ring_ids).unionByName(alone).repartition(4)).cache()
    assert found.where(f"id < {n}").where(f"chain = {n - 1} AND steps = {n - 1} - id AND NOT ring").count() == n
    assert sorted((r.id - n, r.chain - n, r.steps, r.ring) for r in found.where(f"id >= {n}").collect())[:3] == [(0, 0, 9, True), (1, 0, 2, True), (2, 0, 5, True)]
    assert found.where(f"id = {n + 10}").first().ring
    assert chains.ranked(chain.limit(0)).count() == 0


def test_merged_lines(spark):
    rows = [
        ("a", ring((0, 0), (1, 0))), ("a", ring((2, 0), (1, 0))), ("a", ring((2, 0), (3, 0), (4, 0))), ("a", ring((4, 0), (5, 0))), ("a", ring((4, 0), (4, 1))),
        ("b", ring((0, 0), (1, 0), (1, 1))), ("b", ring((1, 1), (0, 0))), ("b", ring((9, 9), (8, 9), (9, 9))), ("b", ring((0, 0))), (None, ring((0, 0), (1, 0))), ("a", ring((1, 0), (0, 0))),
    ]
    df = spark.createDataFrame(rows, f"kind string, points {POINTS}").repartition(3)
    got = chains.whole_lines(chains.merged_lines(df, ["kind"], "points"), ["kind"]).collect()
    lines = sorted((r.kind or "", r.ring, len(r.points), sorted({(p.x, p.y) for p in r.points})[0]) for r in got)
    assert lines == [("", False, 2, (0, 0)), ("a", False, 2, (4, 0)), ("a", False, 2, (4, 0)), ("a", False, 5, (0, 0)), ("b", False, 3, (8, 9)), ("b", True, 4, (0, 0))]
    long = next(r for r in got if len(r.points) == 5)
    assert [p.x for p in long.points] in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0])


@pytest.mark.parametrize("cell", [3, 16])
def test_dissolve(spark, cell):
    rng = random.Random(cell)
    groups = {g: [(rng.randrange(25), rng.randrange(25), rng.randint(1, 7)) for _ in range(n)] for g, n in ((1, 1), (2, 25), (3, 8))}
    groups[None] = [(0, 0, 5), (5, 0, 5), (0, 0, 5), (1, 1, 2), (12, 12, 1), (13, 13, 1)]
    rows = [(g, square(*s) if k % 2 else square(*s)[::-1], "x") for g, own in groups.items() for k, s in enumerate(own)]
    df = spark.createDataFrame([*rows, (4, ring((0, 0), (1, 1)), "x"), (4, None, "x")], f"g int, ring {POINTS}, x1 string").repartition(3)
    edges = planar.stored(planar.dissolved(df, ["g"], "ring", cell), "test")
    area = {r.g: (round(r.area, 3), round(r.perimeter, 3)) for r in planar.area(edges, ["g"]).collect()}
    found = planar.ring_areas(planar.rings(edges, ["g"]), ["g"]).collect()
    for g, own in groups.items():
        cells = {(x + i, y + j) for x, y, s in own for i in range(s) for j in range(s)}
        border = sum((x + a, y + b) not in cells for x, y in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert area[g] == (len(cells), border)
        corners = 0
        for x in range(-1, 40):
            for y in range(-1, 40):
                on = [(x + i, y + j) in cells for i in (0, 1) for j in (0, 1)]
                corners += {1: 1, 3: -1}.get(sum(on), 2 if on in ([True, False, False, True], [False, True, True, False]) else 0)
        assert sum(1 if r.area > 0 else -1 for r in found if r.g == g) == corners // 4
    assert 4 not in area


def test_dissolve_slanted(spark):
    """Two crossing triangles, and a hole that a frame of bars leaves; areas by formula."""
    rows = [(1, ring((0, 0), (40, 0), (20, 40))), (1, ring((0, 30), (20, -10), (40, 30))), (2, ring((0, 0), (30, 0), (30, 5), (0, 5))), (2, ring((0, 0), (5, 0), (5, 30), (0, 30))), (2, ring((25, 0), (30, 0), (30, 30), (25, 30))), (2, ring((0, 25), (30, 25), (30, 30), (0, 30)))]
    edges = planar.stored(planar.dissolved(spark.createDataFrame(rows, f"g int, ring {POINTS}"), ["g"], "ring", 7), "test")
    areas = {r.g: r.area for r in planar.area(edges, ["g"]).collect()}

    def inside(x, y):
        a = y >= 0 and 2 * x >= y and 2 * (40 - x) >= y
        return a or (y <= 30 and 2 * x >= 30 - y and 2 * (40 - x) >= 30 - y)

    step = 0.05
    estimate = sum(inside((i + 0.5) * step, -10 + (j + 0.5) * step) for i in range(800) for j in range(1000)) * step * step
    assert abs(areas[1] - estimate) < 2 and abs(areas[2] - 500) < 1e-6
    sizes = sorted(round(r.area) for r in planar.ring_areas(planar.rings(edges, ["g"]), ["g"]).where("g = 2").collect())
    assert sizes == [-400, 900]


def test_difference_and_intersection(spark):
    df = spark.createDataFrame([(1, square(0, 0, 10), 0), (1, square(5, 5, 10), 1)], f"g int, ring {POINTS}, layer int")
    edges = planar.ring_edges(df.where("layer = 0"), ["g"], "ring").unionByName(planar.ring_edges(df.where("layer = 1"), ["g"], "ring", layer=1))
    size = lambda keep: planar.area(planar.overlay(edges, ["g"], 4, keep), ["g"]).first().area
    assert abs(size("difference") - 75) < 1e-6 and abs(size("both") - 25) < 1e-6 and abs(size("union") - 100) < 1e-6


def test_buffers(spark):
    """A closing fills a slot that is narrower than twice the way out; a sharp corner's mitre is cut off."""
    comb = ring((0, 0), (30, 0), (30, 20), (17, 20), (17, 5), (13, 5), (13, 20), (0, 20))
    df = spark.createDataFrame([(1, comb)], f"id int, ring {POINTS}")
    out = planar.buffered(planar.dissolved(df, ["id"], "ring", 16), ["id"], 3.0, 16)
    back = planar.area(planar.buffered(out, ["id"], 3.0, 16, inwards=True), ["id"]).first()
    assert abs(back.area - 600) < 1e-6
    spike = spark.createDataFrame([(1, ring((0, 0), (1000, 0), (0, 1)))], f"id int, points {POINTS}")
    made = planar.area(planar.dissolved(planar.line_strips(spike, ["id"], "points", 10.0), ["id"], "ring", 256), ["id"]).first()
    assert made.area < 2 * 20 * 1000


def test_places(spark):
    rows = [
        ("p", [*square(0, 0, 10), (0.0, 0.0)], True, False, False), ("p", [*square(5, 5, 10), (5.0, 5.0)], False, True, False), ("p", [*square(50, 50, 3), (50.0, 50.0)], True, False, False),
        ("p", ring((0, 0), (9, 9)), False, False, True), ("q", ring((0, 0), (9, 9), (12, 9)), False, False, True), ("q", ring((0, 0), (5, 0)), True, False, False), ("r", [*square(0, 0, 9), (0.0, 0.0)], False, False, False),
    ]
    df = spark.createDataFrame(rows, f"spot string, points {POINTS}, area boolean, itself boolean, street boolean")
    areas, lines = planar.place_shapes(df, "spot", 16)
    assert [(r.spot, round(r.area)) for r in areas.collect()] == [("p", 175)]  # the small one is dropped
    assert [(r.spot, len(r.points)) for r in lines.collect()] == [("q", 3)]


def test_coast_without_a_coast_and_with_an_island(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    island = spark.createDataFrame([([*square(2, 2, 3), (2.0, 2.0)],)], f"points {POINTS}")
    size = lambda df, land: planar.area(planar.coast_areas(df, "points", box, land), []).first()
    assert abs(size(island, True).area - 9) < 1e-9
    # the sea around an island alone has the island's border only, on its other side
    assert abs(size(island, False).area + 9) < 1e-9
    crossing = spark.createDataFrame([(ring((12, 4), (-2, 4)),), (ring((-2, 8), (12, 8)),)], f"points {POINTS}")
    assert abs(size(crossing, True).area - (40 + 20)) < 1e-9 and abs(size(crossing, False).area - 40) < 1e-9


def test_simplified_borders_stay_apart(spark, tmp_path):
    """A block between two nations: the borders around it would both become its diagonal."""
    from venuelake.plans import catalog, shapes

    assert shapes
    rows = [(k, 1 + (k % 30 + k // 30 > 16)) for k in range(90)]  # two nations with a border in steps
    rows = [(k, 3 if k == 30 + 15 else n) for k, n in rows]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert tuple(catalog.QUERIES["shared_borders"](spark, str(tmp_path)).first()) == (32 * 5, 0, True)


def test_corners_are_met_where_they_lie(spark):
    """Edges of any length on one line; 60,000 on it took 3.6 billion comparisons before, too many for the time."""
    import random
    import time

    rng = random.Random(3)
    edges = []
    for _ in range(300):
        a, b, on = rng.randrange(-60, 60) / 4, rng.choice([0.25, 0.75, 1, 3, 4, 8, 20, 64.5]), rng.randrange(3)
        ends = [(a, float(on)), (a + b, float(on))] if rng.random() < 0.5 else [(float(on), a), (float(on), a + b)]
        edges.append((rng.randrange(4), *(ends[0] + ends[1] if rng.random() < 0.5 else ends[1] + ends[0])))
    corners = {p for e in edges for p in (e[1:3], e[3:5])}
    want = []
    for g, x1, y1, x2, y2 in edges:
        on = sorted(p for p in corners if min(x1, x2) <= p[0] <= max(x1, x2) and min(y1, y2) <= p[1] <= max(y1, y2))
        on = on if (x1, y1) < (x2, y2) else on[::-1]
        want += [(g, *p, *q) for p, q in zip(on, on[1:])]
    schema = "g int, x1 double, y1 double, x2 double, y2 double"
    assert sorted(map(tuple, planar.cut_alike(spark.createDataFrame(edges, schema), ["g"]).collect())) == sorted(want)
    assert planar.cut_alike(spark.createDataFrame([], schema), ["g"]).count() == 0
    row = spark.range(60_000).selectExpr("1 AS g", "CAST(id AS DOUBLE) AS x1", "0D AS y1", "CAST(id + 1 AS DOUBLE) AS x2", "0D AS y2")
    began = time.time()
    assert planar.cut_alike(row, ["g"]).count() == 60_000 and time.time() - began < 25


def test_finished_arcs_leave_the_rounds(spark, monkeypatch):
    """Many short chains and rings beside a long chain: each round writes what it still needs, and the places stay right."""
    sizes, real = [], chains.stored

    def counted(df, label):
        out = real(df, label)
        sizes.extend([out.count()] if label == "doubled" else [])
        return out

    monkeypatch.setattr(chains, "stored", counted)
    short = [(10_000 + 3 * i + k, 10_000 + 3 * i + k + 1 if k < 2 else None) for i in range(1000) for k in range(3)]
    long = [(i, i + 1 if i < 199 else None) for i in range(200)]
    ring = [(500 + i, 500 + (i + 1) % 7) for i in range(7)]
    got = {r.id: (r.chain, r.steps, r.ring) for r in chains.ranked(spark.createDataFrame(short + long + ring, "id long, next long")).collect()}
    want = {i: (199, 199 - i, False) for i, _ in long} | {i: (500, 506 - i, True) for i, _ in ring}
    assert got == want | {10_000 + 3 * i + k: (10_000 + 3 * i + 2, 2 - k, False) for i in range(1000) for k in range(3)}
    # all rows until the short chains are done, then the long one's and the rings' only
    assert sum(n > 1000 for n in sizes) <= 3


def test_equal_shapes_are_buffered_once(spark, tmp_path, monkeypatch):
    from venuelake.operators import planar
    from venuelake.plans import catalog, shapes

    assert shapes
    seen, strips = [], planar.line_strips
    monkeypatch.setattr(planar, "line_strips", lambda df, *a: seen.append(df.count()) or strips(df, *a))
    spark.range(5).selectExpr("explode(array(id, id + 2040, id + 4080)) AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.id: (r.strip, r.closed) for r in catalog.QUERIES["buffers"](spark, str(tmp_path)).collect()}
    size = lambda k: (20 + k % 40, 20 + k % 17, 1 + k % 3)
    assert seen == [5] and got == {k: (2 * w * (a + b) * 1000, (a + 10 - 2 * w) * (b + 10 - 2 * w) * 1000) for i in range(5) for k in (i, i + 2040, i + 4080) for a, b, w in [size(k)]}
