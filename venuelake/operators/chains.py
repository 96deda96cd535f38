"""Chains across rows: list ranking by pointer doubling, and merging of lines at shared ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import released, stored


def ranked(arcs: DataFrame, places: bool = True) -> DataFrame:
    """(id, chain, steps, ring) of ``arcs``(id, next): whole numbers, each id once and named as ``next`` at most once.

    ``steps`` counts the arcs that follow in the chain, whose name is its last arc. Arcs that run in a ring are cut in
    front of the smallest, which names the ring; without ``places`` the steps of rings are null. Each round joins every arc with the one twice as far along as in the
    round before, so a chain of n arcs takes log2(n) rounds, and no row ever holds a chain.
    """
    given = stored(arcs.select("id", "next"), "arcs")
    found = _doubled(given)
    rings = found.where("next is not null").select("id", "low")
    if rings.isEmpty():
        return found.select("id", "chain", "steps", F.lit(False).alias("ring"))
    paths = found.where("next is null").select("id", "chain", "steps", F.lit(False).alias("ring"))
    if not places:
        return paths.unionByName(rings.select("id", F.col("low").alias("chain"), F.lit(None).cast("long").alias("steps"), F.lit(True).alias("ring")))
    rings = stored(rings, "rings")
    cut = given.join(rings, "id").select("id", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next"))
    open_rings = _doubled(stored(cut, "cut")).select("id", "steps").join(rings, "id")
    return paths.unionByName(open_rings.select("id", F.col("low").alias("chain"), "steps", F.lit(True).alias("ring")))


def _doubled(arcs: DataFrame) -> DataFrame:
    """(id, next, chain, steps, low): next is null where the end was found; elsewhere low is the least id of the ring.

    An arc that found its end and is no other's next will not be one later, when all reach further. Such arcs leave the
    rounds as soon as the open ones are few beside them, so that a few long chains don't carry all short ones along.
    """
    ends = F.col("next").isNull()
    current = stored(arcs.select("id", "next", F.when(ends, F.col("id")).alias("chain"), F.when(ends, 0).otherwise(1).cast("long").alias("steps"), F.col("id").alias("low")), "doubled")
    live, carried = current.agg(F.count("next"), F.count(F.lit(1))).first()
    done = []
    while live:
        if carried > 4 * live:
            asked = current.where("next is not null").select(F.col("next").alias("_asked"))
            found = current.where(ends)
            done.append(stored(found.join(asked, F.col("id") == F.col("_asked"), "left_anti"), "done"))
            before, current = current, stored(current.where("next is not null").unionByName(found.join(asked, F.col("id") == F.col("_asked"), "left_semi")), "doubled")
            released(before)
        there = current.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("chain").alias("_chain"), F.col("steps").alias("_steps"), F.col("low").alias("_low"))
        further = current.where("next is not null").join(there, F.col("next") == F.col("_id")).select(
            "id", F.col("_next").alias("next"), F.col("_chain").alias("chain"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")
        )
        before, current = current, stored(current.where("next is null").withColumn("moved", F.lit(False)).unionByName(further), "doubled")
        released(before)
        had, (live, moved, carried) = live, current.agg(F.count("next"), F.count_if(F.col("moved")), F.count(F.lit(1))).first()
        current = _renamed(current)
        if live == had and not moved:
            # an arc of a chain that goes on would have reached the end, and a ring that was not gone around a smaller id
            break
    for part in done:
        current = current.unionByName(part)
    return current


def _renamed(current: DataFrame) -> DataFrame:
    """Without the mark of the round, but still known as what was stored."""
    out = current.drop("moved")
    out._venuelake_stored = current._venuelake_stored
    return out


def merged_lines(df: DataFrame, by: list[str], points: str, across: bool = False) -> DataFrame:
    """Lines joined where exactly two ends of a class ``by`` meet: (*by, line, part, ring, points), a row for each line of the input.

    ``part`` counts from 0 along the merged line, and ``points`` runs in its direction. Lines that branch end at the
    branch; with ``across`` ends of other classes count as branches too. Lines of under two points are left out, and of
    lines with equal points, in either direction, one is kept. The nulls of a class are a class.
    """
    line = F.col(points)
    first, last = F.element_at(line, 1), F.element_at(line, -1)
    usable = df.where(F.size(line) >= 2).where((F.size(line) > 2) | (first != last)).select(*by, line.alias("points"))
    # one direction for equal lines, by the order of their points
    straight = F.to_json(F.struct("points")) <= F.to_json(F.struct(F.reverse("points").alias("points")))
    once = usable.withColumn("points", F.when(straight, F.col("points")).otherwise(F.reverse("points"))).distinct()
    lines = stored(once.withColumn("number", F.monotonically_increasing_id()), "lines")
    # arc 2n runs forwards, 2n + 1 backwards; an arc ends where the other begins
    ends = lines.select(*by, F.explode(F.array(
        F.struct((F.col("number") * 2).alias("arc"), F.element_at("points", -1).alias("at")),
        F.struct((F.col("number") * 2 + 1).alias("arc"), F.element_at("points", 1).alias("at")),
    )).alias("e")).select(*by, "e.arc", F.col("e.at.x").alias("x"), F.col("e.at.y").alias("y"))
    met = ends.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("arc").alias("_p"), F.max("arc").alias("_q")).where("n = 2")
    if across:
        met = met.join(ends.groupBy("x", "y").count().where("count = 2").select("x", "y"), ["x", "y"])
    back = lambda c: F.col(c).bitwiseXOR(F.lit(1))
    links = met.select(F.explode(F.array(F.struct(F.col("_p").alias("id"), back("_q").alias("next")), F.struct(F.col("_q").alias("id"), back("_p").alias("next")))).alias("l")).select("l.id", "l.next")
    links = links.where("id != next")  # a line that is closed in itself
    arcs = ends.select(F.col("arc").alias("id")).join(links, "id", "left")
    placed = stored(ranked(arcs), "ranked")
    # of the two directions of a line the one with the smaller name
    ways = placed.select(F.shiftright("id", 1).alias("number"), "chain", F.struct("chain", "id", "steps", "ring").alias("way"))
    ways = ways.groupBy("number").agg(F.min("way").alias("way"))
    out = lines.join(ways, "number").select(
        *by, F.col("way.chain").alias("line"), "way.steps", "way.ring", F.when(F.col("way.id") % 2 == 0, F.col("points")).otherwise(F.reverse("points")).alias("points")
    )
    total = out.groupBy(*by, "line").agg(F.max("steps").alias("_most"))
    same: Column = F.col("line") == F.col("_line")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    total = total.toDF(*[f"_{c}" for c in by], "_line", "_most")
    return out.join(total, same).select(*by, "line", (F.col("_most") - F.col("steps")).alias("part"), "ring", "points")


def whole_lines(merged: DataFrame, by: list[str]) -> DataFrame:
    """(*by, line, ring, points): each merged line as one list of points. A ring repeats its first point at the end."""
    parts = F.array_sort(F.collect_list(F.struct("part", "points")))
    rows = merged.groupBy(*by, "line", "ring").agg(parts.alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["points"]).otherwise(F.slice(p["points"], F.lit(2), F.size(p["points"])))))
    return rows.select(*by, "line", "ring", joined.alias("points"))
