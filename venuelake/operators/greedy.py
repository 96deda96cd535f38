"""Choices that depend on order, made in rounds instead of one row after the other.

A row whose turn comes before that of all undecided rows it conflicts with can be decided at once, wherever it lies.
Each round decides all such rows and what they exclude, so the outcome is that of going through the rows in order. A
round is a few joins; no key, name or cell is ever in one task. Rows that conflict in a long ascending chain, each with
the next one only, take a round for every second of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import released, stored


def greedy_dedup(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Rows kept in order unless one of their keys was seen on a kept row (W04). Null keys are none.

    All keys lie in one space: what one row has as its id excludes another that has it as a name. A dropped row
    registers nothing. ``order`` must be distinct; rows without it are dropped.
    """
    pairs = df.where(F.col(order).isNotNull()).select(F.col(order).alias("o"), F.explode(F.array_compact(F.array(*[F.col(k).cast("string") for k in keys]))).alias("k")).distinct()
    left = stored(pairs, "undecided")
    kept = stored(df.where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNull()).where(F.col(order).isNotNull()).select(F.col(order).alias("o")), "kept")
    while not left.isEmpty():
        # written, so that a key that many rows have is met by plain exchanges
        least = stored(left.groupBy("k").agg(F.min("o").alias("first")), "least")
        told = left.join(least, "k")
        now = stored(told.groupBy("o").agg(F.bool_and(F.col("o") == F.col("first")).alias("all")).where("all").select("o"), "now")
        taken = stored(left.join(now, "o", "left_semi").select("k").distinct(), "taken")
        out = stored(left.join(taken, "k", "left_semi").select("o").distinct(), "out")
        rest = stored(left.join(out, "o", "left_anti"), "undecided")
        more = stored(kept.unionByName(now), "kept")
        released(left, kept, least, now, taken, out)
        left, kept = rest, more
    return df.join(kept.withColumnRenamed("o", "_o"), F.col(order) == F.col("_o"), "left_semi")


def _around(c: Column, reach: int) -> Column:
    return F.explode(F.sequence(c - reach, c + reach))


def cluster_centres(df: DataFrame, name: str, order: str, x: str, y: str, radius: float, below: str | None = None) -> DataFrame:
    """(name, cluster, n, cx, cy): in order, a row joins the first cluster of its name whose first member is nearer than ``radius``.

    ``cluster`` is the order of the first member. The centre is that of the members for which ``below`` is not true, if
    there are any, else of all, summed to 14 decimals. ``order`` must be distinct. Rows without name, order or place are
    left out; coordinates are below 10^14.

    Rows of one name in one cell exclude each other, so a cell has one candidate a round; it waits if an undecided row
    before it is near. Every row meets the candidates of 25 cells, however many rows a cell has.
    """
    cell = radius / 1.5  # the diagonal is shorter than the radius
    given = df.select(
        F.col(name).cast("string").alias("name"), F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        (F.coalesce(F.col(below), F.lit(False)) if below else F.lit(False)).alias("below"),
    ).dropna(subset=["name", "o", "x", "y"])
    rows = stored(given.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)}), "placed")
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    near = F.sqrt(dx * dx + dy * dy) < radius

    def met(left: DataFrame, points: DataFrame) -> DataFrame:
        """Pairs of rows and the points of their name that are near."""
        spread = points.select("name", F.col("o").alias("so"), F.col("x").alias("sx"), F.col("y").alias("sy"), _around(F.col("gx"), 2).alias("gx"), "gy")
        spread = stored(spread.withColumn("gy", _around(F.col("gy"), 2)), "spread")
        return left.join(spread, ["name", "gx", "gy"]).where(near)

    left, seeds = rows, None
    while not left.isEmpty():
        candidates = stored(left.groupBy("name", "gx", "gy").agg(F.min_by(F.struct("o", "x", "y"), "o").alias("c")).select("name", "gx", "gy", "c.*"), "candidates")
        waits = stored(met(left, candidates).where("o < so").select("so").distinct(), "waits")
        now = stored(candidates.join(waits, F.col("o") == F.col("so"), "left_anti"), "seeds")
        out = stored(met(left, now).select("o").distinct(), "near")
        before, left = left, stored(left.join(out, "o", "left_anti"), "undecided")
        seeds = now if seeds is None else stored(seeds.unionByName(now), "seeds")
        if before is not rows:
            released(before)
        released(candidates, waits, out)
    if seeds is None:
        seeds = stored(rows.select("name", "gx", "gy", "o", "x", "y"), "seeds")
    # the first cluster that is near; a first member is nearest to itself, and no earlier one is near it
    joined = met(rows, seeds).groupBy("name", "o", "x", "y", "below").agg(F.min("so").alias("cluster"))
    # sums of exact numbers, so that a centre does not depend on the order in which its members are added
    exact = lambda c: F.col(c).cast("decimal(28,14)")
    top = lambda c: F.when(~F.col("below"), exact(c))
    n, above = F.count(F.lit(1)), F.count_if(~F.col("below"))
    centre = lambda c: F.coalesce(F.sum(top(c)).cast("double") / F.nullif(above, F.lit(0)), F.sum(exact(c)).cast("double") / n)
    return joined.groupBy("name", "cluster").agg(n.alias("n"), centre("x").alias("cx"), centre("y").alias("cy"))
