"""Ordered operations on rows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import stored


def stack_fanout(df: DataFrame, cell: list[str], order: str) -> DataFrame:
    """Rows that share a place get an angle by rank and a radius by number (A17, W02, M11); lone rows get null."""
    w = Window.partitionBy(*cell)
    n = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy(order)) - 1
    return df.withColumns({"stacked": n, "angle": F.when(n > 1, 2 * F.pi() * i / n), "radius": F.when(n > 1, 4 + n)})


def null_gap_runs(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows with a value, numbered by the gaps before them."""
    gaps = F.sum(F.col(value).isNull().cast("int")).over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("run", gaps).where(F.col(value).isNotNull())


def split_overlap(points: Column, most: int) -> Column:
    """Pieces of ``most`` + 1 points at most that share their end points."""
    n = F.size(points)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(most)), lambda i: (i < n - 1) | (n <= 1))
    return F.transform(starts, lambda i: F.slice(points, i + 1, most + 1))


def delta_encode(values: Column) -> Column:
    """The first value, then differences."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, take: list[str], order: str) -> DataFrame:
    """Left rows with the last right row at or before them (J23), by one shuffle: a union sorted by time.

    Right rows sort before left rows of the same time; among equals the greatest ``order`` is last.
    """
    r = right.select(by, ts, F.lit(0).alias("_side"), F.col(order).alias("_o"), F.struct(*take).alias("_v"))
    keep = [c for c in left.columns if c not in (by, ts)]
    row = F.struct(*keep).alias("_row")
    l = left.select(by, ts, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[order]).alias("_o"), row)  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(ts, "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.col("_v"), ignorenulls=True).over(w)
    return both.withColumn("_m", last).where("_side = 1").select(by, ts, "_row.*", "_m.*")


def interpolated(left: DataFrame, right: DataFrame, by: str, ts: str, values: list[str], order: str, share=lambda u: u) -> DataFrame:
    """Left rows with ``values`` between the last right row at or before them and the next one (J23, M12), by one shuffle.

    Of right rows of one time the greatest ``order`` is where a span starts, and the smallest is where one ends, so that equal
    times are cuts. ``share`` shapes the way between them, and before the first and after the last row the nearest row holds.
    Rows without a time or without any right row get nulls. ``ts`` is a number.
    """
    point = F.struct(F.col(ts).alias("t"), *values)
    r = right.where(F.col(ts).isNotNull()).select(by, ts, F.lit(0).alias("_side"), F.col(order).alias("_o"), point.alias("_v"))
    row = F.struct(*[c for c in left.columns if c not in (by, ts)]).alias("_row")
    both = r.unionByName(left.select(by, ts, F.lit(1).alias("_side"), row), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(ts, "_side", "_o")
    spans = both.withColumns({
        "_a": F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        # looking forward from the other end, so that both frames grow instead of being read again for each row
        "_b": F.last("_v", ignorenulls=True).over(Window.partitionBy(by).orderBy(F.desc(ts), F.desc("_side"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)),
    })
    known = F.col(ts).isNotNull()
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    u = F.when(b["t"] > a["t"], share((F.col(ts) - a["t"]) / (b["t"] - a["t"]))).otherwise(F.lit(1.0))
    between = [F.when(known, a[v] + (b[v] - a[v]) * u).alias(v) for v in values]
    return spans.where("_side = 1").select(by, ts, "_row.*", *between)


def index_percentile(values: Column, share: float) -> Column:
    """The value at floor(n * share) of the sorted values, 0-based (A03): an aggregate over the group."""
    return F.get(F.array_sort(F.collect_list(values)), F.floor(F.count(values) * F.lit(share)).cast("int"))


def ranked_percentile(df: DataFrame, value: str, shares: list[float], by: str | None = None) -> DataFrame:
    """The same without gathering a group: equal values are counted first, and their ranks come from running sums.

    The window runs over distinct values, so a group of any number of rows is as large as its distinct values.
    """
    keys = [by] if by else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = F.sum("_n").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_total": F.sum("_n").over(part)})
    at = lambda s: F.floor(F.col("_total") * F.lit(s))
    hit = [F.max(F.when((F.col("_upto") - F.col("_n") <= at(s)) & (at(s) < F.col("_upto")), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return ranked.groupBy(*keys).agg(F.max("_total").alias("n"), *hit)


def selected_percentile(df: DataFrame, value: str, shares: list[float], by: str | None = None, ranges: int = 4096) -> DataFrame:
    """(by, n, p<share>...): the value at floor(n * share) of the sorted values of each group, 0-based (A03), by distributed selection.

    Each round counts the values of the open groups by ranges of equal width, and goes on with the range that holds the
    rank, until it has one value. No window or task ever sees more than ``ranges`` rows of a group. Numbers only; nulls
    don't count, and groups without any value are left out.
    """
    keys = [by] if by else []
    given = df.select(*keys, F.col(value).alias("v")) if by else df.select(F.lit(1).alias("_all"), F.col(value).alias("v"))
    key = by or "_all"
    counts = stored(given.where(F.col("v").isNotNull()).groupBy(key, "v").agg(F.count(F.lit(1)).alias("c")), "counts")
    whole = stored(counts.groupBy(key).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "whole")
    share = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("n") * F.lit(s)).alias("at")) for i, s in enumerate(shares)]))
    aims = whole.withColumn("s", share).select(key, "s.i", "s.at", F.lit(0).cast("long").alias("below"), "lo", "hi")
    aims = stored(aims, "aims")
    found = None
    while True:
        done = aims.where("lo = hi").select(key, "i", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        rest = aims.where("lo < hi")
        if rest.isEmpty():
            break
        aim = rest.select(F.col(key).alias("_k"), "i", "at", "below", "lo", "hi")
        inside = counts.join(aim, F.col(key).eqNullSafe(F.col("_k")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        wide = F.col("hi").cast("double") - F.col("lo").cast("double")
        place = F.least(F.floor((F.col("v").cast("double") - F.col("lo").cast("double")) / wide * ranges), F.lit(ranges - 1))
        # the ends have ranges of their own, so that each round has fewer values
        place = F.when(F.col("v") == F.col("hi"), ranges).otherwise(place)
        held = inside.groupBy("_k", "i", "at", "below", place.alias("place")).agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy("_k", "i").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        hit = held.withColumn("upto", upto).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
        aims = stored(hit.select(F.col("_k").alias(key), "i", "at", (F.col("upto") - F.col("c")).alias("below"), "lo", "hi"), "aims")
    values = [F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"p{round(s * 100)}") for i, s in enumerate(shares)]
    per = found.groupBy(F.col(key).alias("_k")).agg(*values)
    names = [f"p{round(s * 100)}" for s in shares]
    return whole.join(per, F.col(key).eqNullSafe(F.col("_k")), "left").select(*keys, "n", *names)


def segmented(df: DataFrame, by: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``, in order across and written: a key of any size is dealt to many parts by its sort columns."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, by, *order).withColumn("_part", F.spark_partition_id()), "segmented")


def _carried(placed: DataFrame, by: str, order: list[str], value: Column) -> DataFrame:
    """``placed`` with ``_m``, the last ``value`` that is not null at or before each row: inside its part, else from the parts before."""
    inside = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_v2", value)
    ends = own.where(F.col("_v2").isNotNull()).groupBy(by, "_part").agg(F.max_by(F.struct(F.col("_v2").alias("v")), F.struct(*order)).alias("_e"))
    every = placed.select(by, "_part").distinct().join(ends.withColumnRenamed(by, "_b").withColumnRenamed("_part", "_p"), F.col(by).eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")), "left")
    # a row for each part of a key
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select(F.col(by).alias("_b"), F.col("_part").alias("_p"), F.last("_e", ignorenulls=True).over(before).alias("_c"))
    scanned = own.withColumn("_last", F.last("_v2", ignorenulls=True).over(inside))
    joined = scanned.join(stored(carry, "carry"), F.col(by).eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_m", F.coalesce("_last", F.col("_c.v"))).drop("_v2", "_last", "_b", "_p", "_c")


def as_of_segmented(left: DataFrame, right: DataFrame, by: str, ts: str, take: list[str], order: str, parts: int | None = None) -> DataFrame:
    """``as_of`` for keys of any size (J23): a segmented scan, whose tasks hold a part of a key each."""
    r = right.select(by, ts, F.lit(0).alias("_side"), F.col(order).alias("_o"), F.struct(*take).alias("_v"))
    keep = [c for c in left.columns if c not in (by, ts)]
    l = left.select(by, ts, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[order]).alias("_o"), F.struct(*keep).alias("_row"))  # noqa: E741
    placed = segmented(r.unionByName(l, allowMissingColumns=True), by, [ts, "_side", "_o"], parts)
    return _carried(placed, by, [ts, "_side", "_o"], F.col("_v")).where("_side = 1").select(by, ts, "_row.*", "_m.*")


def null_gap_runs_segmented(df: DataFrame, by: str, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """``null_gap_runs`` for keys of any size (W06): gaps are counted inside parts, and a prefix sum over parts is added."""
    placed = segmented(df, by, order, parts)
    gap = F.col(value).isNull().cast("int")
    totals = placed.groupBy(by, "_part").agg(F.sum(gap).alias("_g"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = stored(totals.select(F.col(by).alias("_b"), F.col("_part").alias("_p"), F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_s")), "shift")
    inside = F.sum(gap).over(Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("_r", inside).join(shift, F.col(by).eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("run", F.col("_r") + F.col("_s")).where(F.col(value).isNotNull()).drop("_r", "_s", "_b", "_p", "_part")


def numbered(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with a number from 1 in order (A15): places inside ranges of the order, and the rows of the ranges before.

    Only a row for each range is ever in one task. Ties are numbered in any order.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_i", inside).join(sizes, F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_i")).drop("_part", "_i", "_p", "_before")
