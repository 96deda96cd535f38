"""Merging sparse sources: precedence with lineage, patches, upserts, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed words that a source writes where it knows nothing.
PLACEHOLDERS = ["不明", "未確認", "要確認", "—", "-", "－"]


def known(c: Column) -> Column:
    """Null if empty or a placeholder word; 0 and false stay."""
    text = c.cast("string")
    return F.when((text == "") | F.regexp_replace(text, r"(?U)^\s+|\s+$", "").isin(PLACEHOLDERS), None).otherwise(c)


def first_known(*sources: tuple[Column, str]) -> Column:
    """struct<value, source> of the first source that knows (N01), null if none does."""
    return F.coalesce(*[F.when(known(c).isNotNull(), F.struct(c.alias("value"), F.lit(s).alias("source"))) for c, s in sources])


def patched(df: DataFrame, patch: DataFrame, key: str, columns: list[str], present: str = "present", exclude: str | None = None) -> DataFrame:
    """Columns replaced where the patch names them, with a null too (J02). ``present``: array of column names.

    Columns that ``df`` lacks are added. Rows whose patch has ``exclude`` true, or a text in it, are dropped.
    """
    out_of = F.lit(False) if exclude is None else F.coalesce(~F.col(exclude).cast("string").isin("", "false"), F.lit(False))
    p = patch.select(F.col(key), F.col(present).alias("_present"), out_of.alias("_out"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(p, key, "left").where(~F.coalesce("_out", F.lit(False)))
    old = lambda c: F.col(c) if c in df.columns else F.lit(None)
    out = {c: F.when(F.array_contains("_present", c), F.col(f"_{c}")).otherwise(old(c)) for c in columns}
    return joined.withColumns(out).drop("_present", "_out", *[f"_{c}" for c in columns])


def upsert(base: DataFrame, updates: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Whole records replaced by the last update of their key that says anything (U04); unknown keys are dropped."""
    last = updates.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_new"))
    joined = base.join(last, key, "left")
    return joined.select(key, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in columns])


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def ordered_union(a: Column, b: Column) -> Column:
    """a, then what only b has, in order."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def map_defaults(own: Column, defaults: Column) -> Column:
    """The entries of a map, and those of ``defaults`` that it lacks (N04); null maps are empty."""
    lacking = F.map_filter(defaults, lambda k, _: F.coalesce(~F.map_contains_key(own, k), F.lit(True)))
    return F.coalesce(F.map_concat(own, lacking), lacking)


def map_extended(own: Column, more: Column) -> Column:
    """Lists of both maps, one behind the other for keys that both have."""
    return F.map_zip_with(own, more, lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b)))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n): rows in which each column is known."""
    one = df.agg(*[F.count_if(known(F.col(c)).isNotNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "field", "n")


def coverage_in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n, place): the same with the most known field first, equal ones by name."""
    order = Window.orderBy(F.desc("n"), "field")  # a row for each column
    return coverage(df, columns).withColumn("place", F.row_number().over(order).cast("long"))
