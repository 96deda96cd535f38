"""Views of the driver's tables that look like venues and stations; the SQL states the same for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hours import DAYS, RANGES

#: A Friday evening, so that late ranges of the day before may still be open.
NOW = "2024-01-05 00:30:00"
HOLIDAYS = ["2024-01-01", "2024-01-08"]

VENUES_SQL = """venues AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment,
  3.55e1+((c_custkey*7919)%3400)/1e4 AS lat, 1.3924e2+((c_custkey*104729)%7000)/1e4 AS lng,
  CAST(c_custkey%5+1 AS INT) AS social, CAST((c_custkey%14+8)*60 AS INT) AS o,
  CAST((c_custkey%14+8)*60+(c_custkey%9+2)*60 AS INT) AS c, CAST(c_custkey%7 AS INT) AS off_dow,
  CASE WHEN c_acctbal<0 THEN NULL ELSE CAST(floor(c_acctbal) AS INT) END AS budget_max FROM customer)"""
STATIONS_SQL = """stations AS (SELECT s_suppkey AS sid, concat('ST', CAST(s_suppkey%40 AS STRING)) AS station,
  3.55e1+((s_suppkey*6007)%3400)/1e4 AS slat, 1.3924e2+((s_suppkey*15485)%7000)/1e4 AS slng FROM supplier)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment",
        "3.55e1+((c_custkey*7919)%3400)/1e4 AS lat", "1.3924e2+((c_custkey*104729)%7000)/1e4 AS lng",
        "CAST(c_custkey%5+1 AS INT) AS social", "CAST((c_custkey%14+8)*60 AS INT) AS o",
        "CAST((c_custkey%14+8)*60+(c_custkey%9+2)*60 AS INT) AS c", "CAST(c_custkey%7 AS INT) AS off_dow",
        "CASE WHEN c_acctbal<0 THEN NULL ELSE CAST(floor(c_acctbal) AS INT) END AS budget_max",
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS sid", "concat('ST', CAST(s_suppkey%40 AS STRING)) AS station",
        "3.55e1+((s_suppkey*6007)%3400)/1e4 AS slat", "1.3924e2+((s_suppkey*15485)%7000)/1e4 AS slng",
    )


def with_week(df: DataFrame) -> DataFrame:
    """A week with the same range on six days and none on the day off; ids divisible by 11 list holidays too."""
    one = F.array(F.struct(F.col("o").alias("o"), F.col("c").alias("c"), F.lit(None).cast("int").alias("lo")))
    none = F.array().cast(RANGES)
    entries = [F.struct(F.lit(d).alias("k"), F.when(F.col("off_dow") == i, none).otherwise(one).alias("v")) for i, d in enumerate(DAYS)]
    hol = F.when(F.col("id") % 11 == 0, F.array(F.struct(F.lit("hol").alias("k"), none.alias("v")))).otherwise(F.array().cast(f"array<struct<k:string,v:{RANGES}>>"))
    return df.withColumn("week", F.map_from_entries(F.concat(F.array(*entries), hol)))
