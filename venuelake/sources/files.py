"""Readers and writers of the sparse JSON and text files that feed and leave the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SPOT_SCHEMA = (
    "id string, name string, name_kana string, name_en string, aliases array<string>, kind string, yokocho string, area string, ward string, "
    "region string, address string, address_detail string, station string, hours string, closed string, budget string, budget_min string, "
    "budget_max string, price_note string, social string, solo string, hiru boolean, english boolean, tags array<string>, payment string, "
    "smoking string, desc string, talk string, tips string, shops string, since string, status string, checked string, sources array<string>, "
    "members array<string>, lat double, lng double, pin array<double>, official_pin array<double>"
)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def json_rows(spark: SparkSession, path: str, schema: str, exclude_prefix: str | None = None) -> DataFrame:
    """Files with one JSON array each (S01), with ``stem`` and ``ord`` (file, position); broken files give no rows."""
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"))
    if exclude_prefix:
        raw = raw.where(~F.col("stem").startswith(exclude_prefix))
    rows = F.from_json("value", f"array<struct<{_colons(schema)}>>")
    out = raw.select("stem", F.posexplode(rows).alias("pos", "r"))
    return out.select("r.*", "stem", F.struct("stem", "pos").alias("ord"))


def _colons(schema: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ", 1) for x in schema.split(", ")))


def stem_lookup(stem: Column, lookup: dict[str, str], default: str) -> Column:
    """Virtual column from a file's stem."""
    return F.coalesce(*[F.when(stem == k, F.lit(v)) for k, v in lookup.items()], F.lit(default))


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one object of a file, or the objects of its lines; no rows where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, record) of files that hold one object keyed by id (S04); records are variants, so sparse keys keep apart."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where("v is not null")
    return whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("id"), F.col("value").alias("record"))


def json_any(spark: SparkSession, path: str, key: str, slug) -> DataFrame:
    """(id, record) of files that hold an array of records or a map of them (S05); array records are keyed by slug."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    each = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", "value")
    own = F.try_variant_get("value", f"$.{key}", "string")
    return each.select(F.coalesce(F.col("key"), slug(own)).alias("id"), F.col("value").alias("record"))


def geocoded(responses: DataFrame, query: str, body: str) -> DataFrame:
    """(query, lat, lng, title, level) of stored answers of a geocoder, the first hit of each (S09); no hit gives null columns."""
    hits = F.from_json(body, "array<struct<geometry:struct<coordinates:array<double>>,properties:struct<title:string>>>")
    hit = F.get(hits, F.lit(0))
    title = hit["properties"]["title"]
    level = F.when(title.contains("号"), "号").when(title.contains("番"), "番").when(title.contains("丁目"), "丁目").when(title.isNotNull(), "町")
    at = hit["geometry"]["coordinates"]
    return responses.select(query, F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lng"), title.alias("title"), level.alias("level"))


LEDGER_SCHEMA = "name string, aliases array<string>, area string, address string, spot_id string"


def candidate_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of candidates, with ``ord``."""
    return json_rows(spark, path, LEDGER_SCHEMA).drop("stem")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "None").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Violations log."""
    df.write.mode("overwrite").option("sep", "\t").option("nullValue", "None").csv(path)


def cached_lookup(jobs: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(answered, pending) of lookups against a stored cache (S08, J27); negative answers are cached too."""
    return jobs.join(cache, key), jobs.join(cache, key, "left_anti")


def compact_json(df: DataFrame) -> Column:
    """A sparse record without null fields and private columns."""
    return F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")]), {"ignoreNullFields": "true"})
