"""Queries over sources and streams, each with SQL that gets there another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import ship_package
from ..sources import connector
from ..stored import new_folder
from ..streaming import open_set
from .catalog import query
from .views import VENUES_SQL, table, venues


@query("""SELECT page_id AS id, CAST(page_id % 90 AS DOUBLE) AS lat, CAST(page_id % 180 AS DOUBLE) AS lon, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages
WHERE page_id % 90 BETWEEN 10 AND 60 AND regexp_extract(url, '//[^/]+/([a-z][a-z])/', 1) IN ('en', 'fr') AND page_id % 3 <> 0""")
def stored_elements(spark, sf):
    """Pages as stored map elements, read again by the connector, which takes the box and the tags into its scan."""
    ship_package(spark)
    p = table(spark, sf, "pages")
    tags = F.struct(F.nullif(F.regexp_extract("url", "//[^/]+/([a-z][a-z])/", 1), F.lit("")).alias("lang"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.when(F.col("page_id") % 3 != 0, "yes").alias("open"))
    folder = new_folder(spark, "elements")
    p.select(F.lit("node").alias("type"), F.col("page_id").alias("id"), (F.col("page_id") % 90).cast("double").alias("lat"), (F.col("page_id") % 180).cast("double").alias("lon"), tags.alias("tags")).write.json(folder)
    found = connector.load(spark, folder, ["lang", "host", "open"])
    return found.where("kind = 'node' AND lat >= 10 AND lat <= 60 AND tag_lang IN ('en', 'fr') AND tag_open IS NOT NULL").select("id", "lat", "lon", F.col("tag_host").alias("host"))


@query(f"""WITH {VENUES_SQL}, f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1), w AS (SELECT max(ts) - INTERVAL 30 MINUTE AS mark, min(ts) AS low FROM events),
d AS (SELECT unnest(generate_series(CAST(low AS DATE) - INTERVAL 2 DAY, CAST(mark AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM w),
t AS (SELECT id AS venue, first, day + to_minutes(CAST(o AS BIGINT)) AS moment, TRUE AS open FROM f JOIN venues ON user_id = id, d WHERE isodow(day) - 1 <> off_dow
  UNION ALL SELECT id, first, day + to_minutes(CAST(c AS BIGINT)), FALSE FROM f JOIN venues ON user_id = id, d WHERE isodow(day) - 1 <> off_dow)
SELECT venue, epoch_ms(moment) // 60000 AS minute, open FROM t, w WHERE moment > first AND moment <= mark""")
def running_open_set(spark, sf):
    """Openings and closings of venues after their first event, by event-time timers on a stream of the events."""
    open_set.use_rocksdb(spark)
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    hours = venues(spark, sf).select(F.col("id").alias("venue"), "o", "c", F.col("off_dow").alias("off"))
    changed = open_set.changes(events.select(F.col("user_id").alias("venue"), F.col("ts").cast("timestamp").alias("ts")), hours, "30 minutes")
    out = new_folder(spark, "open-set")
    stream = changed.writeStream.format("parquet").option("path", f"{out}/changes").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    found = spark.read.schema(open_set.CHANGES).parquet(f"{out}/changes")
    return found.select("venue", F.floor(F.unix_millis("at") / 60000).alias("minute"), "open")


