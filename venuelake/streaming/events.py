"""Built-in extras over event tables; the capability inventory has no streams, so these claim no parity.

The same functions take a batch or a stream; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], late: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates of each window and key; ``late``: how long a stream waits for stragglers."""
    marked = df.withWatermark(ts, late) if late else df
    out = marked.groupBy(F.window(ts, width), *by).agg(*[a.alias(k) for k, a in aggs.items()])
    return out.select(F.col("window.start").alias("start"), *by, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Sessions of each key, closed by a gap: start, end of the last event, events."""
    marked = df.withWatermark(ts, late) if late else df
    out = marked.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, "first_ts", "last_ts", "n")


def distinct_events(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Events without repeats within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
