"""The running open set: a stream of openings and closings at event time.

Each venue that an event has named keeps its hours and the time of its next change in state, with one event-time timer
there. The timer fires when the watermark passes; it emits what has changed and registers the next change. Late rows
within the watermark may start a venue earlier than it was known. State and timers live in the checkpoint, so a stream
that is stopped goes on where it was.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship_package

MINUTE = 60_000
DAY = 1440 * MINUTE
CHANGES = "venue long, at timestamp, open boolean"


def next_change(after: int, o: int, c: int, off: int) -> tuple[int, bool]:
    """(time, whether it opens) of the first change after a time in milliseconds; daily hours in minutes, one weekday off (0 is Monday)."""
    day = after // DAY
    found = []
    for d in range(day - 1, day + 9):
        if (d + 3) % 7 != off:  # the epoch was a Thursday
            found += [(d * DAY + o * MINUTE, True), (d * DAY + c * MINUTE, False)]
    return min(x for x in found if x[0] > after)


class _Venue(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("venue", "start long, o int, c int, off int, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        first = min(((r.ts, r) for r in rows), key=lambda x: x[0])[1]
        start = _millis(first.ts)
        known = self.state.get() if self.state.exists() else None
        if known is None or start < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[4])
            # what the watermark has passed was told before, if the venue was known then
            due, _ = next_change(start, first.o, first.c, first.off)
            self.state.update((start, first.o, first.c, first.off, due))
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        start, o, c, off, due = self.state.get()
        passed = timerValues.getCurrentWatermarkInMs()
        at, out = due - 1, []
        while True:
            at, opens = next_change(at, o, c, off)
            if at > passed:
                break
            out.append(Row(venue=key[0], at=datetime.datetime.fromtimestamp(at / 1000, datetime.timezone.utc).replace(tzinfo=None), open=opens))
        self.state.update((start, o, c, off, at))
        self.handle.registerTimer(at)
        return iter(out)

    def close(self) -> None:
        pass


def _millis(ts: datetime.datetime) -> int:
    if ts.tzinfo is None:
        ts = ts.replace(tzinfo=datetime.timezone.utc)
    # up to the next millisecond, so that a change is never before the event
    return -int(-(ts - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(milliseconds=1))


def changes(events: DataFrame, hours: DataFrame, late: str) -> DataFrame:
    """(venue, at, open): every opening and closing after the first event of a venue, up to the watermark.

    ``events``(venue, ts): a stream; ``hours``(venue, o, c, off): minutes of each day and the weekday off. The session's
    time zone has to be UTC, and its state store RocksDB (``use_rocksdb``).
    """
    ship_package(hours.sparkSession)
    named = events.withWatermark("ts", late).join(hours, "venue").select("venue", "ts", F.col("o").cast("int").alias("o"), F.col("c").cast("int").alias("c"), F.col("off").cast("int").alias("off"))
    return named.groupBy("venue").transformWithState(statefulProcessor=_Venue(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
