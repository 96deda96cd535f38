"""The weekly opening model: map<day, array<struct<o, c, lo>>> in minutes; a close may pass midnight (1440).

Days are mon..sun, hol, prehol, posthol. Presence of a key counts, not its content: an empty list means closed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
KEYS = [*DAYS, "hol", "prehol", "posthol"]
RANGES = "array<struct<o:int,c:int,lo:int>>"
WEEK = f"map<string,{RANGES}>"


def calendar(day: Column, holidays: list[str]) -> Column:
    """struct<key, hol, prehol, posthol> of a date (D10); holidays are ISO dates."""
    dates = [F.to_date(F.lit(h)) for h in holidays]
    isin = (lambda d: d.isin(*dates)) if dates else (lambda d: F.lit(False))
    return F.struct(
        F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.weekday(day) + 1).alias("key"),
        isin(day).alias("hol"), isin(F.date_add(day, 1)).alias("prehol"), isin(F.date_sub(day, 1)).alias("posthol"),
    )


def ranges_for(week: Column, cal: Column) -> Column:
    """The ranges of a day: holiday, eve, day after, weekday, whichever key is there first."""
    has = lambda k: F.map_contains_key(week, k)
    return (
        F.when(cal["hol"] & has("hol"), week["hol"])
        .when(cal["prehol"] & has("prehol"), week["prehol"])
        .when(cal["posthol"] & has("posthol"), week["posthol"])
        .otherwise(week[cal["key"]])
    )


def open_state(week: Column, uncertain: Column, now: Column, holidays: list[str]) -> Column:
    """struct<open, until, left, opens_at, next_days, next_open, closed_today>, null if unknown.

    ``now`` is local. Yesterday's late ranges come first; a range that opened after midnight counts from 0:00.
    """
    today = F.to_date(now)
    minute = F.hour(now) * 60 + F.minute(now)
    ranges = ranges_for(week, calendar(today, holidays))
    before = ranges_for(week, calendar(F.date_sub(today, 1), holidays))
    spill = F.get(F.filter(before, lambda r: (r["c"] > 1440) & (minute + 1440 < r["c"])), F.lit(0))
    current = F.get(F.filter(ranges, lambda r: (r["o"] <= minute) & (minute < r["c"])), F.lit(0))
    later = F.array_min(F.transform(F.filter(ranges, lambda r: r["o"] > minute), lambda r: r["o"]))
    days = F.array(*[
        F.struct(F.lit(k).alias("k"), F.get(ranges_for(week, calendar(F.date_add(today, k), holidays)), F.lit(0))["o"].alias("o"))
        for k in range(1, 8)
    ])
    upcoming = F.get(F.filter(days, lambda d: d["o"].isNotNull()), F.lit(0))
    no = F.lit(None).cast("int")

    def state(is_open, until=no, opens=no, k=no, o=no, closed=F.lit(False)) -> Column:
        return F.struct(
            F.lit(is_open).alias("open"), until.cast("int").alias("until"), (until - minute).cast("int").alias("left"),
            opens.cast("int").alias("opens_at"), k.cast("int").alias("next_days"), o.cast("int").alias("next_open"), closed.alias("closed_today"),
        )

    return (
        F.when(F.coalesce(uncertain, F.lit(False)) | week.isNull(), None)
        .when(spill.isNotNull(), state(True, spill["c"] - 1440))
        .when(ranges.isNull(), None)
        .when(current.isNotNull(), state(True, current["c"]))
        .when(later.isNotNull(), state(False, opens=later))
        .when(upcoming.isNotNull(), state(False, k=upcoming["k"], o=upcoming["o"], closed=F.size(ranges) == 0))
        .otherwise(state(False, closed=F.lit(True)))
    )


def state_label(state: Column) -> Column:
    """Short label of a state (D14): soon within 45 minutes of closing."""
    return (
        F.when(state.isNull(), "unknown")
        .when(state["open"] & (state["left"] <= 45), "soon")
        .when(state["open"], "open")
        .when(state["opens_at"].isNotNull(), F.concat(F.lit("opens "), clock(state["opens_at"])))
        .when(state["next_open"].isNotNull(), F.concat(F.lit("in "), state["next_days"].cast("string"), F.lit("d "), clock(state["next_open"])))
        .otherwise("closed")
    )


def clock(minutes: Column) -> Column:
    """h:mm; past midnight marked as the next day (ST27)."""
    m = minutes % 1440
    text = F.concat(F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    return F.when(minutes >= 1440, F.concat(F.lit("翌"), text)).otherwise(text)


def minute_of(now: Column) -> Column:
    """The minute that a state holds for; states may be kept by it."""
    return F.date_trunc("minute", now)


def week_minutes(week: Column) -> Column:
    """Open minutes of all listed ranges."""
    return F.aggregate(F.flatten(F.map_values(week)), F.lit(0), lambda s, r: s + r["c"] - r["o"])


def dormant(week: Column, least: int = 120) -> Column:
    """So little that the listing can't be right."""
    return week_minutes(week) < least


def week_table(week: Column) -> Column:
    """Days that the week lists, in fixed order without the day after a holiday."""
    return F.filter(F.array(*[F.lit(k) for k in KEYS[:-1]]), lambda k: F.map_contains_key(week, k))


def ordered_week(week: Column) -> Column:
    """The same map with keys in canonical order."""
    keys = F.filter(F.array(*[F.lit(k) for k in KEYS]), lambda k: F.map_contains_key(week, k))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: week[k]))


#: Fixed signs of the days, in order, and words of the summary.
SIGNS = ["月", "火", "水", "木", "金", "土", "日", "祝", "祝前日", "祝後日"]
CLOSED, LAST_ORDER = "定休", "L.O."


def hours_text(week: Column) -> Column:
    """``月〜土 17:00〜23:00（L.O.22:30）／日 定休``: days with equal hours, last orders included, in one group.

    A fold over the days: runs of neighbouring weekdays; a holiday joins the weekday listed before it.
    """
    plain = lambda m: F.concat(F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    last = lambda r: F.when(r["lo"].isNull(), "").otherwise(F.concat(F.lit(f"（{LAST_ORDER}"), plain(r["lo"]), F.lit("）")))
    text = lambda r: F.array_join(F.transform(r, lambda x: F.concat(plain(x["o"]), F.lit("〜"), plain(x["c"]), last(x))), "・")
    days = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for i, k in enumerate(KEYS)])
    empty = F.array().cast("array<struct<first:int,n:int,last:int,t:string>>")

    def step(acc: Column, d: Column) -> Column:
        mine = F.when(F.size(week[d["k"]]) == 0, F.lit(CLOSED)).otherwise(text(week[d["k"]]))
        prev = F.get(acc, F.size(acc) - 1)
        near = (prev["t"] == mine) & (prev["last"] < 7) & ((d["i"] == 7) | ((d["i"] < 7) & (prev["last"] + 1 == d["i"])))
        longer = F.struct(prev["first"].alias("first"), (prev["n"] + (d["i"] < 7).cast("int")).alias("n"), d["i"].alias("last"), prev["t"].alias("t"))
        alone = F.struct(d["i"].alias("first"), (d["i"] < 7).cast("int").alias("n"), d["i"].alias("last"), mine.alias("t"))
        joined = F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(alone)))
        return F.when(F.map_contains_key(week, d["k"]), joined).otherwise(acc)

    sign = lambda i: F.element_at(F.array(*map(F.lit, SIGNS)), i + 1)

    def label(r: Column) -> Column:
        end = r["first"] + r["n"] - 1
        weekdays = F.when(r["n"] > 2, F.concat(sign(r["first"]), F.lit("〜"), sign(end))).when(r["n"] == 2, F.concat(sign(r["first"]), F.lit("・"), sign(end))).when(r["n"] == 1, sign(r["first"]))
        return F.concat_ws("・", weekdays, F.when(r["last"] >= 7, sign(r["last"])))

    return F.array_join(F.transform(F.aggregate(days, empty, step), lambda r: F.concat_ws(" ", label(r), r["t"])), "／")


def clock12(c: Column) -> Column:
    """Minutes of ``h:mm AM``."""
    h, m = (F.regexp_extract(c, r"(\d{1,2}):(\d{2})\s*([AaPp])", i).try_cast("int") for i in (1, 2))
    pm = F.lower(F.regexp_extract(c, r"(\d{1,2}):(\d{2})\s*([AaPp])", 3)) == "p"
    return (h % 12 + F.when(pm, 12).otherwise(0)) * 60 + m


#: First train, as minutes of the day before.
FIRST_TRAIN = 1740


def clock_ja(c: Column, base: Column | None = None) -> Column:
    """Minutes of ``H:MM`` or ``H時MM``; the next day if marked, or not after ``base``."""
    h = F.regexp_extract(c, r"(\d{1,2})[:：時](\d{0,2})", 1).try_cast("int")
    m = F.coalesce(F.regexp_extract(c, r"(\d{1,2})[:：時](\d{0,2})", 2).try_cast("int"), F.lit(0))
    v = h * 60 + m
    next_day = c.contains("翌") | (F.coalesce(v <= base, F.lit(False)) if base is not None else F.lit(False))
    return F.when(c.contains("始発"), FIRST_TRAIN).otherwise(F.when(next_day & (v < 1440), v + 1440).otherwise(v))
