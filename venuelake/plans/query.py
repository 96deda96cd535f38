"""A builder for venue searches: filters, open state, distance, order and page in one DataFrame plan."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, hours, text


class VenueQuery:
    """Each call returns a new query; ``df`` is the plan. Column names are parameters of the constructor."""

    def __init__(self, df: DataFrame, conditions: tuple[Column, ...] = (), lat: str = "lat", lng: str = "lng"):
        self._df, self._conditions, self._lat, self._lng = df, conditions, lat, lng

    def _with(self, df: DataFrame | None = None, *more: Column) -> VenueQuery:
        return VenueQuery(df if df is not None else self._df, (*self._conditions, *more), self._lat, self._lng)

    def where(self, *conditions: Column) -> VenueQuery:
        return self._with(None, *conditions)

    def kinds(self, column: str, values: list) -> VenueQuery:
        """F02"""
        return self.where(F.col(column).isin(values))

    def at_least(self, column: str, least: int) -> VenueQuery:
        """null counts as 0."""
        return self.where(F.coalesce(F.col(column), F.lit(0)) >= least)

    def flag(self, column: str) -> VenueQuery:
        """null counts as false."""
        return self.where(F.coalesce(F.col(column), F.lit(False)))

    def not_true(self, column: str) -> VenueQuery:
        """false only; unknown is out."""
        return self.where(F.col(column).eqNullSafe(F.lit(False)))

    def cheap(self, budget: str, most: int, always: Column | None = None) -> VenueQuery:
        """0 and null are no budget."""
        c = F.coalesce((F.col(budget) != 0) & (F.col(budget) <= most), F.lit(False))
        return self.where(c | always if always is not None else c)

    def in_area(self, choice: str, area: str, region: str) -> VenueQuery:
        """r:<region> or a:<area>."""
        return self.where(F.col(region if choice.startswith("r:") else area).cast("string") == choice[2:])

    def matching(self, query: str, document: Column) -> VenueQuery:
        """F09"""
        return self.where(text.has_all_tokens(document, query))

    def in_view(self, south: float, west: float, north: float, east: float) -> VenueQuery:
        """F10"""
        return self.where(geo.in_box(F.col(self._lat), F.col(self._lng), south, west, north, east))

    def favourites(self, ids: DataFrame, key: str) -> VenueQuery:
        """F07"""
        return self._with(self._df.join(ids, key, "left_semi"))

    def open_at(self, now: Column, holidays: list[str], uncertain: Column | None = None, only: bool = True) -> VenueQuery:
        """Adds ``state``."""
        df = self._df.withColumn("state", hours.open_state(F.col("week"), F.lit(False) if uncertain is None else uncertain, now, holidays))
        return self._with(df, F.coalesce(F.col("state.open"), F.lit(False))) if only else self._with(df)

    def near(self, lat: float, lng: float) -> VenueQuery:
        """Adds ``distance``."""
        return self._with(self._df.withColumn("distance", geo.haversine(F.lit(lat), F.lit(lng), F.col(self._lat), F.col(self._lng))))

    def order(self, *keys: Column) -> VenueQuery:
        return VenueQuery(self.df.orderBy(*keys), (), self._lat, self._lng)

    def page(self, size: int = 60, number: int = 0) -> DataFrame:
        """T07"""
        return self.df.offset(size * number).limit(size) if number else self.df.limit(size)

    @property
    def df(self) -> DataFrame:
        return self._df.where(functools.reduce(lambda a, b: a & b, self._conditions)) if self._conditions else self._df


def open_rank(state: Column) -> Column:
    """2 open, 1 later today, else 0."""
    return F.when(F.coalesce(state["open"], F.lit(False)), 2).when(state["opens_at"].isNotNull(), 1).otherwise(0)


def social_keys(social: Column, solo: Column, state: Column) -> list[Column]:
    """Talkative first, then good alone, then by ``open_rank`` (T02); null counts as 0."""
    some = lambda c: F.coalesce(c, F.lit(0)).desc()
    return [some(social), some(solo), open_rank(state).desc()]


def close_key(state: Column) -> Column:
    """2000 + until, 1000 + opening, 0."""
    return F.when(F.coalesce(state["open"], F.lit(False)), 2000 + state["until"]).when(state["opens_at"].isNotNull(), 1000 + state["opens_at"]).otherwise(0)


def cheap_key(c: Column) -> Column:
    """No budget sorts last (T05); the low end decides before the high one."""
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(9000))


def japanese_order(kana: Column, name: Column) -> Column:
    """Reading, else name, by Japanese collation."""
    return F.collate(F.coalesce(F.nullif(kana, F.lit("")), name), "ja")
