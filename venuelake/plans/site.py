"""What is published of a venue: facts merged over the researched text, the short index, and detail buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_sentence
from ..operators.tiles import hash_bucket


def _some(c: Column, kind: str) -> Column:
    """Null for an empty text, list or map."""
    if kind == "string":
        return F.nullif(c, F.lit(""))
    return F.when(F.size(c) > 0, c) if kind.startswith(("array", "map")) else c


def published(venues: DataFrame, info: DataFrame, key: str = "id", sources: str = "sources", added: str = "sources_add") -> DataFrame:
    """``venues`` with the columns of ``info``, which has a row for each key at most.

    A column ``fix_x`` of info replaces x; a column that both have is info's where that is not empty; links that info
    adds follow the venue's own. Venues without info stay as they are; empty texts, lists and maps become null.
    """
    kinds, facts = dict(venues.dtypes), dict(info.dtypes)
    renamed = info.select(*[F.col(c).alias(f"_i_{c}") for c in info.columns])
    joined = venues.join(renamed, venues[key] == renamed[f"_i_{key}"], "left")
    of_info = lambda c: _some(F.col(f"_i_{c}"), facts[c])
    out = []
    for c in venues.columns:
        value = _some(venues[c], kinds[c])
        if c != key and c in facts:
            value = F.coalesce(of_info(c), value)
        if f"fix_{c}" in facts:
            value = F.coalesce(of_info(f"fix_{c}"), value)
        if c == sources and added in facts:
            empty = F.array().cast(kinds[c])
            own = F.coalesce(value, empty)
            value = _some(F.concat(own, F.filter(F.coalesce(of_info(added), empty), lambda u: ~F.array_contains(own, u))), kinds[c])
        out.append(value.alias(c))
    more = [c for c in info.columns if c not in kinds and c != added and not (c.startswith("fix_") and c[4:] in kinds)]
    return joined.select(*out, *[of_info(c).alias(c) for c in more])


def index(details: DataFrame, fields: list[str], key: str = "id", buckets: int = 64) -> DataFrame:
    """The columns that lists and search need, with the names on the menu, the first sentence of the description
    where there is no catch line, and the bucket that holds the rest."""
    columns = [F.col(f) for f in fields]
    if "menu" in details.columns:
        columns.append(F.col("menu.n").alias("menu"))
    if "desc" in details.columns:
        catch = F.col("catch") if "catch" in details.columns else F.lit(None).cast("string")
        columns.append(F.when(catch.isNull() | (catch == ""), first_sentence(F.col("desc"), "。")).alias("desc"))
    return details.select(*columns, hash_bucket(F.col(key).cast("string"), buckets).alias("_bucket"))
