"""Entity resolution: name cores, match ranks, precedence of positions, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship_package


def cores_match(a: Column, b: Column) -> Column:
    """Two core arrays agree: one equal, or one of at least three characters inside the other."""
    shorter = lambda x, y: F.least(F.length(x), F.length(y)) >= 3
    return F.exists(a, lambda x: F.exists(b, lambda y: (x == y) | (shorter(x, y) & (F.contains(x, y) | F.contains(y, x)))))


def match_score(cores: Column, name: Column) -> Column:
    """struct<score, hit> of a candidate's folded name (J08): 3 if it is the first core, 2 if it holds a core or, from three
    characters on, the first core holds it, else 0. ``hit`` is the length of the longest core that it holds."""
    hit = F.coalesce(F.array_max(F.transform(F.filter(cores, lambda c: F.contains(name, c)), lambda c: F.length(c))), F.lit(0))
    first = F.get(cores, F.lit(0))
    inside = (F.length(name) >= 3) & F.contains(first, name)
    score = F.when((name == "") | first.isNull(), 0).when(name == first, 3).when((hit > 0) | inside, 2).otherwise(0)
    return F.struct(score.alias("score"), hit.alias("hit"))


#: Fixed metres: a candidate is at the address itself; a short hit counts up to here.
AT_ADDRESS, SHORT_HIT_WITHIN = 40, 80


def is_close(level: Column, distance: Column) -> Column:
    """With a position good to the house, a candidate right at it beats a better name further away."""
    return (level == "number") & (distance <= AT_ADDRESS)


def best_match(pairs: DataFrame, key: str, score: Column, distance: Column, hit: Column, close: Column, take: list[str], tie: str) -> DataFrame:
    """The best candidate of each key by (close, nearer if close, score, nearer).

    A hit of up to three characters counts nearby only, unless the whole name agrees. Ties go to the smallest ``tie``.
    """
    ok = (score > 0) & ~((score == 2) & (hit > 0) & (hit <= 3) & (distance > SHORT_HIT_WITHIN))
    near = F.coalesce(close, F.lit(False))
    rank = F.struct(near.cast("int").alias("a"), F.when(near, -distance).otherwise(0.0).alias("b"), score.alias("c"), (-distance).alias("d"), (-F.col(tie)).alias("e"))
    return pairs.where(ok).groupBy(key).agg(F.max_by(F.struct(*take), rank).alias("_m")).select(key, "_m.*")


#: Fixed metres: how far a match may be from a position of this precision.
GATES = {"number": 150.0, "block": 300.0}
GATE_ELSE = 700.0


def gate(level: Column, is_area: Column | None = None) -> Column:
    """How far a match may lie from an address of a level; areas and alleys may lie as far as the coarsest."""
    if is_area is not None:
        return F.when(F.coalesce(is_area, F.lit(False)), GATE_ELSE).otherwise(gate(level))
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in GATES.items()], F.lit(GATE_ELSE))


def address_level(title: Column) -> Column:
    """Precision of a geocoder's title, the finest sign first."""
    return F.when(title.contains("号"), "number").when(title.contains("番"), "block").when(title.contains("丁目"), "district").otherwise("town")


def same_place(a: Column, b: Column) -> Column:
    """Two ``text.address_key``: ward and town agree, and the numbers as in ``same_address`` (J13); false without a key."""
    return F.coalesce((a["ward"] == b["ward"]) & (a["town"] == b["town"]) & same_address(a["numbers"], b["numbers"]), F.lit(False))


def not_on_map(members: Column, children: Column) -> Column:
    """Members that no child's name holds, and that hold no child's name up to its bracket."""
    short = lambda c: F.regexp_replace(c, "[（(].*$", "")
    return F.filter(members, lambda m: ~F.exists(children, lambda c: F.contains(c, m) | F.contains(m, short(c))))


def same_address(a: Column, b: Column) -> Column:
    """Number arrays agree on their first two parts, or on all that the shorter one has."""
    n = F.least(F.size(a), F.size(b), F.lit(2))
    return (n > 0) & (F.slice(a, 1, n) == F.slice(b, 1, n))


def cross_check(df: DataFrame, first: DataFrame, second: DataFrame, first_id: str, second_id: str, take: list[str]) -> DataFrame:
    """``df`` with the pin columns ``take`` of the first table by ``first_id``, or of the second by ``second_id``.

    Both tables have a row for each id at most. Null ids match nothing, and the columns are null without a pin.
    """
    a = first.select(F.col("id").alias("_a"), F.struct(*take).alias("_p"))
    b = second.select(F.col("id").alias("_b"), F.struct(*take).alias("_q"))
    joined = df.join(a, df[first_id] == F.col("_a"), "left").join(b, df[second_id] == F.col("_b"), "left")
    pin = F.coalesce("_p", "_q")
    return joined.select(*[df[c] for c in df.columns], *[pin[c].alias(c) for c in take])


def labelled_ids(choices: DataFrame, key: str, labels: str, lookup: DataFrame) -> DataFrame:
    """(key, ids): the ids of an array of labels, in its order (J22). ``lookup``(key, label, id); unknown labels are left out."""
    each = choices.select(key, F.posexplode(labels).alias("_pos", "label"))
    return each.join(lookup, [key, "label"]).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "id"))), lambda x: x["id"]).alias("ids"))


def on_sheet(px: Column, py: Column, size: int, own: Column, parent: Column) -> Column:
    """``member`` or ``other`` for rows on a sheet of ``size`` pixels, else null."""
    inside = (px >= 0) & (px < size) & (py >= 0) & (py < size)
    return F.when(inside, F.when(F.coalesce(parent == own, F.lit(False)), "member").otherwise("other"))


def repaired(df: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` replaced where ``fresh`` has the key and a value (J20); fresh keys are distinct."""
    new = fresh.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(new, df[key] == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_{c}", df[c]).alias(c) if c in columns else df[c] for c in df.columns])


def direct_else_search(direct: DataFrame, hits: DataFrame, agrees: Column, queries: int = 2, each: int = 4) -> DataFrame:
    """(key, store): the store a row names itself, else the first search hit whose address agrees.

    ``direct``(key, store); ``hits``(key, store, query, place, ...), numbered from 0: the first ``each`` hits of the
    first ``queries`` searches are looked at. Each key keeps its least (query, place), without a sort of its hits.
    """
    own = direct.where("store is not null").select("key", "store", F.lit(-1).alias("query"), F.lit(0).alias("place"))
    found = hits.where((F.col("query") < queries) & (F.col("place") < each) & agrees).select("key", "store", F.col("query").cast("int"), F.col("place").cast("int"))
    every = own.unionByName(found)
    return every.groupBy("key").agg(F.min_by("store", F.struct("query", "place", "store")).alias("store"))


def ledger_address(c: Column) -> Column:
    """The address up to its numbers, from the prefecture on, or the empty string."""
    flat = F.regexp_replace(text.nfkc(F.coalesce(c, F.lit(""))), r"(?U)(?<=\d)号.*$", "")
    flat = F.regexp_replace(flat, r"(?U)(?<=\D)\s+(?=\d)|\s+(?=\D)", "")
    for old, new in (("丁目", "-"), ("番地", "-"), ("番", "-"), ("号", "")):
        flat = F.replace(flat, F.lit(old), F.lit(new))
    return F.regexp_extract(F.regexp_replace(flat, "[−－‐–—]", "-"), r"(?U)^(東京都.+?[区市町村].*?\d+(?:-\d+){1,2})", 1)


def reconcile(candidates: DataFrame, spots: DataFrame, key: str) -> DataFrame:
    """``key``, state (7 labels) and ``matches``, the sorted ids of all spots that agree.

    ``candidates``(key, name, aliases, area, address, spot_id), keys distinct; ``spots``(id, name, area, ward, address,
    status), ids distinct strings. A candidate with an id is held against that spot only, its name and area checked.
    Others match by name and area; an area that is empty agrees with all. Without such a match the address decides.
    """
    ship_package(candidates.sparkSession)
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: F.coalesce(n, F.lit("")) != "")
    c = candidates.select(F.col(key).alias("_key"), some("spot_id").alias("_sid"), F.explode_outer(given).alias("_n"), text.norm_ledger(F.col("area")).alias("_area"), ledger_address(F.col("address")).alias("_addr"))
    c = c.withColumn("_n", F.when(F.col("_n").isNotNull(), text.norm_ledger(F.col("_n"))))
    s = spots.select(F.col("id").alias("_id"), text.norm_ledger(some("name")).alias("_name"), text.norm_ledger(some("area")).alias("_sarea"), text.norm_ledger(some("ward")).alias("_ward"), ledger_address(F.col("address")).alias("_saddr"), (some("status") == "closed").alias("_closed"))
    places = F.array_distinct(F.array(F.lit(""), "_sarea", "_ward"))

    with_id = c.where("_sid <> ''").join(s, F.col("_sid") == F.col("_id"), "left").groupBy("_key").agg(
        F.first("_id").alias("_id"), F.first("_closed").alias("_closed"),
        F.max(F.coalesce((F.col("_n") == F.col("_name")) & F.array_contains(places, F.col("_area")), F.lit(False))).alias("_ok"),
    )
    by_id = with_id.select(
        "_key", F.when(F.col("_id").isNull(), "参照先なし").when(~F.col("_ok"), "参照不一致").when(F.col("_closed"), "閉店掲載").otherwise("掲載あり").alias("state"),
        F.when(F.col("_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("_id")).alias("matches"),
    )

    c = c.where("_sid = ''")
    placed = s.select("_id", "_name", F.explode(places).alias("_place"))
    named = c.select("_key", "_n", "_area").distinct().join(placed, (F.col("_n") == F.col("_name")) & (F.col("_area") == F.col("_place")))
    named = named.groupBy("_key").agg(F.sort_array(F.collect_set("_id")).alias("_named"))
    rest = c.select("_key", "_addr").distinct().join(named, "_key", "left")
    at = rest.where("_named is null and _addr <> ''").join(s.select("_id", "_saddr"), F.col("_addr") == F.col("_saddr"))
    at = at.groupBy("_key").agg(F.sort_array(F.collect_set("_id")).alias("_at"))
    others = rest.join(at, "_key", "left").select(
        "_key", F.when(F.col("_named").isNotNull(), "候補一致・要確認").when(F.col("_at").isNotNull(), "住所候補・要確認").otherwise("一致未確認").alias("state"),
        F.coalesce("_named", "_at", F.array().cast("array<string>")).alias("matches"),
    )
    return by_id.unionByName(others).withColumnRenamed("_key", key)
