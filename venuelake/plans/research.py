"""From research to publishable facts: the projection of what was written down, and the merge of three fact sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hours_parse, listing, rules, text
from ..operators.merge import first_known
from ..session import ship_package

#: Fixed columns of the projection, by how they are read.
TEXTS = [
    "name", "yokocho", "area", "ward", "address", "address_detail", "station", "hours", "closed", "budget", "payment", "smoking", "desc", "talk", "tips", "since",
    "checked", "where",
]
RENAMED = {"name_kana": "kana", "name_en": "en", "price_note": "price"}
RATINGS, NUMBERS, FLAGS = ["social", "solo"], ["budget_min", "budget_max", "shops"], ["hiru", "english"]
#: Fixed kinds, other names for them, and states.
KINDS = ["yokocho", "senbero", "tachinomi", "kakuuchi", "bar", "social", "sakaba"]
KIND_NAMES = {"izakaya": "senbero", "standing": "tachinomi", "snack": "bar"}
STATES = ["open", "closed", "uncertain"]
#: Fixed bounds of lists.
MOST_TAGS, MOST_SOURCES, MOST_MEMBERS = 12, 4, 20


def _truth(c: Column, kind: str) -> Column:
    """What counts as true: true itself, a text, a number but 0."""
    said = c if kind == "boolean" else text.clean_text(c).isNotNull() if kind == "string" else c != 0
    return F.coalesce(said, F.lit(False))


def projected(raw: DataFrame) -> DataFrame:
    """The 34 columns of a venue out of ``raw``, which may lack any of them, then lat, lng, pinned.

    Texts are stripped and null if empty, ratings lie between 1 and 5 (3 if unreadable), unknown kinds become bars and unknown
    states uncertain, lists lose what is no text and keep their first entries. Pins are [lat, lng]; the operator's goes first.
    Null lists are empty, a null id is the empty text. Rows are neither joined nor merged, so repeated rows stay.
    """
    kinds = dict(raw.dtypes)
    of = lambda c, kind="string": F.col(c) if c in kinds else F.lit(None).cast(kind)
    strings = lambda c: F.filter(F.coalesce(of(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    out = {"id": text.slug(F.coalesce(text.strip_all(of("id")), F.lit("")))}
    out |= {c: text.clean_text(of(c)) for c in TEXTS}
    out |= {new: text.clean_text(of(old)) for old, new in RENAMED.items()}
    out["kind"] = F.coalesce(text.enum_of(text.clean_text(of("kind")), KINDS, KIND_NAMES, "bar"), F.lit("bar"))
    out["status"] = F.coalesce(text.enum_of(text.clean_text(of("status")), STATES, {}, "uncertain"), F.lit("uncertain"))
    out |= {c: text.clamp(of(c), 1, 5, 3) for c in RATINGS}
    out |= {c: text.safe_int(of(c)) for c in NUMBERS}
    out |= {c: _truth(of(c), kinds.get(c, "string")) for c in FLAGS}
    out["tags"] = F.slice(strings("tags"), 1, MOST_TAGS)
    out["sources"] = text.url_list(strings("sources"), MOST_SOURCES)
    members = F.filter(F.transform(strings("members"), text.strip_all), lambda m: m != "")
    out["members"] = F.slice(members, 1, MOST_MEMBERS)
    pin = rules.pinned(of("official_pin", "array<double>"), of("pin", "array<double>"))
    out |= {"lat": F.get(pin["at"], F.lit(0)), "lng": F.get(pin["at"], F.lit(1)), "pinned": pin["pinned"]}
    return raw.select(*[c.alias(k) for k, c in out.items()])


#: Fixed names of the sources.
LISTING_A, LISTING_B, OWN, REVIEWS, PRESS = "食べログ", "ホットペッパー", "調査", "口コミ", "口コミ・記事"
#: Fixed precedence of each fact: a letter for each source (a, b: listings, s: own research, e: reviews).
FACTS = {
    "pay": "abs", "seats": "ab", "seats_note": "ab", "seating": "a", "smoking": "abs", "charge": "abe", "reserve": "a", "phone": "a", "drinks": "a", "opened": "a",
    "budget_dinner": "ab", "budget_lunch": "ab",
}
OWN_NAMES = {"pay": "payment"}
SAID = ["catch", "crowd", "busy", "vibe", "first", "talk2"]
FIXES = ["desc", "talk", "tips", "price", "since"]
STALE_BEFORE, MOST_RULES, MOST_DISHES, MOST_LINKS = 2024, 8, 6, 4


def merged_info(venues: DataFrame, first: DataFrame, second: DataFrame, reviews: DataFrame, key: str = "id") -> DataFrame:
    """One row of facts for each venue (J01), out of its research, two listings and what reviews say, with the source of each.

    The three tables have a row for each key at most and may lack columns and rows; a fact has one type wherever it occurs.
    What no source knows is null. Weeks come from a listing, else from the research text, unless that is an area's or stale.
    All four are joined on the key by equi joins whose strategy Spark picks, and texts are parsed only where no listing has a week.
    """
    ship_package(venues.sparkSession)
    has = {"s": venues.columns, "a": first.columns, "b": second.columns, "e": reviews.columns}
    joined = venues.select(key, F.struct("*").alias("s"))
    for letter, df in (("a", first), ("b", second), ("e", reviews)):
        joined = joined.join(df.select(key, F.struct("*").alias(letter)), key, "left")
    of = lambda s, c, kind="string": F.col(s)[c] if c in has[s] else F.lit(None).cast(kind)
    text_of = lambda s, c: F.nullif(of(s, c), F.lit(""))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    listed = lambda s: some(of(s, "week", hours_parse.WEEK))

    is_area = of("s", "kind").eqNullSafe("yokocho")
    joined = joined.withColumn("_text", F.when(~listed("a") & ~listed("b") & ~is_area, of("s", "hours")))
    joined = joined.withColumn("_parsed", hours_parse.parse_free(F.col("_text"), of("s", "closed")))
    stale = text.stale_note(F.concat(F.coalesce(of("s", "hours"), F.lit("")), F.coalesce(of("s", "closed"), F.lit(""))), STALE_BEFORE)
    week = listing.hours_source(of("a", "week", hours_parse.WEEK), of("b", "week", hours_parse.WEEK), F.col("_parsed"), is_area, stale)
    by_listing = listed("a") | listed("b")
    out, src = {"week": week["week"], "week_from_text": F.when(week["source"] == "text", True)}, {}
    out["hours"] = F.when(listed("a"), of("a", "hours")).when(listed("b"), of("b", "hours")).otherwise(text_of("s", "hours"))
    src["hours"] = F.when(listed("a"), LISTING_A).when(listed("b"), LISTING_B).when(text_of("s", "hours").isNotNull(), OWN)
    out["hours_research"] = F.when(by_listing, of("s", "hours"))
    closed = first_known((of("b", "closed"), LISTING_B), (of("s", "closed"), OWN))
    own_closed = listed("a") & text_of("s", "closed").isNotNull()
    out["closed"] = F.when(own_closed, of("s", "closed")).otherwise(closed["value"])
    src["closed"] = F.when(own_closed, OWN).otherwise(closed["source"])

    names = {"a": LISTING_A, "b": LISTING_B, "s": OWN, "e": REVIEWS}
    for fact, order in FACTS.items():
        columns = [(s, OWN_NAMES.get(fact, fact) if s == "s" else fact) for s in order]
        known = [(of(s, c), names[s]) for s, c in columns if c in has[s]]
        value = first_known(*known) if known else None
        out[fact], src[fact] = (value["value"], value["source"]) if known else (F.lit(None).cast("string"),) * 2
    cash = of("a", "cash_only", "boolean")
    out["cash_only"] = listing.cash_only(cash.isNotNull(), cash, of("b", "cash_only", "boolean"), of("s", "payment"))
    out["score"] = F.nullif(of("a", "score", "double"), F.lit(0).cast("double"))
    web = F.coalesce(text_of("a", "web"), text_of("e", "web"))
    urls = {"tabelog": text_of("a", "url"), "hotpepper": text_of("b", "url")}
    urls |= {k: F.when(c.rlike("^https?://"), c) for k, c in (("web", web), ("insta", of("e", "insta")), ("x", of("e", "x")))}
    links = _present(urls)
    out["links"] = F.when(some(links), links)

    for c in SAID:
        out[c] = text_of("e", c)
        src[c] = F.when(out[c].isNotNull(), PRESS)
    lines = of("e", "rules", "array<string>")
    out["rules"] = F.when(some(lines), F.slice(F.filter(lines, lambda r: F.coalesce(r != "", F.lit(False))), 1, MOST_RULES))
    dishes = of("e", "menu", "array<struct<n:string,p:string>>")
    out["menu"] = F.when(some(dishes), F.slice(F.filter(dishes, lambda m: F.coalesce(m["n"] != "", F.lit(False))), 1, MOST_DISHES))
    out["checked_reviews"] = text_of("e", "checked")
    out["status_note"] = listing.status_note(of("s", "status"), of("e", "status"))
    fixes = of("e", "fix", "map<string,string>")
    out |= {f"fix_{c}": F.nullif(F.try_element_at(fixes, F.lit(c)), F.lit("")) for c in FIXES}
    added = of("e", "sources_add", "array<string>")
    out["sources_add"] = F.when(some(added), text.url_list(added, MOST_LINKS))
    out["src"] = _present(src)
    return joined.select(key, *[c.alias(k) for k, c in out.items()])


def _present(values: dict[str, Column]) -> Column:
    """map<name, value> of the values that are not null."""
    entries = [F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.alias("value"))) for k, c in values.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))
