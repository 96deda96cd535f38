"""Text expressions: cleaning, folding, keys and extraction. All but the NFKC forms and ``unescape_html`` stay in the JVM."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; null becomes empty (ST01). Spark has no built-in for it."""
    return s.fillna("").map(lambda x: unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Character references become characters (ST15)."""
    return s.map(lambda x: html.unescape(x) if x is not None else None)


def strip_all(c: Column) -> Column:
    """Trim every Unicode blank, the ideographic space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip_all(c), F.lit(""))


def clamp(c: Column, low: int, high: int, default: int) -> Column:
    """Whole number within bounds; what can't be read is the default."""
    n = c.try_cast("int")  # greatest and least pass nulls over
    return F.when(n.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), n)))


def safe_int(c: Column) -> Column:
    return c.try_cast("int")


def enum_of(c: Column, allowed: list[str], aliases: dict[str, str], default: str) -> Column:
    """A value of ``allowed`` after aliases, else the default."""
    mapped = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in aliases.items()], c)
    return F.when(mapped.isin(allowed), mapped).otherwise(default)


def url_list(c: Column, most: int) -> Column:
    """The first links of an array."""
    return F.slice(F.filter(c, lambda x: x.isNotNull() & x.startswith("http")), 1, most)


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


#: Fixed words that mean that nothing is known.
NOTHING = ["null", "none", "不明"]


def scrub(c: Column, limit: int) -> Column:
    """Blanks collapsed, placeholder words and empty text null, cut to a length."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.lower(flat).isin(NOTHING) | (flat == ""), None).otherwise(F.substring(flat, 1, limit))


def first_sentence(c: Column, stop: str) -> Column:
    """Up to and with the first stop sign."""
    return F.when(c.contains(stop), F.concat(F.substring_index(c, stop, 1), F.lit(stop))).otherwise(c)


def kana_fold(c: Column) -> Column:
    """Katakana become hiragana (ST05)."""
    return F.translate(c, _KATAKANA, _HIRAGANA)


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    """Unicode NFKC, then case folding, which also writes the sharp s as two; null becomes empty."""
    return s.fillna("").map(lambda x: unicodedata.normalize("NFKC", x).casefold())


#: Fixed characters that the forms of a name drop; blanks are dropped too.
SEARCH_DROPS = r"[\s・･·,、。.]"
NAME_DROPS = r"[\s・･\-‐ー−~〜'\"’”“「」『』()（）【】\[\]!！?？.,、。&＆]"
LEDGER_DROPS = r"[\s・･（）()\-－ー]"
CORE_DROPS = r"[\s・･'\"’”“「」『』()（）【】\[\]!！?？.,、。]"


def norm_search(c: Column) -> Column:
    """Search form: width and case folded, blanks and separators dropped, the long mark kept (ST03)."""
    return F.regexp_replace(kana_fold(F.lower(nfkc(c))), "(?U)" + SEARCH_DROPS, "")


def search_token(token: str) -> str:
    """The search form of a word of a query."""
    flat = unicodedata.normalize("NFKC", token).lower().translate(str.maketrans(_KATAKANA, _HIRAGANA))
    return re.sub(SEARCH_DROPS, "", flat)


def norm_name(c: Column) -> Column:
    """Name form: punctuation and the long mark dropped (ST02)."""
    return kana_fold(F.regexp_replace(F.lower(nfkc(c)), "(?U)" + NAME_DROPS, ""))


def norm_ledger(c: Column) -> Column:
    """Ledger form: separators, brackets, hyphens and the long mark dropped (ST04)."""
    return F.regexp_replace(kana_fold(nfkc_casefold(c)), "(?U)" + LEDGER_DROPS, "")


def raw_core(c: Column) -> Column:
    """Width folded; punctuation, brackets and blanks dropped, script and long mark kept (ST06)."""
    return F.regexp_replace(nfkc(c), "(?U)" + CORE_DROPS, "")


def search_document(*fields: Column) -> Column:
    """All fields in one; as blanks go, a word may match across two fields."""
    return norm_search(F.concat_ws(" ", *fields))


def has_all_tokens(document: Column, query: str) -> Column:
    """Each blank-separated token of the query is in the document (F09); no token matches all.

    Tokens are folded here, once; the document is a column that should be made once too.
    """
    found = F.lit(True)
    for token in filter(None, map(search_token, query.split())):
        found &= F.contains(document, F.lit(token))
    return found


#: Fixed signs of Japanese addresses.
DASHES = ["−", "ー", "―", "‐"]
BLOCK_SIGNS = [("丁目", "-"), ("番地", "-"), ("番", "-"), ("号", ""), ("−", "-"), ("ー", "-")]
POST_CODE = r"^〒?\d{3}-?\d{4}"
UP_TO_BLOCK = r"^(.*?\d+(?:丁目)?(?:[-の]\d+){0,3}(?:番地?)?(?:\d+号?)?)"
WARD_TOWN_NUMBER = r"([^都道府県]+?[区市町村])(.+?)(\d+(?:-\d+){0,2})"


def clean_address(c: Column) -> Column:
    """Width folded, dashes unified, blanks and post code dropped, cut behind the block or house number (ST12)."""
    flat = F.translate(nfkc(c), "".join(DASHES), "-" * len(DASHES))
    flat = F.regexp_replace(F.regexp_replace(flat, r"(?U)\s+", ""), POST_CODE, "")
    found = F.regexp_extract(flat, UP_TO_BLOCK, 1)
    return F.when(found != "", found).otherwise(flat)


def address_key(c: Column) -> Column:
    """struct<ward, town, numbers> of an address (ST13), null without a number.

    The last four characters of the ward and the last six of the town; numbers as they are written.
    """
    flat = nfkc(c)
    for sign, dash in BLOCK_SIGNS:
        flat = F.replace(flat, F.lit(sign), F.lit(dash))
    part = lambda k: F.regexp_extract(flat, WARD_TOWN_NUMBER, k)
    town = F.regexp_replace(part(2), r"(?U)\s", "")
    key = F.struct(F.right(part(1), F.lit(4)).alias("ward"), F.right(town, F.lit(6)).alias("town"), F.split(part(3), "-").alias("numbers"))
    return F.when(part(3) != "", key)


def html_to_text(c: Column, entities: bool | dict[str, str] = True) -> Column:
    """Tags become blanks, references characters, blanks collapse (ST15).

    ``entities``: all references, none, or those given as patterns with what they become, in this order.
    """
    bare = F.regexp_replace(c, "<[^>]*>", " ")
    if isinstance(entities, dict):
        for pattern, character in entities.items():
            bare = F.regexp_replace(bare, pattern, character)
    elif entities:
        bare = unescape_html(bare)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def header_cells(page: Column, keep_first: bool = True) -> Column:
    """map<th, td> of an HTML table; of headers that repeat, the first or the last counts."""
    rows = F.arrays_zip(
        F.transform(F.regexp_extract_all(page, F.lit(r"(?s)<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))).alias("k"),
        F.transform(F.regexp_extract_all(page, F.lit(r"(?s)<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"), F.lit(2)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))).alias("v"),
    )
    ordered = rows if keep_first else F.reverse(rows)
    unique = F.aggregate(
        ordered,
        F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, r: F.when(F.exists(acc, lambda a: a["k"] == r["k"]), acc).otherwise(F.concat(acc, F.array(F.struct(r["k"].alias("k"), r["v"].alias("v"))))),
    )
    return F.map_from_entries(unique)


def map_pin(page: Column) -> Column:
    """struct<lat, lng> of the first coordinates in a page."""
    number = r"[^0-9.-]{0,4}(-?\d+(?:\.\d+)?)"
    return F.struct(*[F.regexp_extract(page, f'{k}"{number}', 1).try_cast("double").alias(a) for k, a in (("latitude", "lat"), ("longitude", "lng"))])


def anchor_ids(page: Column, pattern: str) -> Column:
    """Distinct ids of links with text, in order (S13). ``pattern`` has one group, and lies inside the tag."""
    link = rf"(?is)<a\b[^>]*?{pattern}[^>]*>(.*?)</a>"
    found = F.arrays_zip(F.regexp_extract_all(page, F.lit(link), F.lit(1)).alias("id"), F.regexp_extract_all(page, F.lit(link), F.lit(2)).alias("text"))
    said = F.filter(found, lambda m: F.regexp_replace(m["text"], "(?s)<[^>]*>|&nbsp;", "").rlike(r"(?U)\S"))
    return F.array_distinct(F.transform(said, lambda m: m["id"]))


def yen_range(c: Column) -> Column:
    """struct<low, high> of one or two amounts (ST18): one alone is the low end, or the high one behind a leading dash."""
    amounts = F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d,]*)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("int"))
    two, opened = F.size(amounts) >= 2, c.rlike(r"^\s*[-–~〜～]")
    return F.struct(
        F.when(two | ((F.size(amounts) == 1) & ~opened), F.get(amounts, F.lit(0))).alias("low"),
        F.when(two, F.get(amounts, F.lit(1))).when((F.size(amounts) == 1) & opened, F.get(amounts, F.lit(0))).alias("high"),
    )


def host_name(url: Column) -> Column:
    """The host without www. (ST22)."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def host_label(url: Column, names: dict[str, str]) -> Column:
    """The name of the first entry that the host ends with, else the host (ST22)."""
    host = host_name(url)
    return F.coalesce(*[F.when((host == k) | host.endswith("." + k), F.lit(v)) for k, v in names.items()], host)


def short_label(c: Column, most: int = 16) -> Column:
    """Without notes in brackets, cut to a length."""
    return F.substring(F.regexp_replace(c, "（.*?）", ""), 1, most)


def opening_text(c: Column) -> Column:
    """``2010.4...`` as year and month of opening; other texts as they are."""
    return F.regexp_replace(c, r"^(\d{4})\.(\d{1,2}).*$", "$1年$2月開店")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def name_note(c: Column) -> Column:
    """struct<name, note>: a note in brackets at the end is split off (ST24)."""
    note = F.regexp_extract(c, r"[(（]([^()（）]*)[)）]\s*$", 1)
    return F.struct(F.trim(F.regexp_replace(c, r"\s*[(（][^()（）]*[)）]\s*$", "")).alias("name"), F.nullif(note, F.lit("")).alias("note"))


def colour(c: Column, names: dict[str, str]) -> Column:
    """#rrggbb of a name, #rgb or #rrggbb; else null (ST26)."""
    low = F.lower(F.trim(c))
    full = F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in names.items()], F.regexp_replace(low, "^#(.)(.)(.)$", "#$1$1$2$2$3$3"))
    return F.when(full.rlike("^#[0-9a-f]{6}$"), full)


def split_top(c: Column) -> Column:
    """Parts at separators outside brackets that don't nest (ST21)."""
    return F.split(c, "[／/、,，](?![^（(]*[）)])")


def translate_words(c: Column, words: dict[str, str]) -> Column:
    """Comma list of known phrases in another language; unknown ones go (ST17)."""
    parts = F.transform(F.split(c, r"\s*,\s*"), lambda w: F.coalesce(*[F.when(F.lower(w) == k, F.lit(v)) for k, v in words.items()]))
    return F.array_compact(parts)


def stale_note(c: Column, year: int) -> Column:
    """Years are named, and the latest is before ``year``."""
    years = F.transform(F.regexp_extract_all(c, F.lit("(20[0-9]{2})年"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(years) < year, F.lit(False))
