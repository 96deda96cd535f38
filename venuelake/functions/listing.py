"""Facts that listing pages state in words, the sources they are taken from, and the orders a map draws in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_rule

#: Fixed phrases of pages in English, what they are called here, and words inside their notes.
PAYMENTS = {"Credit card": "カード", "Electronic money": "電子マネー", "QR code payments": "QR決済"}
NOTE_WORDS = {"Transportation IC cards (e.g., Suica": "交通系IC", "d Barai": "d払い", "Rakuten Pay": "楽天ペイ", ", ": "・"}
#: Fixed words for nothing.
NO_CHARGE = ["なし", "無し", "ありません"]


def payment_english(text: Column) -> Column:
    """struct<pay, cash_only>: what is accepted, with notes; both null if the text names no way of paying."""
    parts = []
    for phrase, name in PAYMENTS.items():
        note = F.regexp_extract(text, rf"{phrase} accepted(?: \(([^)]*)\))?", 1)
        for a, b in NOTE_WORDS.items():
            note = F.replace(note, F.lit(a), F.lit(b))
        parts.append(F.when(F.contains(text, F.lit(f"{phrase} accepted")), F.concat(F.lit(name), F.when(note != "", F.concat(F.lit("（"), note, F.lit("）"))).otherwise(""))))
    accepted = F.array_compact(F.array(*parts))
    known = text.rlike("Credit card|Electronic money|QR code")
    refused = (F.size(accepted) == 0) & F.contains(text, F.lit("Credit cards not accepted"))
    pay = first_rule((~known, None), (refused, "現金のみ"), (F.size(accepted) > 0, F.concat(F.lit("現金・"), F.array_join(accepted, "・"), F.lit("可"))))
    return F.struct(F.when(known, pay).alias("pay"), F.when(known, refused).alias("cash_only"))


def payment_japanese(text: Column) -> Column:
    """struct<pay, cash_only> of the payment cells of a page in Japanese; null where they are blank."""
    has = lambda word: F.contains(text, F.lit(word))
    accepted = F.array_compact(F.array(
        F.when((has("カード可") | has("利用可")) & ~has("カード不可"), "カード"), F.when(has("電子マネー可"), "電子マネー"), F.when(has("QRコード決済可"), "QR決済"),
    ))
    pay = F.when(F.size(accepted) > 0, F.concat(F.lit("現金・"), F.array_join(accepted, "・"), F.lit("可"))).otherwise("現金のみ")
    said = F.trim(text) != ""
    return F.struct(F.when(said, pay).alias("pay"), F.when(said, F.size(accepted) == 0).alias("cash_only"))


def smoking_english(text: Column) -> Column:
    return first_rule(
        (text.startswith("Non smoking") | text.contains("No smoking"), "全席禁煙"),
        (text.contains("Separate smoking") | text.contains("Smoking room") | F.lower(text).contains("smoking area"), "分煙・喫煙所あり"),
        (text.contains("Smoking allowed") | text.contains("Smoking is allowed"), "喫煙可"),
    )


def smoking_japanese(text: Column) -> Column:
    return first_rule((text.rlike("全面禁煙|全席禁煙"), "全席禁煙"), (text.contains("喫煙可"), "喫煙可"), (text.rlike("分煙|喫煙専用"), "分煙・喫煙所あり"))


def reservation(text: Column) -> Column:
    return first_rule((text.contains("unavailable"), "予約不可"), (F.lower(text).contains("only"), "完全予約制"), (text.contains("available"), "予約可"))


def charge_text(original: Column) -> Column:
    """The charge as the page states it; words for nothing become one phrase."""
    return first_rule((original.isin(NO_CHARGE), "チャージなし"), (original != "", original))


def status_note(base: Column, review: Column) -> Column:
    """What reviews say of a venue's state, for venues that count as open only (C11)."""
    return F.when((base == "open") & review.isin("closed", "uncertain"), review)


def hours_source(first: Column, second: Column, parsed: Column, is_area: Column, stale: Column) -> Column:
    """struct<week, source>: the first listing with a week, the second, then the parsed text unless it is an area's or stale.

    An empty week is no week; where nothing has one the result is null.
    """
    some = lambda w: F.coalesce(F.size(w) > 0, F.lit(False)) & w.isNotNull()
    usable = some(parsed) & ~F.coalesce(is_area, F.lit(False)) & ~F.coalesce(stale, F.lit(False))
    rules = [(some(first), first, "first"), (some(second), second, "second"), (usable, parsed, "text")]
    return first_rule(*[(c, F.struct(w.alias("week"), F.lit(s).alias("source"))) for c, w, s in rules])


def cash_only(has_first: Column, first: Column, second: Column, text: Column) -> Column:
    """The first listing's value where it has the key, even if null, else the second's, else what the text says."""
    return F.coalesce(F.when(has_first, first).otherwise(second), F.when(text != "", text.contains("現金のみ")))


def source_id(sources: Column, pattern: str) -> Column:
    """Group 1 of the first link that has the pattern (J24); null without one."""
    hit = F.get(F.filter(sources, lambda u: u.rlike(pattern)), F.lit(0))
    return F.nullif(F.regexp_extract(hit, pattern, 1), F.lit(""))


def not_a_street(footway: Column, highway: Column, service: Column) -> Column:
    """Ways that are no street of their own (F15); never null."""
    side = footway.isin("sidewalk", "crossing", "traffic_island")
    return F.coalesce(side, F.lit(False)) | F.coalesce((highway == "service") & service.isin("parking_aisle", "drive-through"), F.lit(False))


def build_order(regions: list[str], region: Column, area: Column, is_area: Column, key: Column) -> list[Column]:
    """Regions in their fixed order, areas by code point, whole areas first (T01); unknown regions come last."""
    place = F.array_position(F.array(*[F.lit(r) for r in regions]), region)
    return [F.when(place > 0, place).otherwise(len(regions) + 1), area, (~is_area).cast("int"), key]


def draw_priority(kind: Column, rank: Column) -> Column:
    """What is labelled first (T09): higher is earlier."""
    return first_rule((kind == "station", 100 + 10 * rank), (kind == "place", 40 + 15 * rank), default=30)


def tile_priority(tx: Column, ty: Column, size: float, cx: float, cy: float, is_building: Column) -> Column:
    """Squared distance of a tile's centre to the view's; buildings come after all streets."""
    dx, dy = (tx + 0.5) * size - cx, (ty + 0.5) * size - cy
    return dx * dx + dy * dy + F.when(is_building, 1e12).otherwise(0.0)
