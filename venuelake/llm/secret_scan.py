r"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a text is a blob, addressed by the SHA-256 of its content. The ledger, a folder of Parquet files,
says which (blob, rule version) pairs were scanned and what they held. A run compares addresses with the ledger
first; only the texts of blobs with unseen pairs move, each blob once however many paths hold it. Their findings are
appended, and those of all blobs are joined back to all paths. Rows that the ledger has twice, as after a retried
append, count once.

A rule is a Java pattern, the group whose length counts, and the least length; matches are leftmost and do not
overlap, and those that are too short are dropped after matching. Offsets are code points, end exclusive: the
pieces between the matches (``split``) and the matches (``regexp_extract_all``) are measured, and summed up in a window.

Patterns and spans take time in proportion to the text. Null texts count as empty. Rows with null ids and repeated rows keep a
row each. Path columns called ``blob`` or ``found`` are replaced by the operator's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import exists, materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    #: A pattern that has the matches of ``pattern`` that are long enough, and no others.
    tight: str = ""
    #: A cheaper pattern that every text with a kept match satisfies.
    probe: str = ""


#: The base rules, in the order that settles ties between spans with the same start.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, tight=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, tight=r"[0-9a-f]{24,}", probe=r"[0-9a-f]{24}"),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1),
    Rule("repo_token", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("web_token", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 40),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob string, kind string, version int, spans array<struct<start int, end int>>"


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, own, part>>: lengths of a rule's matches, of what lies before each, and of the part that counts."""
    pattern = rule.tight or rule.pattern
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else every
    # one more piece than there are matches; the last lies behind them
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), every.alias("own"), part.alias("part"))
    lengths = F.transform(F.slice(found, 1, F.size(every)), lambda m: F.struct(*[F.length(m[c]).alias(c) for c in ("gap", "own", "part")]))
    return F.when(text.rlike(rule.probe or pattern), lengths).otherwise(F.array().cast("array<struct<gap:int,own:int,part:int>>"))


def _spans(matches: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, spans) of ``matches``(blob, kind, version, found), by running sums over the matches of a pair.

    A row for each match is sorted, so a text with any number of spans takes time in proportion to them.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    clean = matches.where(F.size("found") == 0).select("blob", "kind", "version", none.alias("spans"))
    each = matches.where(F.size("found") > 0).select("blob", "kind", "version", F.posexplode("found").alias("at", "m"))
    upto = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.own")).over(upto).cast("int")
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    placed = each.withColumn("end", end).withColumn("span", F.when(F.col("m.part") >= least[F.col("kind")], F.struct((F.col("end") - F.col("m.own")).alias("start"), "end")))
    kept = placed.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return clean.unionByName(kept)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, new): ``versions``(path columns, text) with their blob, and the ledger rows that had to be made.

    ``new`` has a row for each unseen blob and rule version, with or without spans, so that appending it to the
    ledger makes the next run skip them.
    """
    path = [c for c in versions.columns if c.lower() not in ("text", "blob", "found")]
    text = F.coalesce("text", F.lit(""))
    keyed = versions.select(*path, text.alias("text"), F.sha2(text, 256).alias("blob"))
    # any one path of a blob can give its text; rows that share an address give the same result and are made one below
    address = F.xxhash64(*path) if path else F.lit(0).cast("long")
    blobs = keyed.select("blob", address.alias("at")).groupBy("blob").agg(F.min("at").alias("at"))
    every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        none = F.array().cast("array<struct<kind:string,version:int>>")
        blobs = blobs.join(seen, "blob", "left").select("blob", "at", F.array_except(every, F.coalesce("seen", none)).alias("due"))
    else:
        blobs = blobs.withColumn("due", every)
    # written, so that few unseen blobs are broadcast, and many are met by plain exchanges
    blobs = materialize(blobs.where(F.size("due") > 0).withColumnRenamed("blob", "of"), "due")
    texts = keyed.join(blobs, (F.col("blob") == F.col("of")) & (address == F.col("at"))).select("blob", "due", "text")
    entries = F.array_compact(F.array(*[
        F.when(
            F.array_contains("due", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _matches(F.col("text"), r).alias("found")),
        )
        for r in rules
    ]))
    scanned = texts.select("blob", entries.alias("entries")).groupBy("blob").agg(F.first("entries").alias("entries"))
    matches = materialize(scanned.select("blob", F.explode("entries").alias("e")).select("blob", "e.kind", "e.version", "e.found"), "matches")
    return keyed.drop("text"), _spans(matches, rules)


def update(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): scans what the ledger in ``folder`` lacks, appends it there, and reads the whole ledger back."""
    spark = versions.sparkSession
    known = spark.read.schema(LEDGER).parquet(folder) if exists(spark, folder) else None
    paths, new = scan(versions, known, rules)
    new.write.mode("append").parquet(folder)
    return paths, spark.read.schema(LEDGER).parquet(folder)


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each path with ``found``: array of struct<start, ord, kind, end> of its blob, sorted. Empty for clean blobs."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    hits = ledger.where((F.size("spans") > 0) & (F.col("version") == current[F.col("kind")]))
    entry = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("ord"), F.col("kind").alias("kind"), s["end"].alias("end")))
    by_blob = hits.select("blob", entry.alias("found")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("found"))).alias("found"))
    by_blob = materialize(by_blob, "findings")  # the join below then has plain exchanges, and a hot blob can be split
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    return paths.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", empty))
