"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_dedup, chat, classify, collocations, decontaminate, kneser_ney, near_dedup, parity_join, pieces, role_repair, secret_scan, substring_dedup
from .common import crc_bucket, new_path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_text(found: Column) -> Column:
    part = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(part, ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.findings(*secret_scan.update(versions, new_path(spark, "blob-ledger")))
    base = F.filter("found", lambda s: s["ord"] < len(secret_scan.BASE_RULES))
    count = {r.kind: _count(r.kind) for r in secret_scan.BASE_RULES}
    return found.select(
        "doc_id",
        *[n.alias(f"n_{k}") for k, n in count.items()],
        F.sha2(_span_text(base), 256).alias("base_sha256"),
        _span_text(F.col("found")).alias("spans"),
    )


def _op1_sql() -> str:
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        if r.kind == "assign":  # the SQL engine's (?i) also folds letters outside ASCII
            for word in ("password", "passwd", "secret", "token", "api_?key"):
                pattern = pattern.replace(word, "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word), 1)
            pattern = pattern.replace("(?i:", "(?:")
        lead = "''"
        if "(?<!" in pattern:  # the SQL engine has no look-behind: the character in front is matched, and taken off the span
            front, _, rest = pattern.removeprefix("(?<!").partition(")")
            pattern = f"(^|[^{front[1:-1]}]){rest.replace('++', '+')}"
            lead = f"unnest(regexp_extract_all(text, '{pattern}', 1))"
        parts.append(f"""
  SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {lead} AS lead,
         unnest(regexp_split_to_array(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}', 0))]) AS gap,
         unnest(regexp_extract_all(text, '{pattern}', 0)) AS whole,
         unnest(regexp_extract_all(text, '{pattern}', {r.group})) AS part,
         unnest(range(len(regexp_extract_all(text, '{pattern}', 0)))) AS k, {r.least} AS least
  FROM t WHERE regexp_matches(text, '{pattern}')""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS e FROM m),
s AS (SELECT doc_id, ord, kind, CAST(e - length(whole) + length(lead) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE length(part) - length(lead) >= least),
a AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (ord < 3) AS base,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans
      FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("_k1", "_k2")


_OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=4).drop("_k1", "_k2")


_OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


_OP12_SQL = (
    _OP10_SQL.replace("100 * o >= 80 *", "100 * o >= 85 *").replace(", d.doc_id = c.component_id AS kept", "")
)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.k, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.g = v.g),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


_OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS q FROM p JOIN m USING (g) WHERE least < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept FROM e ANTI JOIN c USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = classify.language(docs, crc_bucket(F.col("doc_id"), 4) != 2)
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = crc_bucket(F.col("doc_id"), 3) != 1
    found = classify.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), pieces.default_model())


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.windows(turns.unionByName(extra)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return role_repair.repair(role_repair.damaged(turns), turns.select("conv_id"))


def _op11_sql() -> str:
    """The cheapest edits by a forward table of states, a row of the conversation at a time, instead of rules and a chart.

    A state is a string, its cost in nine digits and the audit, so that the least string is the cheapest and ASCII-least.
    n: nothing kept yet, s: after system, u: after user, a: after assistant. crc32 comes from its polynomial.
    """
    more = lambda key, price, letter: f"printf('%09d', CAST(substr({key}, 1, 9) AS INT) + {price}) || substr({key}, 10) || '{letter}'"
    inserted = f"""SELECT cid, pos, n, s, u, least(a, {more('u', 3, 'I')}) AS a FROM (
      SELECT cid, pos, n, s, a, least(u, {more('n', 3, 'I')}, {more('s', 3, 'I')}, {more('a', 3, 'I')}) AS u FROM ({{inner}}))"""
    begin = inserted.format(inner="SELECT DISTINCT cid, 0::BIGINT AS pos, '000000000' AS n, '900000000' AS s, '900000000' AS u, '900000000' AS a FROM rows")
    price = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    taken = lambda key, initial: (
        f"CASE WHEN fault IN (1, 2) THEN '999999999' ELSE least({more(key, f'3 + {price}', 'R')}, CASE WHEN i = '{initial}' THEN {more(key, price, 'K')} ELSE '999999999' END) END"
    )
    step = inserted.format(inner=f"""SELECT r.cid, w.pos, {more('n', 4, 'D')} AS n,
      least({more('s', 4, 'D')}, CASE WHEN i = 's' AND fault NOT IN (1, 2) THEN {more('n', price, 'K')} ELSE '999999999' END) AS s,
      least({more('u', 4, 'D')}, {taken('n', 'u')}, {taken('s', 'u')}, {taken('a', 'u')}) AS u,
      least({more('a', 4, 'D')}, {taken('u', 'a')}) AS a
      FROM r JOIN rows w ON w.cid = r.cid AND w.pos = r.pos + 1""")
    return rf"""
WITH RECURSIVE bits(k, i, v) AS (
  SELECT 0, i, i FROM range(256) t(i) UNION ALL SELECT k + 1, i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
keys AS (SELECT DISTINCT key FROM src),
crc AS (SELECT key, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda x, c: xor(x >> 8, t[(xor(x, c) & 255) + 1])), 4294967295) % 20 AS f FROM keys, tab),
damaged AS (SELECT cid, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM src JOIN crc USING (key), (VALUES (1), (2)) c(copy) WHERE f <> 0 AND (copy = 1 OR f = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
rows AS (SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE ' ' END AS i,
  CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 THEN 2
       WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault FROM placed),
r AS ({begin} UNION ALL {step}),
best AS (SELECT cid, least(n, a) AS key FROM r QUALIFY row_number() OVER (PARTITION BY cid ORDER BY pos DESC) = 1),
edits AS (SELECT cid, k, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY cid ORDER BY k) AS pos, count(*) FILTER (e <> 'D') OVER (PARTITION BY cid ORDER BY k) AS m
  FROM (SELECT cid, unnest(string_split(substr(key, 10), '')) AS e, unnest(range(length(key) - 9)) AS k FROM best WHERE length(key) > 9)),
made AS (SELECT e.*, w.role, w.text, max(CASE WHEN m = 1 AND e = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY cid) AS led
  FROM edits e LEFT JOIN rows w USING (cid, pos)),
repaired AS (SELECT cid, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
  FROM made WHERE e <> 'D' GROUP BY cid),
counts AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(i) OVER (PARTITION BY cid ORDER BY pos) || i AS pair FROM rows) GROUP BY cid)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(key, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(key, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM src) d LEFT JOIN counts USING (cid) LEFT JOIN best USING (cid) LEFT JOIN repaired USING (cid)"""


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.ngram_join(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (
  SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE len(w) >= s)),
f AS (SELECT lang, s, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE s > 1 AND a >= 100),
k AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM c) c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[p:p + t - 1], ' ') AS phrase, max(a) AS over FROM (
  SELECT lang, w, a, t, unnest(range(1, s - t + 2)) AS p FROM c, (SELECT unnest([2, 3, 4]) AS t) WHERE t < s) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, phrase) AS rank, phrase, b.a, l, r, n, score
FROM b LEFT JOIN i USING (lang, phrase) WHERE over IS NULL OR 100 * over < 100 * b.a QUALIFY rank <= 2000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_decontaminate": op2_decontaminate,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_language": op4_language,
        "op5_pieces": op5_pieces,
        "op6_chat": op6_chat,
        "op7_quality": op7_quality,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_near_dedup": op10_near_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_ngram_join": op12_ngram_join,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": _op1_sql(),
        "op2_decontaminate": _OP2_SQL,
        "op3_exact_dedup": _OP3_SQL,
        "op9_substring_dedup": _OP9_SQL,
        "op10_near_dedup": _OP10_SQL,
        "op11_conversation_repair": _op11_sql(),
        "op12_ngram_join": _OP12_SQL,
        "op13_collocations": _OP13_SQL,
    }
