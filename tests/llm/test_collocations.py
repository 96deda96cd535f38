"""Phrase mining against counting everything, with nulls, hot pivots, odd languages, repeats, long texts and empty tables."""

import random
import re
from collections import Counter

import pytest

from venuelake.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, key string, a long, n long"


def brute(rows, least, top):
    out = []
    counts = {}
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for size in range(1, 6):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            longer = (b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * b >= 100 * a for b in longer):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        out += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    vocabulary = ["the", "of", "é", "x" * 40, "ñu", *(f"w{i}" for i in range(25))]
    prose = lambda n: "".join(rng.choices(vocabulary, weights=[40, 30, 9, 2, 4, *[2] * 25])[0] + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r\n", ";"]) for _ in range(n))
    out = [(prose(rng.randint(0, 60)), rng.choice(["en", "fr", None, "", "a b%_é\n"])) for _ in range(120)]
    out += [("The the THE the", "en"), ("the", "en"), (None, "en"), ("", None), (" .,", "fr"), (prose(4000), "en"), ("w1 w2 w3 w4 w5 w6 " * 300, "fr"), ("w7 " * 700, "fr")]
    return out + out[:20]


@pytest.mark.parametrize("hot", [collocations.HOT, 50])
def test_phrases(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 3000)
    df = spark.createDataFrame([(i, t, lang, "p", "k", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    for least, top in ((12, 2000), (5, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, least, top, hot).collect())
        assert got == brute(rows, least, top) and got
    assert collocations.collocations(df.limit(0)).count() == 0


def test_groups_go_on_in_the_next_batch(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "MINED_BYTES", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i, t, lang, "p", "k", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
        assert sorted(tuple(r) for r in collocations.collocations(df, 12).collect()) == brute(rows, 12, 2000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 2, 3_000_000_000_000)], "lang string, phrase string, size int, a long")
    known = spark.createDataFrame([("en", "a", 4_000_000_000_000), ("en", "b", 5_000_000_000_000), ("en", None, 10**15)], "lang string, word string, n long")
    r = collocations.scored(found, known).first()
    n = 10**15 + 9 * 10**12
    assert (r.n, r.l, r.r, r.score) == (n, 4 * 10**12, 5 * 10**12, 1000 * 3 * 10**12 * n // (20 * 10**24))
