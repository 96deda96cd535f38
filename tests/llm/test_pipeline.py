"""Each stage of the pipeline against a plain version of its own, on the small tables and on rows with every oddity."""

import re
from collections import defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from venuelake.llm import classify, pieces
from venuelake.llm.common import crc_bucket

from .test_operators import bench_words, components_of, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The table, with copies, near copies, passages of the benchmark, nulls, repeats and columns of clashing names."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(bench_words(r.text)) >= 10)
    long = " ".join(f"word{i % 900} and{i}" for i in range(60000))
    words = [f"w{i}" for i in range(120)]
    odd = [
        (10001, " ".join(words)), (10002, "  " + "\n".join(words)), (10003, " ".join([*words[:119], "edit"])), (10004, " ".join(words[:60])), (10005, f"some words {item} more"),
        (10006, None), (10007, ""), (10008, "12 34 !"), (10009, long), (10010, long + " end"), (10011, "é"), (10012, "é"), (10012, "é"), (None, "no id"), (None, "no id"), (None, "é"), (None, None),
    ]
    rows = spark.createDataFrame([(i, t, None, "odd", len(t or "")) for i, t in odd], base.schema)
    return base.unionByName(rows).withColumns({c: F.lit(k) for k, c in enumerate(["_k1", "_d", "_letters", "_lang_pred", "rid", "class", "_times", "row", "column3"])}).repartition(3)


def language(rows, spark):
    """By the operator's own predictions, which are tested elsewhere, on the three columns it needs."""
    given = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    found = classify.language(given, crc_bucket(F.col("doc_id"), 4) != 2).collect()
    said = {(r.doc_id, r.text): (r._lang_pred, r._lang_score) for r in found}
    good = lambda pred, score: pred in ("de", "en", "es", "fr") and score >= 0.3
    return [r for r in rows if re.search(r"[^\W\d_]", r.text or "") and good(*said[(r.doc_id, r.text)])]


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r)
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]


def near(rows):
    root = components_of([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 5)
    return [r for r in rows if r.doc_id is None or root[r.doc_id] == r.doc_id]


def clean(rows, items):
    windows = set()
    for t in items:
        w = bench_words(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if w else 0)}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return [r for r in rows if not hit(bench_words(r.text))]


def test_stages(spark, docs, tmp_path):
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {"language": lambda rows: language(rows, spark), "exact dedup": exact, "near dedup": near, "decontamination": lambda rows: clean(rows, items)}
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.collect()
        want = sorted(plain[name](before), key=key)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted(docs.collect(), key=key)
        assert docs.columns == columns and got == want and len(want) < len(before), name
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = sorted((r.doc_id is not None, r.doc_id or 0, sp.encode(r.text)) for r in got)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in encoded.collect()) == want
    assert sorted(t.text for t in pieces.decode(encoded, pieces.default_model()).collect()) == sorted(r.text for r in got)


def test_run_is_all_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = clean(near(exact(language(rows, spark))), items)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(r.doc_id for r in want)


def test_another_language_goes(spark):
    """Texts with letters, told apart by the network from those in the languages that stay."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    other = spark.createDataFrame([(20000 + i, f"Zażółć gęślą jaźń, wszędzie źdźbło {i} świeżo łąką śnił się żółw.", "pl" if i % 5 else None, "odd", 60) for i in range(150)], base.schema)
    kept = corpus_pipeline.language(spark, base.unionByName(other), SF)
    assert kept.where("doc_id >= 20000").count() == 0
    assert kept.where("doc_id < 20000").count() == len(language(base.collect(), spark))


def test_nothing_to_learn_from_keeps_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()] == [1]


def test_empty_table(spark, docs):
    left = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF)
        assert left.count() == 0, name
        assert left.columns == (["doc_id", "ids"] if name == "pieces" else docs.columns)
