"""Five stages from raw documents to token ids. Each stage gets what the one before it kept, written as Parquet.

All columns of the documents come through the first four stages, whatever else they are called. Empty tables stay
empty. Null texts, texts without letters and texts in other languages than ``LANGUAGES`` go in the first stage. Rows with a null doc_id are kept by language, lose
to rows with an id among equal texts, take no part in near dedup, and go if they hold a window of the benchmark.
Of rows that repeat an id and a text one is left. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelake.llm import block_dedup, classify, decontaminate, near_dedup, pieces
from venuelake.llm.common import crc_bucket, materialize, release


#: The languages that stay, and the least score of a prediction: below it no language is likelier than by chance.
LANGUAGES, LEAST_SCORE = ("de", "en", "es", "fr"), 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be in one of ``LANGUAGES`` with ``LEAST_SCORE`` or more. Repeated rows stay.

    Texts without any letter (``und``), null and empty ones go. Where no labelled text is there to learn from, nothing
    is predicted, and all texts with letters stay.
    """
    # whatever the other columns are called
    names = [c if c in ("doc_id", "text", "lang") else f"column{i}" for i, c in enumerate(docs.columns)]
    found = classify.language(docs.toDF(*names), crc_bucket(F.col("doc_id"), 4) != 2)
    wanted = F.col("_lang_pred").isin(*LANGUAGES) & (F.col("_lang_score") >= LEAST_SCORE)
    # a text with letters is ``und`` only if no language was learned
    unlearned = (F.col("_lang_pred") == "und") & classify.has_letters(F.col("text"))
    return found.where(wanted | unlearned).select(*names).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest id, once."""
    return block_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8), the one with the smallest id."""
    return near_dedup.near_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of each text."""
    return pieces.encode(docs, pieces.default_model())


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("pieces", encode)]

#: Learned languages and merges can't be stated in SQL; each stage is tested against a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
