"""Documents to training sequences: language ID, line dedup, near-dedup, decontamination, packing.

Each stage reads what the one before kept, in full, and returns the columns of
``documents``; the last returns the pieces of the packed sequences. Learned models
cannot be said in SQL, so ``ORACLE_SQL`` is None and the stages are tested one by one
against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm.decontam import decontaminate
from issuelens.llm.langid import UNKNOWN, identify, train
from issuelens.llm.linededup import dedupe_lines
from issuelens.llm.neardup import near_duplicates
from issuelens.llm.packing import pack
from issuelens.llm.staging import bounded_batches, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a lower calibrated probability is rejected.
MIN_LANG_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language; fills null ``lang``.

    Null and empty texts go. Whole texts of any length count; rows that repeat a key are
    judged one by one. Columns other than those of documents are not carried, here and below.
    """
    bounded_batches(spark)
    found = identify(docs, train(docs))
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANG_SCORE)
    return found.where(keep).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of repeated lines; drops documents of which nothing stays.

    Null, empty and long texts, ties and repeated rows are treated as ``dedupe_lines`` says.
    """
    cut = dedupe_lines(docs)
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(left).withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group, by shingles of five words.

    A text without words stays; rows that repeat the smallest id all stay.
    """
    bounded_batches(spark)
    return near_duplicates(docs, words=5, percent=80).where("kept").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within the edit bound.

    Null and empty texts hold none and stay; an empty benchmark drops nothing.
    """
    bounded_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens.

    A null or empty text is its closing id alone; texts of any length are cut.
    """
    bounded_batches(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
