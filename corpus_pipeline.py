"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage works on everything its predecessor kept; run() writes each stage's rows as Parquet to the
shared folder and reads them again for the next. All stages but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

In every stage an empty table gives no rows, very long texts are read whole, and columns other than
doc_id and text (lang in the first, n_chars in the fourth) are carried along whatever their names. A
doc_id names one document: rows repeated under one stay or go together. Rows without a doc_id cannot be
named as the copy that goes and stay in the second and third stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floodgauge.llm import exact_dedup, language, near_dedup, packing, secrets
from floodgauge.llm.common import materialize, table

#: Near duplicates: words of a shingle and least similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a doc_id of ``kept``, and those without one (which meet no join)."""
    named = docs.where("doc_id IS NOT NULL").join(kept.where("kept").select("doc_id").distinct(), "doc_id", "left_semi")
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises. Those it rejects go: null texts and texts without
    letters, scores below the calibrated bound, more unseen subwords than the calibrated bound."""
    return language.keep_known(docs, language.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (white space aside; null is empty), the longest, then the smallest
    doc_id."""
    return _named(docs, exact_dedup.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates. Texts without words stay."""
    return _named(docs, near_dedup.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked and n_chars brought up to date; null texts stay
    null."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of 1024 ids; a null or empty
    text is its end id."""
    return packing.pack_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]
#: A trained model and an iterative packing are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
