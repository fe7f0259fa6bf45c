"""From raw documents to packed training sequences: language, duplicates, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialize, table
from factloom.llm.langid import fit_languages, keep_labelled
from factloom.llm.mixing import mixed_documents
from factloom.llm.neardup import without_near_duplicates
from factloom.llm.packing import pack_documents, windows_of_files
from factloom.llm.pii import redact
from factloom.llm.queries import PACKING_TOKENIZER

#: The least evidence of a document's words for its language, relative to documents learned. With one of the languages left
#: out of the fit, nine in ten of its documents have less (three in ten where it is close to another); of documents of
#: learned languages only such that repeat one word over and over have.
LEAST_EVIDENCE = 0.55
#: Runs of training positions whose documents share sequences.
WINDOWS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go, and such whose words are of none of the learned languages."""
    model = fit_languages(docs, F.expr("crc32(cast(doc_id AS string)) % 4 <> 2"))
    return keep_labelled(docs, model, LEAST_EVIDENCE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return without_near_duplicates(docs, width=5, similarity=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placeholders take the place of personal data."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them, by training position."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in sequences, which follow the order of the mixture."""
    return pack_documents(windows_of_files(docs, WINDOWS), PACKING_TOKENIZER, limit=4096, last_id=1, with_ids=True)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]
#: No SQL: language models, near-duplicates and packing are held against brute force in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
