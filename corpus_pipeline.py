"""Corpus pipeline: quality classifier, quality rules, near-duplicates, repeated substrings, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. A table is written between stages, so each can start again
from its predecessor's rows; it is dropped when the next one is complete.

Defined cases, for every stage: further columns go, whatever their names; an empty table stays empty.
Rows with a null id are documents of their own; rows that share an id are judged by their own texts, and
rows that repeat id and text are one document to the near-duplicate stage, which keeps one. A null or
empty text gets a score, and the rules drop it, since it has too few words. Texts of any length are taken
whole; null language, source and size pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.llm import minhash, packing, quality_classifier, quality_rules, suffix_dedup
from haplolake.llm.queries import VOCABULARY
from haplolake.llm.storage import drop, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects. It is fitted on this stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs.select(COLUMNS), quality_classifier.fit_quality(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail a rule of the policy in force."""
    return quality_rules.keep_passing(docs.select(COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every class of near-duplicates."""
    return minhash.keep_first(docs.select(COLUMNS), minhash.near_duplicates(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out later copies of strings of 100 bytes and more. A character of which a byte goes is replaced."""
    left = suffix_dedup.cut_texts(docs.select(COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"), VOCABULARY)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]
#: Model fitting, hashed search and tokenisation can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
