"""A training-corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Every stage takes the documents that its predecessor kept, as a table of the same columns, and is
written and read again before the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from platen.llm import line_crf, mix, secrets, simhash
from platen.llm.queries import packed, table
from platen.llm.rows import written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines; the others go."""
    scored = line_crf.quality(docs.select(*DOCUMENT), table(spark, sf_dir, "labels"), carry=DOCUMENT[1:])
    return scored.where("kept").select(*DOCUMENT)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest id."""
    return simhash.without_near_duplicates(docs.select(*DOCUMENT))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets and linked credential parts in its text are replaced by a mark."""
    return secrets.redact(docs.select(*DOCUMENT))


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that every source comes near its target of words."""
    return mix.mixed(docs.select(*DOCUMENT))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packed(docs.select(*DOCUMENT))


STAGES = [
    ("quality rules", good_quality),
    ("near-duplicates", no_near_duplicates),
    ("secret scan", no_secrets),
    ("source mix", weighted_sources),
    ("packing", packed_sequences),
]
#: The trained line model, XXH64 fingerprints and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = uuid.uuid4().hex
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}/{i}")
    return docs
