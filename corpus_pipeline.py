"""A corpus pipeline of five training-data stages; each takes (spark, docs, sf_dir) and its result is written and read as the next one's docs.

toxicity drops documents that the classifier rejects; exact dedup keeps one of each group of equal texts;
SimHash near-dedup keeps one of each component of documents with a five-word Jaccard similarity of 0.8 or
more, or SimHashes within two bits; the secret scan replaces secrets and keeps every document;
packing returns the pieces of fixed-length sequences. All but packing return the columns of ``documents``.
Empty tables pass through; null texts score, compare and pack as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewright.llm import exact, near, packing, secret_scan, toxicity
from clausewright.llm.common import written
from clausewright.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``documents`` after all stages, without their ids' bytes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
