"""The corpus pipeline: five stages from documents to token ids. Part of the llm subpackage.

In every stage: columns beside doc_id and text are kept as they are, whatever their names; null ids are ids like any
other; repeated rows are rows of their own unless said otherwise; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, decontaminate, quality, secrets, simhash
from pagemill.session import durable, forget, prepare, table

#: Documents that score less are rejected; lower than the classifier's own threshold, to keep clean documents.
REJECT_BELOW = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of docs, doesn't reject.

    A null, empty or blank text scores as the bias alone does; repeated rows stay or go together; without labelled
    rows in docs all scores are 0.5, and all stay.
    """
    prepare(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), REJECT_BELOW)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, null ids last.

    Null, empty and blank texts are copies of one another; of equal rows one stays; of rows of one doc_id with unlike
    texts all stay, also where they differ only by where a null stands; very long texts count whole.
    """
    prepare(spark)
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay; items of null or empty text remove nothing.
    """
    prepare(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars, where there is one, counted anew.

    Null texts stay null, and texts without secrets stay as they are.
    """
    prepare(spark)
    return secrets.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of the bytes decoded from them, of every row.

    Null and empty texts have no ids; equal texts give equal rows; further columns end here.
    """
    prepare(spark)
    return bpe.encode_digest(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("byte_level_bpe", encoding_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to what the one before it wrote."""
    durable(spark)
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            forget(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
