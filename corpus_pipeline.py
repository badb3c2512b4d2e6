"""A training corpus from raw documents, stage by stage.

Each stage takes the documents that the one before kept, and each calls one of
the training-data operators. All but the last return the columns of documents.

quality       rejects what fails the current quality policy, by the ledger's bits
near_dedup    keeps one document of each group of near duplicates, and one of repeated rows
decontaminate rejects documents into which a benchmark item leaks
pii           replaces personal data in the texts; the table's n_chars follows
encode        tokenises: ids, their number and digests, a row for each document

A null text fails the quality rules. Rows without a doc_id go through like any
others, and only a near duplicate takes their place. Rows that repeat a document
are its duplicates. Further columns are kept up to the last stage. An empty table
gives an empty corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm import bpe, decontam, neardup, pii, quality
from geoweft.llm.common import checkpoint_dir, remove, ship, table
from geoweft.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    n = F.length("text").cast(clean.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), n))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode(docs, vocabulary_path(), with_ids=True, release=True, kept=0.15)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", personal_data),
    ("encode", encode),
]

#: SQL has neither the tokenizer nor the sketches; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each is written as Parquet in the shared folder and read again; a stage's input goes once its output is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
