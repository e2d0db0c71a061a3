"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage reads what the one before it wrote. All but the last return the columns of documents.

Edge cases, in every stage: an empty table stays empty; a null text counts as empty (redaction leaves it null); very long
texts are read whole; rows with a null or a repeated id are rows like any other, judged by their texts; further columns,
whatever their names, are dropped; a table without labels loses no document to the first two stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import packing, quality, secrets, simhash_dedup, toxicity
from foldspark.llm.common import remove, use_checkpoints

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a good grade is at least even; ties stay."""
    return quality.keep_good(docs, _labels(spark, sf_dir)).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; ties go."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each near-duplicate group, by id, fingerprint, text and other columns; of equal rows one stays."""
    return simhash_dedup.keep_one(docs).select(*COLUMNS)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced, and their lengths after it."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in the training sequences."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return packing.pack_documents(docs, file.read())


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_redaction),
    ("best-fit packing", pack_sequences),
]

#: The stages hold learned models and tokenizers, which SQL can't express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; what stands between them is written to the shared folder and removed
    once the next stage is written."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
