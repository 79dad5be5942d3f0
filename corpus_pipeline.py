"""Documents to token ids: rules, near duplicates, repeated substrings, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restwave.llm import bpe, mixing, rules, simhash, substrings
from restwave.llm.common import checkpoint_dir, tidy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines go from the others."""
    tidy(spark)
    judged = rules.quality_rules(docs).where("kept")
    return _documents(judged.withColumn("text", F.col("kept_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    tidy(spark)
    return simhash.keep_one(docs, shingle=5)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document without any keeps its text as it is."""
    tidy(spark)
    cut = substrings.remove_repeats(docs)
    return _documents(cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is taken twice is there twice."""
    tidy(spark)
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the text that they decode to."""
    return bpe.encode_decode(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("substring_dedup", repeated_substrings),
          ("mixing", mixture), ("bpe_encoding", encoding)]
#: SQL has neither the fingerprints' hash nor the encoder.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
