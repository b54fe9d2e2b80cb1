"""The corpus pipeline: five stages, each over all that the one before it kept.

``run`` writes each stage's result as Parquet into the shared folder named by
``spark.checkpoint.dir`` and reads it again as the next one's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, toxicity
from lectern.llm.bpe import bpe_encode
from lectern.llm.common import read, remove, shared_folder
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.near_dedup import keep_one

BPE_FILE = public_tokenizers.path("word_bpe_49k.json")

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a toxicity model, fitted on the labels, rejects go; all others stay as they are.

    Without labels none goes. Null and empty texts stay; repeated rows fare alike.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.grade_toxicity(docs, model, carry=True).filter("not rejected").select(docs.columns)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but their first document; every document stays, with its length counted anew.

    First is by id, null before all, then by the text's hash. A null text stays null and has 0 characters.
    """
    return dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id, null before all, then the smallest text hash.

    Of rows equal in id and text one stays. Null and empty texts are all one class.
    """
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix has no copy of go; rows stay single, so rates end at 1 and targets that need more are missed.

    Documents most likely good all stay. The classifier learns from all labelled documents, not only those that are left; without labels all
    are equally likely of each domain and have one rate. Rows with one id share their chance; null and empty texts have no tokens and stay or go by their posteriors.
    """
    model = mixing.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return mixing.mix(docs, model, whole="good", max_copies=1, carry=True).filter("copies > 0").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, their ids, and a digest of what decoding makes of them, for each row; null and empty texts have none."""
    coded = bpe_encode(docs, BPE_FILE)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_passages),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages fit models and draw signatures, which SQL can't express; tests/llm/test_pipeline.py holds each against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. What a stage wrote is removed once the next one has been written; the last one's input stays, for the result is read from it."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
