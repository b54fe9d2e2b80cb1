"""The registered queries op1 to op13, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, toxicity
from lectern.llm.bpe import bpe_encode
from lectern.llm.common import read
from lectern.llm.exact_dedup import exact_duplicates
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.near_dedup import near_classes
from lectern.llm.oracle import oracle_sql  # noqa: F401
from lectern.llm.pii import ADDED_KINDS, BASE_KINDS, find_pii, span_string
from lectern.llm.quality import quality_rules
from lectern.llm.set_join import similar_sets
from lectern.llm.token_counts import count_tokens
from lectern.llm.turn_repair import damage, repair_summaries
from lectern.llm.url_trust import filter_urls
from lectern.llm.whitening import whiten


#: Vocabulary files are read where the tokenizer package has them; both are parameters of the operators.
BPE_FILE, PIECE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(read(spark, sf_dir, "documents"), BPE_FILE)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("_pii", lambda s: s["kind"] == kind)).cast("bigint")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``n_added``, ``n_spans`` and the highest ``score`` of a span."""
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), out="_pii").select("doc_id", "_pii")
    base = F.filter("_pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(_count_of(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_string(base), 256).alias("base_sha256"),
        span_string(F.col("_pii")).alias("spans"),
        F.size(F.filter("_pii", lambda s: s["kind"].isin(*ADDED_KINDS))).cast("bigint").alias("n_added"),
        F.size("_pii").cast("bigint").alias("n_spans"),
        F.coalesce(F.array_max(F.transform("_pii", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents")).drop("text_hash")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"), digest=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.grade_toxicity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against the documents that are labelled good."""
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality > 0").select("doc_id"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), PIECE_FILE)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.fit(docs, read(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines removed, and length and SHA-256 of what is left of the text."""
    done = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")
    return done.select("doc_id", F.col("n_removed").cast("bigint"), F.length("text").cast("bigint").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return repair_summaries(damage(rows), rows)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_trust": op1_url_trust,
        "op2_bpe": op2_bpe,
        "op3_pii": op3_pii,
        "op4_near_dedup": op4_near_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_counts": op8_token_counts,
        "op9_mixing": op9_mixing,
        "op10_line_dedup": op10_line_dedup,
        "op11_turn_repair": op11_turn_repair,
        "op12_whitening": op12_whitening,
        "op13_set_join": op13_set_join,
    }
