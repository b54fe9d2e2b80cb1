"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, bit_gate, checkpoint, passes


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Each step groups only
    what the step before left in groups of two or more, and hands over a bitmap
    of fixed size, so that no text and no row is shuffled before the last join:

    1. octet lengths, counted;
    2. length and hash of the first ``prefix`` characters, of rows whose length recurs;
    3. SHA-256 of the whole text, of rows whose length and prefix recur.

    Null text counts as empty. Of a group the row with the largest id stays; rows
    with that same id and an equal text are one document and all marked kept; a
    null id is never the largest unless all ids are null. ``text_sha256`` is
    null for rows that step 3 needn't read, unless ``digest`` asks for all. An
    empty table gives an empty result, and further columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = F.octet_length("_text").cast("bigint")
    lengths = rows.groupBy(size.alias("_n")).count().filter("count > 1")
    by_length = F.broadcast(bit_gate(checkpoint(lengths), "_n"))

    start = F.xxhash64(size, ascii_lower(F.substring("_text", 1, prefix)))
    prefixes = rows.crossJoin(by_length).filter(passes(F.col("_gate"), size)).groupBy(start.alias("_p")).count().filter("count > 1")
    by_prefix = F.broadcast(bit_gate(checkpoint(prefixes), "_p"))

    whole = F.unhex(F.sha2(ascii_lower(F.col("_text")), 256))
    gated = rows.crossJoin(by_prefix).withColumn("_in", passes(F.col("_gate"), start))
    groups = gated.filter("_in").groupBy(whole.alias("_sha")).agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = checkpoint(groups)  # so that the join has a shuffle of its own on either side, whose hot partitions can be split

    full = whole if digest else F.when(F.col("_in"), whole)
    # rows that can't have a copy get a key of their own, not null, which would put them all into one task
    keyed = gated.select("_id", full.alias("_sha"), "_in").withColumn("_key", F.coalesce(F.col("_sha"), F.concat(F.lit("-"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")))
    return keyed.join(groups.withColumnRenamed("_sha", "_key"), "_key", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
