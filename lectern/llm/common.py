"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.tables import checkpoint, remove, shared_folder  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits in one bitmap of bitmap_construct_agg.
_CHUNK = 32768
#: Bits of a bitmap, at least and at most.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 26


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A prefix that no column of ``df`` starts with, in any case."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bit_gate(keys: DataFrame, key: str, most: int = MOST_BITS) -> DataFrame:
    """One row with a bitmap that has the bit of every key: 16 bits or more a key, from 1 MB to ``most`` bits (8 MB by default).

    The row may be broadcast whatever the number of keys, which is counted first; ``keys`` should be cheap to read twice. A key's bit is
    never missing, and where the bitmap fills up the gate only
    lets more rows through to the exact step that follows it.
    """
    bits = min(most, max(min(most, LEAST_BITS), 1 << (16 * keys.count()).bit_length()))
    pos = F.pmod(F.col(key), F.lit(bits))
    return (
        keys.select(pos.alias("_pos"))
        .groupBy(F.floor(F.col("_pos") / _CHUNK).cast("int").alias("_k"))
        .agg(F.expr(f"bitmap_construct_agg(_pos % {_CHUNK})").alias("_bits"))
        .agg(F.map_from_entries(F.collect_list(F.struct("_k", "_bits"))).alias("_m"))
        .select(F.transform(F.sequence(F.lit(0), F.lit(bits // _CHUNK - 1)), lambda k: F.col("_m")[k]).alias("_gate"))
    )


def passes(gate: Column, key: Column) -> Column:
    """Whether a key's bit is set in the bitmaps of ``bit_gate``."""
    pos = F.pmod(key, F.size(gate).cast("bigint") * _CHUNK)
    byte = F.substring(gate[F.floor(pos / _CHUNK).cast("int")], F.floor((pos % _CHUNK) / 8).cast("int") + 1, F.lit(1))
    found = F.conv(F.hex(byte), 16, 10).cast("bigint")
    return F.coalesce(F.call_function("getbit", found, (pos % 8).cast("int")) == 1, F.lit(False))
