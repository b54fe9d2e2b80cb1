"""Facets over the corpus: units, concepts and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalise_concept
from lectern.functions.units import unit_order


def unit_facets(chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """label, number, chunk_count, document_count, concepts, by scheme and number, unplaced last.

    Facets go by label, so the same number in two schemes stays apart. Concepts
    appear under their name in the index where they have one.
    """
    counts = chunks.groupBy(F.col("week.label").alias("label")).agg(F.first("week.number", ignorenulls=True).alias("number"), F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("document_id").alias("document_count"))
    names = concepts.select(normalise_concept(F.col("name")).alias("key"), "name").groupBy("key").agg(F.max("name").alias("name"))
    spelled = chunks.select(F.col("week.label").alias("label"), F.explode("concepts").alias("concept")).distinct()
    canonical = spelled.withColumn("key", normalise_concept(F.col("concept"))).join(names, "key", "left").select("label", F.coalesce("name", "concept").alias("concept")).distinct()
    listed = canonical.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.collate("concept", "UNICODE").alias("k"), F.col("concept").alias("c")))), lambda x: x["c"]).alias("concepts"))
    joined = counts.join(listed, "label", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    return joined.orderBy(*unit_order())


def concept_facets(concepts: DataFrame) -> DataFrame:
    sized = concepts.select("name", F.size("chunk_ids").alias("chunk_count"), F.size("document_ids").alias("document_count"), "week_labels")
    return sized.orderBy(F.col("chunk_count").desc(), F.collate("name", "UNICODE"))


def corpus_totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("document_count")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunk_count")))


def passage_total(documents: DataFrame) -> DataFrame:
    """document_count, passages: the documents' own counts of chunks, summed."""
    return documents.agg(F.count(F.lit(1)).alias("document_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("passages"))


def capped(values: Column, limit: int) -> Column:
    """struct<shown,more>: the first values of a list and how many more there are."""
    return F.struct(F.slice(values, 1, limit).alias("shown"), F.greatest(F.size(values) - limit, F.lit(0)).alias("more"))


def unit_concepts(concept_facet: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """Concepts of one unit, as a side bar lists them; ``limit`` is how many it shows."""
    own = concept_facet.filter(F.array_contains("week_labels", label))
    return own.limit(limit) if limit else own
