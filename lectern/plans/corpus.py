"""The driver's tables as a note corpus: what a query reads, and the same as SQL views.

Documents have no titles, units or headings, so these are made by rule from the
id: a title that names a unit, an owner by language, a group by source. A document is one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import document_id, short_id
from lectern.functions.units import tag
from lectern.operators.tables import spread

SCHEMES = ("Week", "Lecture", "Topic")


#: Tables of long texts, which a small input may hold in one file.
_TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in _TEXTS else found


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, owner, source, kind, scheme, number, title, text."""
    docs = table(spark, sf_dir, "documents")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % 3 + 1).cast("int"))
    number = (F.col("doc_id") % 12 + 1).cast("int")
    rows = docs.select("doc_id", F.col("lang").alias("owner"), "source", pick(fixed.KINDS).alias("kind"), pick(SCHEMES).alias("scheme"), number.alias("number"), "text")
    return rows.withColumn("title", F.concat("scheme", F.lit(" "), F.col("number").cast("string")))


NOTES_SQL = """notes AS (
  SELECT doc_id, lang AS owner, source, ['upload', 'notion', 'gdocs'][doc_id % 3 + 1] AS kind, ['Week', 'Lecture', 'Topic'][doc_id % 3 + 1] AS scheme,
         (doc_id % 12 + 1)::INTEGER AS number, text, ['Week', 'Lecture', 'Topic'][doc_id % 3 + 1] || ' ' || (doc_id % 12 + 1)::VARCHAR AS title
  FROM documents)"""


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note as a chunk of the document that its source and owner make: seq, id, document_id, ordinal, text, headings, week, concepts, embedding.

    A chunk's concept and vector are those of the embedding row of its id; notes without one have no concept and a zero vector of the same width.
    """
    n = notes(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.concat(F.lit("Topic label "), F.col("label").cast("string")).alias("concept"))
    width = F.broadcast(vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("_width")))
    rows = n.join(vectors, "doc_id", "left").crossJoin(width)
    group = short_id(F.col("owner"), F.col("source"))
    return rows.select(
        F.col("doc_id").alias("seq"),
        F.concat_ws(":", group, F.col("doc_id").cast("string")).alias("id"),
        group.alias("document_id"),
        F.lit(0).alias("ordinal"),
        "text",
        F.array("title").alias("headings"),
        tag(F.col("scheme"), F.col("number"), F.lit("explicit")).alias("week"),
        F.when(F.col("concept").isNull(), F.array().cast("array<string>")).otherwise(F.array("concept")).alias("concepts"),
        F.coalesce("embedding", F.array_repeat(F.lit(0.0), F.col("_width"))).alias("embedding"),
    )


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``chunk_table``: id, owner_id, title, kind, origin."""
    n = notes(spark, sf_dir)
    return n.groupBy(short_id(F.col("owner"), F.col("source")).alias("id"), F.col("owner").alias("owner_id"), F.col("source").alias("title")).agg(F.min("kind").alias("kind"), F.lit(None).cast("string").alias("origin"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose text has headings of every kind and blank lines put in by the number of the line."""
    n = notes(spark, sf_dir)
    unit = lambda i: F.concat("scheme", F.lit(" "), (F.col("number") + F.floor(i / 9)).cast("string"))

    def framed(line: Column, i: Column) -> Column:
        head = (
            F.when(i % 9 == 0, F.concat(F.lit("# "), unit(i), F.lit(": Start\n")))
            .when(i % 9 == 3, F.concat(F.lit("\n## Section "), i.cast("string"), F.lit("\n")))
            .when(i % 9 == 5, F.lit("\n"))
            .when(i % 9 == 7, F.concat(F.lit("\nNotes "), i.cast("string"), F.lit("\n")))
        )
        return F.concat(F.coalesce(head, F.lit("")), line)

    return n.withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), framed), "\n"))


#: The same as a view of SQL.
STRUCTURED_SQL = """structured AS (
  SELECT * EXCLUDE (text), array_to_string(list_transform(string_split(text, chr(10)), lambda line, j: CASE (j - 1) % 9
    WHEN 0 THEN '# ' || scheme || ' ' || (number + (j - 1) // 9)::VARCHAR || ': Start' || chr(10)
    WHEN 3 THEN chr(10) || '## Section ' || (j - 1)::VARCHAR || chr(10)
    WHEN 5 THEN chr(10)
    WHEN 7 THEN chr(10) || 'Notes ' || (j - 1)::VARCHAR || chr(10) ELSE '' END || line), chr(10)) AS text FROM notes)"""


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as stored documents: id, owner_id, external_id, kind, title, text, doc_seq."""
    n = notes(spark, sf_dir).withColumn("external_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return n.select(document_id(F.col("owner"), F.col("kind"), F.col("external_id")).alias("id"), F.col("owner").alias("owner_id"), "external_id", "kind", "title", "text", F.col("doc_id").alias("doc_seq"))
