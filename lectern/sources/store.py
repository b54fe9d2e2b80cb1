"""The table store: documents, chunks and concepts as Parquet, a new version for each write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "id string, owner_id string, title string, kind string, origin string, external_id string, created_at string, updated_at string, char_count int, chunk_count int, "
    "weeks array<struct<number:int,label:string,confidence:string>>, concepts array<string>, llm_enriched boolean, doc_seq bigint",
    "chunks": "id string, document_id string, ordinal int, text string, headings array<string>, week struct<number:int,label:string,confidence:string>, concepts array<string>, embedding array<double>, tokens_approx int",
    "concepts": "id string, owner_id string, name string, description string, embedding array<double>, chunk_ids array<string>, document_ids array<string>, week_labels array<string>",
}


def list_documents(documents: DataFrame, owner: str) -> DataFrame:
    """The owner's documents, the newest first, else in the order of the store."""
    return documents.filter(F.col("owner_id") == owner).orderBy(F.col("created_at").desc(), "doc_seq", "kind", "external_id")


def list_concepts(concepts: DataFrame, owner: str) -> DataFrame:
    return concepts.filter(F.col("owner_id") == owner)


def get_document(documents: DataFrame, owner: str, doc_id: str) -> DataFrame:
    return documents.filter((F.col("owner_id") == owner) & (F.col("id") == doc_id)).limit(1)


def owned_chunks(chunks: DataFrame, documents: DataFrame, owner: str) -> DataFrame:
    own = documents.filter(F.col("owner_id") == owner).select(F.col("id").alias("document_id"))
    return chunks.join(own, "document_id", "left_semi")


def upsert(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the same owner and external id give way, with their chunks; the new rows come last.

    The key leaves out the kind, which the id contains. Within the batch the last row of a key counts.
    """
    key = ["owner_id", "external_id"]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("doc_seq").desc()))
    new = new_documents.withColumn("_n", last).filter("_n = 1").drop("_n")
    gone = documents.join(new.select(*key), key, "left_semi").select(F.col("id").alias("document_id"))
    kept = documents.join(new.select(*key), key, "left_anti")
    own = new_chunks.join(new.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    top = kept.agg(F.coalesce(F.max("doc_seq") + 1, F.lit(0)).alias("_top"))
    shifted = new.crossJoin(top).withColumn("doc_seq", F.col("_top") + F.col("doc_seq")).drop("_top")
    return kept.unionByName(shifted), chunks.join(gone, "document_id", "left_anti").unionByName(own)


def delete_documents(documents: DataFrame, chunks: DataFrame, concepts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the documents of ``gone`` (owner_id, id), their chunks, and what concepts say of them; concepts left without a document go."""
    ids = documents.join(gone, ["owner_id", "id"], "left_semi").select("id")
    left = documents.join(ids, "id", "left_anti")
    chunks_left = chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    each = concepts.select("owner_id", "id", F.explode("document_ids").alias("document_id"))
    still = each.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti").groupBy("owner_id", "id").agg(F.array_sort(F.collect_set("document_id")).alias("_docs"))
    of_chunk = lambda c: F.substring(c, F.lit(1), F.length(c) - F.length(F.substring_index(c, ":", -1)) - 1)
    kept = concepts.join(still, ["owner_id", "id"])
    kept = kept.withColumn("chunk_ids", F.filter("chunk_ids", lambda c: F.array_contains(F.col("_docs"), of_chunk(c)))).withColumn("document_ids", F.col("_docs")).drop("_docs")
    return left, chunks_left, kept.select(concepts.columns)


def replace_concepts(concepts: DataFrame, owners: DataFrame, new: DataFrame) -> DataFrame:
    """The concepts of ``owners`` are those of ``new``; others stay."""
    return concepts.join(owners.select("owner_id").distinct(), "owner_id", "left_anti").unionByName(new)


def reset_owner(documents: DataFrame, chunks: DataFrame, concepts: DataFrame, owner: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = documents.filter(F.col("owner_id") == owner).select(F.col("id").alias("document_id"))
    return documents.filter(F.col("owner_id") != owner), chunks.join(own, "document_id", "left_anti"), concepts.filter(F.col("owner_id") != owner)


class Store:
    """Three tables under ``root``; a write makes a new version folder, then names it in the pointer file.

    Files are read and written by Spark alone, so ``root`` may be in any store it
    reads. A missing or unreadable pointer is an empty store. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> str | None:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema("version string, at bigint").json(f"{self.root}/current").orderBy(F.col("at").desc()).limit(1).collect()
        except AnalysisException:
            return None
        return rows[0]["version"] if rows else None

    def read(self, table: str) -> DataFrame:
        at = self.version()
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{at}/{table}")

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.read("documents"), self.read("chunks"), self.read("concepts")

    def write(self, documents: DataFrame, chunks: DataFrame, concepts: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        for table, df in (("documents", documents), ("chunks", chunks), ("concepts", concepts)):
            fitted = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMAS[table]).schema))
            fitted.write.parquet(f"{self.root}/{name}/{table}")
        count = self.spark.range(1).select(F.lit(name).alias("version"), F.expr("unix_micros(current_timestamp())").alias("at"))
        count.coalesce(1).write.mode("append").json(f"{self.root}/current")
        return name
