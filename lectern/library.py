"""The facade: one owner's library of notes, with the operations that applications call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import approx_tokens, chunk_id, document_id, embedding_text, normalise_newlines
from lectern.operators import study as material
from lectern.operators.chunking import chunk_documents
from lectern.operators.concepts import apply_model_enrichment, concept_index, concept_rollup, mine_concepts, unit_rollup
from lectern.operators.providers import STUDY_SCHEMAS, LanguageModel, LocalEmbedder
from lectern.operators.retrieve import Filters, clamp_k, prepare_queries, query_table, retrieve
from lectern.operators.tables import checkpoint
from lectern.operators.taxonomy import concept_facets, corpus_totals, passage_total, unit_facets
from lectern.sources import store as tables
from lectern.sources.connectors import connectors, read_connector
from lectern.sources.files import parse_files, read_files


def ingest(raw: DataFrame, owner: str, created_at: str, embedder=None, model: LanguageModel | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, rejected) of raw documents: external_id, title, text, kind, origin, updated_at.

    The whole batch at once. Texts under 40 characters are rejected. The documents of a
    batch share a place, ``doc_seq`` 0, and follow each other by kind and external id.
    What several branches read is stored once: passages are packed, and a model is asked, once.
    """
    clean = raw.withColumn("text", normalise_newlines(F.coalesce("text", F.lit(""))))
    short = F.length("text") < fixed.DOCUMENT_LEAST
    rejected = clean.filter(short).select("external_id", F.lit("document is too short").alias("error"))
    docs = clean.filter(~short).withColumns({"owner_id": F.lit(owner), "id": document_id(F.lit(owner), F.col("kind"), F.col("external_id"))})
    drafts = checkpoint(chunk_documents(docs, "id").withColumnRenamed("id", "document_id"))
    mined = drafts.join(mine_concepts(drafts), ["document_id", "ordinal"], "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    answers = (model or LanguageModel()).enrich(drafts)
    enriched = checkpoint(apply_model_enrichment(mined, answers))
    chunks = enriched.withColumns({"id": chunk_id(F.col("document_id"), F.col("ordinal")), "tokens_approx": approx_tokens(F.col("text"))})
    chunks = (embedder or LocalEmbedder()).embed(chunks, "id", embedding_text(F.col("headings"), F.col("concepts"), F.col("text")))

    units = unit_rollup(enriched).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("number").isNull().alias("n"), "number", "label", "confidence"))).alias("u"))
    units = units.select("document_id", F.transform("u", lambda x: F.struct(x["number"].alias("number"), x["label"].alias("label"), x["confidence"].alias("confidence"))).alias("weeks"))
    counts = enriched.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    by_model = answers.select("document_id").distinct().withColumn("llm_enriched", F.lit(True)) if answers is not None else None
    rolled = docs.withColumnRenamed("id", "document_id").join(counts, "document_id", "left").join(units, "document_id", "left").join(concept_rollup(enriched), "document_id", "left")
    rolled = rolled.join(by_model, "document_id", "left") if by_model is not None else rolled.withColumn("llm_enriched", F.lit(False))
    documents = rolled.select(
        F.col("document_id").alias("id"), "owner_id", "title", "kind", "origin", "external_id", F.lit(created_at).alias("created_at"), "updated_at",
        F.length("text").alias("char_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("weeks", F.array().cast("array<struct<number:int,label:string,confidence:string>>")).alias("weeks"),
        F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), F.coalesce("llm_enriched", F.lit(False)).alias("llm_enriched"), F.lit(0).cast("bigint").alias("doc_seq"),
    )
    return documents, chunks.select("id", "document_id", "ordinal", "text", "headings", "week", "concepts", "embedding", "tokens_approx"), rejected


def in_order(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with ``seq``, their place in the corpus: by document, then by ordinal."""
    place = F.struct("doc_seq", "kind", "external_id")
    placed = chunks.join(documents.select(F.col("id").alias("document_id"), place.alias("_place")), "document_id")
    return placed.withColumn("seq", F.struct("_place", "ordinal")).drop("_place")


class Library:
    """Sources, search, taxonomy and study material of one owner, over the table store."""

    def __init__(self, spark: SparkSession, root: str, owner: str, embedder=None, model: LanguageModel | None = None):
        self.spark, self.store, self.owner = spark, tables.Store(spark, root), owner
        self.embedder, self.model = embedder or LocalEmbedder(), model or LanguageModel()

    def _owned(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        documents, chunks, concepts = self.store.tables()
        return documents.filter(F.col("owner_id") == self.owner), tables.owned_chunks(chunks, documents, self.owner), tables.list_concepts(concepts, self.owner)

    def sources(self) -> DataFrame:
        return tables.list_documents(self.store.read("documents"), self.owner)

    def totals(self) -> DataFrame:
        return passage_total(self.sources())

    def capabilities(self) -> dict:
        return {"embedding_provider": self.embedder.id, "embedding_model": self.embedder.model, "semantic_embeddings": self.embedder.semantic, "llm": self.model.enabled}

    def connectors(self) -> list[dict]:
        return connectors()

    def list_connector(self, service: str, live: bool | None = None) -> DataFrame:
        return read_connector(self.spark, service, listing=True, live=live).drop("text", "error")

    def add(self, raw: DataFrame, created_at: str) -> tuple[DataFrame, DataFrame]:
        """(report, failed): ingests the batch and rebuilds the concept index once."""
        documents, chunks, concepts = self.store.tables()
        new_docs, new_chunks, rejected = ingest(raw, self.owner, created_at, self.embedder, self.model)
        new_docs, rejected = checkpoint(new_docs), checkpoint(rejected)
        self._write(*tables.upsert(documents, chunks, new_docs, new_chunks), concepts)
        return new_docs.select("id", "title", "chunk_count", "weeks", "concepts", "llm_enriched"), rejected

    def upload(self, path: str, created_at: str) -> tuple[DataFrame, DataFrame]:
        files = read_files(self.spark, path)
        if files.select("name").isEmpty():
            raise ValueError("no files to upload")
        raw, failed = parse_files(files)
        report, rejected = self.add(raw, created_at)
        return report, failed.unionByName(rejected.select(F.regexp_replace("external_id", r"\Aupload:", "").alias("name"), "error"))

    def sync(self, service: str, created_at: str, ids: list[str] | None = None, live: bool | None = None) -> tuple[DataFrame, DataFrame]:
        """(report, failed): documents that can't be fetched fail on their own. Each is fetched once."""
        found = checkpoint(read_connector(self.spark, service, ids, live=live))
        report, rejected = self.add(found.filter("error is null").drop("error"), created_at)
        return report, found.filter("error is not null").select("external_id", "error").unionByName(rejected)

    def delete(self, doc_id: str) -> bool:
        documents, chunks, concepts = self.store.tables()
        if tables.get_document(documents, self.owner, doc_id).isEmpty():
            return False
        gone = self.spark.createDataFrame([(self.owner, doc_id)], "owner_id string, id string")
        self._write(*tables.delete_documents(documents, chunks, concepts, gone))
        return True

    def reset(self) -> None:
        self.store.write(*tables.reset_owner(*self.store.tables(), self.owner))

    def _write(self, documents: DataFrame, chunks: DataFrame, concepts: DataFrame) -> None:
        own = documents.filter(F.col("owner_id") == self.owner)
        index = concept_index(in_order(chunks, own), own)
        index = self.embedder.embed(index, "id", F.col("description"))
        mine = self.spark.createDataFrame([(self.owner,)], "owner_id string")
        self.store.write(documents, chunks, tables.replace_concepts(concepts, mine, index.select(concepts.columns)))

    def taxonomy(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(unit facets, concept facets, totals)."""
        documents, chunks, concepts = self._owned()
        return unit_facets(chunks, concepts), concept_facets(concepts), corpus_totals(documents, chunks)

    def search(self, query: str, filters: Filters | None = None, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(results without vectors, meta); an empty query is an error."""
        if not query.strip():
            raise ValueError("query is required")
        documents, chunks, concepts = self._owned()
        asked = query_table(self.spark, [(0, query.strip(), filters or Filters())])
        vectors = None
        if not isinstance(self.embedder, LocalEmbedder):
            vectors = self.embedder.embed(prepare_queries(asked).select("query_id", "cleaned"), "query_id", F.col("cleaned"), "qv").select("query_id", "qv")
        return retrieve(in_order(chunks, documents), documents, concepts, asked, clamp_k(k), vectors, self.embedder.semantic)

    def study(self, request: material.StudyRequest) -> dict:
        """mode, scope, generated_by, sources and, by mode, summary and key_points, flashcards or quiz; a quiz without a model becomes flashcards."""
        mode = material.check_mode(request.mode)
        scope, query = material.scope_of(request)
        rows = checkpoint(self.search(query, request.filters, fixed.STUDY_K)[0])
        found = [r.asDict() for r in material.sources(rows).orderBy("rank").collect()]
        answer = {"mode": mode, "scope": scope, "generated_by": "extractive", "sources": found}
        if not found:
            return answer | {"summary": material.EMPTY_SUMMARY, "key_points": []}
        if self.model.enabled:
            prompt = F.concat(F.lit(f"mode: {mode}\nscope: {scope}\n\n"), F.col("context"))
            given = self.model.ask(material.context(rows), prompt, STUDY_SCHEMAS[mode]).select("answer").first()["answer"]
            if given is not None and all(x is not None for x in given):
                return answer | {"generated_by": "model"} | given.asDict(recursive=True)
        if mode == "summary":
            points = [r["key_point"] for r in material.key_points(rows).orderBy("rank").collect()]
            return answer | {"summary": f"{len(found)} passages on {scope}, best first.", "key_points": points}
        cards = [{k: r[k] for k in ("front", "back", "concept")} for r in material.flashcards(rows).orderBy("rank").collect()]
        return answer | {"flashcards": cards} | ({"summary": material.QUIZ_NOTE} if mode == "quiz" else {})
