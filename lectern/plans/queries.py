"""The registered queries of the note engine, over whole tables; their SQL is in ``oracle.py``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.functions import units as U
from lectern.functions import vectors as V
from lectern.operators import concepts as C
from lectern.operators import dense as D
from lectern.operators import retrieve as R
from lectern.operators import study as S
from lectern.operators import taxonomy as X
from lectern.operators.bm25 import bm25_scores, lengths, query_terms, term_counts, term_rows
from lectern.operators.chunking import chunk_documents
from lectern.operators.tables import checkpoint, is_few, small
from lectern.plans.corpus import chunk_table, document_table, notes, stored_documents, structured, table
from lectern.plans.ingest_queries import INGEST_QUERIES
from lectern.sources import store

#: Every query of a stated set: rows whose id is divisible by this, against all rows.
EVERY = 20


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def raw_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", T.raw_words(F.col("text")).alias("w"))
    return w.select("doc_id", long(F.size("w")).alias("n_words"), long(F.size(F.array_distinct("w"))).alias("n_distinct"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = term_rows(table(spark, d, "documents"), "doc_id", F.col("text"))
    return rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def text_summaries(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.snippet(t).alias("snippet"), long(T.approx_tokens(t)).alias("approx_tokens"), T.lead_sentence(t).alias("lead"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", long(F.size("s")).alias("n_sentences"), long(F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0))).alias("longest"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    intro = F.concat("title", F.lit("\nsee w"), F.col("number").cast("string"), F.lit(": and Chapter "), (F.col("number") + 1).cast("string"), F.lit(", lab - 3\n"), "text")
    return n.select("doc_id", U.find_markers(intro).alias("m"))


def unit_markers(spark: SparkSession, d: str) -> DataFrame:
    m = _marked(spark, d).select("doc_id", F.explode("m").alias("m"))
    return m.groupBy("doc_id", F.col("m.scheme").alias("scheme"), long(F.col("m.number")).alias("number")).agg(F.count(F.lit(1)).alias("n"))


def canonical_scheme(spark: SparkSession, d: str) -> DataFrame:
    m = _marked(spark, d).select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
    return U.scheme_by_document(m, "doc_id")


def query_intent(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    asked = F.concat(F.lit("Week "), (F.col("item_id") % 12 + 1).cast("string"), F.lit(" and w3: "), "text")
    return b.select("item_id", U.query_intent(asked).alias("q")).select("item_id", joined(F.transform("q.week_numbers", lambda n: n.cast("string"))).alias("week_numbers"), F.col("q.cleaned").alias("cleaned"))


def unit_asof(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    blocks = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("b")).select("doc_id", (F.col("b") * 150).alias("offset"))
    markers = docs.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("b"))
    markers = markers.select("doc_id", (F.col("b") * 370 + F.col("doc_id") % 7 * 20 - 40).cast("int").alias("index"), F.lit("Week").alias("scheme"), (F.col("b") + 1).alias("number"))
    placed = U.units_as_of(blocks, markers, "doc_id")
    return placed.select("doc_id", long("offset").alias("offset"), F.col("week.label").alias("label"), F.col("week.confidence").alias("confidence"))


def document_ids(spark: SparkSession, d: str) -> DataFrame:
    s = stored_documents(spark, d)
    return s.select(F.col("doc_seq").alias("doc_id"), F.col("id").alias("document_id"), T.chunk_id(F.col("id"), F.lit(0)).alias("chunk_id"))


def owner_ids(spark: SparkSession, d: str) -> DataFrame:
    mail = F.concat(F.lit(" Jo.van_"), F.replace(F.col("c_name"), F.lit("#"), F.lit("-")), F.lit("@Example.org "))
    c = table(spark, d, "customer").select("c_custkey", mail.alias("mail"))
    return c.select("c_custkey", T.owner_id(F.col("mail")).alias("owner_id"), T.display_name(F.col("mail")).alias("name"), T.is_email(F.col("mail")).alias("valid"))


def upload_gate(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.regexp_extract("url", r"[^/]*\z", 0), F.element_at(F.array(*map(F.lit, (".PDF", ".docx", ".md", ".exe", "")) ), (F.col("page_id") % 5 + 1).cast("int")))
    p = table(spark, d, "pages").select("page_id", name.alias("name"))
    return p.select("page_id", T.is_supported(F.col("name")).alias("supported"), T.file_title(F.col("name")).alias("title"))


def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(T.raw_words(F.col("text"))).alias("word")).distinct()
    h = w.withColumn("hash", V.fnv1a(F.col("word"), fixed.WORD_SALT))
    return h.select("word", "hash", long(V.bucket(F.col("hash"))).alias("bucket"), V.sign(F.col("hash")).alias("sign"))


def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = V.embed_rows(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))
    values = e.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).filter("x <> 0")
    return values.select("doc_id", long("bucket").alias("bucket"), F.round("x", 6).alias("value"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, queries) of the dense searches."""
    v = _vectors(spark, d)
    q = v.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("e").alias("qv"))
    return v.select(F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("document_id"), "e"), q


def _score(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seq"))
    near = _score(D.best(*_sides(spark, d), fixed.TOP_K))
    return near.withColumn("rank", long(rank)).filter(F.col("rank") <= fixed.TOP_K).select("query_id", "seq", "rank", "score")


def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    sides = _sides(spark, d)
    ends = D.ends(*sides).select("query_id", *(F.round(c, 6).alias(n) for c, n in (("low", "_min_score"), ("high", "_max_score"))))
    return R.scale(_score(D.scores(*sides)), ["score"], few=is_few(sides[1]), ends=ends).select("query_id", "seq", F.round("score", 6).alias("scaled"))


def diversity_topk(spark: SparkSession, d: str) -> DataFrame:
    top = R.diversify(_score(D.best(*_sides(spark, d), fixed.TOP_K, by_document=True)), fixed.TOP_K)
    return top.select("query_id", "seq", "document_id", long("rank").alias("rank"), F.round("score", 6).alias("score"))


def _label_concepts(spark: SparkSession, d: str) -> DataFrame:
    """name, embedding: the mean vector of each label, of unit length."""
    v = _vectors(spark, d).select("label", F.posexplode("e").alias("i", "x"))
    mean = v.groupBy("label", "i").agg(F.avg("x").alias("x"))
    name = F.concat(F.lit("Topic label "), F.col("label").cast("string"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return mean.groupBy(name.alias("name")).agg(whole.alias("embedding")).withColumn("embedding", V.normalise(F.col("embedding")))


def concept_channel(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    chunks = v.select(F.col("vec_id").alias("seq"), F.array(F.concat(F.lit("TOPIC label "), F.col("label").cast("string"))).alias("concepts"))
    queries = v.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("e").alias("qv"))
    best, _ = R.concept_scores(chunks, _label_concepts(spark, d), queries)
    return best.select("query_id", "seq", F.round("concept", 6).alias("concept"))


def matched_concepts(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    queries = v.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("e").alias("qv"))
    none = spark.createDataFrame([], "seq bigint, concepts array<string>")
    _, names = R.concept_scores(none, _label_concepts(spark, d), queries)
    return names.select("query_id", joined("matched_concepts").alias("matched"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), "text")


def _all_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    q = _questions(spark, d)
    counts = checkpoint(term_counts(docs, "seq", F.col("text"), query_terms(q)))
    scored = bm25_scores(lengths(counts).crossJoin(small(q.select("query_id"))), counts, q).withColumn("score", F.round("lexical", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seq"))
    return scored.withColumn("rank", long(rank)).filter(F.col("rank") <= fixed.TOP_K).select("query_id", "seq", "rank", "score")


def _search(spark: SparkSession, d: str, queries: DataFrame, k: int, semantic: bool = False) -> DataFrame:
    vectors = queries.select(F.col("query_id").alias("vec_id")).join(_vectors(spark, d), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("e").alias("qv"))
    return R.retrieve(chunk_table(spark, d), document_table(spark, d), _label_concepts(spark, d), queries, k, vectors, semantic)[0]


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    r = _search(spark, d, _questions(spark, d), fixed.TOP_K)
    parts = [F.round(F.col(f"breakdown.{c}"), 6).alias(c) for c in ("dense", "lexical", "concept")]
    return r.select("query_id", "seq", F.col("document.title").alias("title"), F.round("score", 6).alias("score"), *parts)


def semantic_fusion(spark: SparkSession, d: str) -> DataFrame:
    """With the weights of a trained embedder, for every row of the benchmark."""
    r = _search(spark, d, _all_questions(spark, d), fixed.MAX_K, semantic=True)
    return r.select("query_id", "seq", long("rank").alias("rank"), F.round("score", 6).alias("score"))


#: Documents that ``search_meta`` and ``filter_candidates`` take away from, by source.
ORPHANED = "src3"


def filter_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What each kind of filter leaves of all chunks, those of one source having lost their documents."""
    group = lambda owner, source: hashlib.sha1(f"{owner}:{source}".encode()).hexdigest()[:16]
    asked = R.query_table(spark, [
        (0, "sampling", R.Filters()),
        (1, "sampling", R.Filters(weeks=["Week 4", "Topic 3"], week_numbers=[5])),
        (2, "sampling", R.Filters(week_numbers=[5, 9])),
        (3, "sampling", R.Filters(document_ids=[group("en", "src1"), group("de", "src2"), group("fr", ORPHANED)])),
        (4, "sampling", R.Filters(concepts=["topic LABEL 3", "Topic label 7"])),
        (5, "sampling", R.Filters(kinds=["gdocs"])),
        (6, "lecture 5 sampling", R.Filters()),
        (7, "lecture 5 sampling", R.Filters(weeks=["Topic 3"])),
        (8, "unit 1 and w4", R.Filters(concepts=["topic label 1", "topic label 2"], kinds=["upload", "notion"])),
    ])
    chunks = chunk_table(spark, d).withColumn("len", F.lit(0))
    documents = document_table(spark, d).filter(F.col("title") != ORPHANED)
    found = R.candidates(chunks, documents, R.prepare_queries(asked).withColumn("qv", F.lit(None).cast("array<double>")))
    return found.select("query_id", "seq")


def search_meta(spark: SparkSession, d: str) -> DataFrame:
    """What a search says of itself, asked in four ways: as it is, limited by label, naming a unit, and naming one against a given number.

    Some notes have vectors of another width, so that queries that meet them find the index stale.
    """
    q = _questions(spark, d)
    none, words = F.array().cast("array<string>"), lambda *w: F.array(*map(F.lit, w))
    named = F.concat(F.lit("Week 4 "), "text")
    ways = [(F.col("text"), none, F.array().cast("array<int>")), (F.col("text"), words("Topic 3"), words(4)), (named, none, F.array().cast("array<int>")), (named, none, words(3))]
    asked = q.select("query_id", F.explode(F.array(*(F.struct(F.lit(i).alias("way"), t.alias("text"), w.alias("weeks"), n.alias("week_numbers")) for i, (t, w, n) in enumerate(ways)))).alias("w"))
    asked = asked.select((F.col("query_id") * 10 + F.col("w.way")).alias("query_id"), F.col("query_id").alias("vec_id"), "w.text", "w.weeks", "w.week_numbers")
    vectors = asked.select("query_id", "vec_id").join(_vectors(spark, d), "vec_id").select("query_id", F.col("e").alias("qv"))
    chunks = chunk_table(spark, d).withColumn("embedding", F.when(F.col("seq") % 24 == 15, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    meta = R.describe(chunks, document_table(spark, d), _label_concepts(spark, d), asked.drop("vec_id"), vectors)
    return meta.select("query_id", "cleaned", joined("applied_weeks").alias("applied_weeks"), "stale_index", joined("matched_concepts").alias("matched"))


def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Limited to units 3, 7 and 12, and to two kinds of source."""
    q = _questions(spark, d).withColumns({"week_numbers": F.array(*map(F.lit, (3, 7, 12))), "kinds": F.array(F.lit("upload"), F.lit("notion"))})
    r = _search(spark, d, q, fixed.MAX_K)
    return r.select("query_id", "seq", F.col("week.label").alias("label"), F.col("document.kind").alias("kind"), F.round("score", 6).alias("score"))


def _mined(spark: SparkSession, d: str) -> DataFrame:
    """Notes with their concepts; every fourth has no heading, and so two pairs."""
    n = notes(spark, d)
    heading = F.array(F.concat("title", F.lit(": "), F.initcap(F.col("source")), F.lit(" notes")))
    drafts = n.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), "text", F.when(F.col("doc_id") % 4 == 1, F.array().cast("array<string>")).otherwise(heading).alias("headings"))
    return checkpoint(C.mine_concepts(drafts)).join(n.drop("text").withColumnRenamed("doc_id", "document_id"), "document_id")


def concept_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d).select(F.col("document_id").alias("doc_id"), joined("concepts").alias("concepts"))


def _mined_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, documents): notes as chunks of their source's document, with mined concepts, which are stored once."""
    m = _mined(spark, d)
    group = T.short_id(F.col("owner"), F.col("source"))
    chunks = m.select(
        F.col("document_id").alias("seq"), F.concat_ws(":", group, F.col("document_id").cast("string")).alias("id"), group.alias("document_id"), F.col("document_id").cast("int").alias("ordinal"),
        F.array("title").alias("headings"), U.tag(F.col("scheme"), F.col("number"), F.element_at(F.array(*map(F.lit, U.CONFIDENCE)), (F.col("document_id") % 3 + 1).cast("int"))).alias("week"), "concepts",
    )
    return chunks, document_table(spark, d)


def concept_index(spark: SparkSession, d: str) -> DataFrame:
    i = C.concept_index(*_mined_chunks(spark, d))
    return i.select("id", "owner_id", "name", "description", joined("chunk_ids").alias("chunk_ids"), joined("document_ids").alias("document_ids"), joined("week_labels").alias("week_labels"))


def unit_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = C.unit_rollup(_mined_chunks(spark, d)[0])
    return r.select("document_id", long("number").alias("number"), "label", "confidence")


def concept_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = C.concept_rollup(_mined_chunks(spark, d)[0])
    card = X.capped(F.col("concepts"), 10)
    return r.select("document_id", joined("concepts").alias("concepts"), joined(card["shown"]).alias("shown"), long(card["more"]).alias("more"))


def taxonomy_units(spark: SparkSession, d: str) -> DataFrame:
    chunks, docs = _mined_chunks(spark, d)
    t = X.unit_facets(chunks, C.concept_index(chunks, docs))
    place = F.row_number().over(Window.orderBy(*U.unit_order()))  # there are as many units as schemes and numbers allow
    head = joined(F.slice("concepts", 1, 5)).alias("first_concepts")
    return t.select(long(place).alias("position"), "label", long("number").alias("number"), long("chunk_count").alias("chunk_count"), long("document_count").alias("document_count"), long(F.size("concepts")).alias("n_concepts"), head)


def taxonomy_concepts(spark: SparkSession, d: str) -> DataFrame:
    t = X.concept_facets(C.concept_index(*_mined_chunks(spark, d)))
    return t.groupBy("name").agg(long(F.sum("chunk_count")).alias("chunk_count"), long(F.sum("document_count")).alias("document_count"))


def _owner_facets(spark: SparkSession, d: str) -> DataFrame:
    return X.concept_facets(store.list_concepts(C.concept_index(*_mined_chunks(spark, d)), "en"))


def concept_top(spark: SparkSession, d: str) -> DataFrame:
    """The 40 concepts that one owner's browser shows, in order."""
    top = _owner_facets(spark, d).limit(40)
    rank = F.row_number().over(Window.orderBy(F.col("chunk_count").desc(), F.collate("name", "UNICODE")))
    return top.select(long(rank).alias("rank"), "name", long("chunk_count").alias("chunk_count"), long("document_count").alias("document_count"))


def unit_sidebar(spark: SparkSession, d: str) -> DataFrame:
    own = X.unit_concepts(_owner_facets(spark, d), "Week 4")
    return own.select("name", long("chunk_count").alias("chunk_count"))


def owner_concepts(spark: SparkSession, d: str) -> DataFrame:
    return store.list_concepts(C.concept_index(*_mined_chunks(spark, d)), "fr").select("id", "owner_id", "name")


def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return X.corpus_totals(document_table(spark, d), notes(spark, d))


def owner_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = stored_documents(spark, d)
    chunks = docs.select(F.col("id").alias("document_id"), "doc_seq", "kind")
    return store.owned_chunks(chunks, docs, "de").select("document_id", F.col("doc_seq").alias("doc_id"), "kind")


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Stored documents and chunks, and a re-sync of every seventh with another kind and title."""
    docs = stored_documents(spark, d).drop("text")
    new = docs.filter(F.col("doc_seq") % 7 == 0).withColumns({"kind": F.lit("gdocs"), "title": F.concat(F.lit("again "), "title")})
    new = new.withColumn("id", T.document_id(F.col("owner_id"), F.col("kind"), F.col("external_id")))
    as_chunks = lambda x: x.select(T.chunk_id(F.col("id"), F.lit(0)).alias("id"), F.col("id").alias("document_id"), "title")
    return docs, as_chunks(docs), new, as_chunks(new)


def upsert_docs(spark: SparkSession, d: str) -> DataFrame:
    docs, _ = store.upsert(*_batch(spark, d))
    return docs.select("id", "owner_id", "external_id", "kind", "title", "doc_seq")


def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_batch(spark, d))[1]


#: Sources whose documents are deleted.
DELETED = ("src1", "src7", "src12")


def delete_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The concept index, built anew from what the deletion of three sources leaves."""
    chunks, docs = _mined_chunks(spark, d)
    gone = docs.filter(F.col("title").isin(*DELETED)).select("owner_id", "id")
    left, chunks_left, _ = store.delete_documents(docs, chunks, C.concept_index(chunks, docs), gone)
    index = C.concept_index(chunks_left, left)
    return index.select("id", "name", "description", joined("chunk_ids").alias("chunk_ids"))


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What concepts keep when the documents of three sources go."""
    chunks, docs = _mined_chunks(spark, d)
    index = C.concept_index(chunks, docs)
    gone = docs.filter(F.col("title").isin(*DELETED)).select("owner_id", "id")
    _, _, left = store.delete_documents(docs, chunks, index, gone)
    return left.select("id", joined("chunk_ids").alias("chunk_ids"), joined("document_ids").alias("document_ids"))


def replace_concepts(spark: SparkSession, d: str) -> DataFrame:
    index = C.concept_index(*_mined_chunks(spark, d))
    new = index.filter(F.col("owner_id") == "fr").withColumn("name", F.upper("name"))
    return store.replace_concepts(index, new.select("owner_id"), new).select("id", "owner_id", "name")


def study_cards(spark: SparkSession, d: str) -> DataFrame:
    return S.flashcards(_search(spark, d, _questions(spark, d), fixed.STUDY_K)).select("query_id", "front", "back", "concept")


def study_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.key_points(_search(spark, d, _questions(spark, d), fixed.STUDY_K)).select("query_id", "key_point")


def study_context(spark: SparkSession, d: str) -> DataFrame:
    """What a model is shown, for every row of the benchmark."""
    c = S.context(_search(spark, d, _all_questions(spark, d), fixed.STUDY_K))
    return c.select("query_id", long(F.length("context")).alias("n_chars"), F.sha1("context").alias("context_sha1"))


def study_sources(spark: SparkSession, d: str) -> DataFrame:
    r = S.sources(_search(spark, d, _questions(spark, d), fixed.STUDY_K))
    return r.select("query_id", long("rank").alias("rank"), "chunk_id", "document_title", "snippet")


def chunk_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with headings of every kind put in."""
    c = chunk_documents(structured(spark, d), "doc_id")
    return c.select("doc_id", long("ordinal").alias("ordinal"), long(F.length("text")).alias("n_chars"), F.sha1("text").alias("text_sha1"), joined("headings").alias("headings"), F.col("week.label").alias("label"), F.col("week.confidence").alias("confidence"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    html_strip, raw_words, token_counts, text_summaries, sentence_split, unit_markers, canonical_scheme, query_intent, unit_asof, document_ids, owner_ids, upload_gate,
    fnv_hash, hashed_embedding, dense_topk, minmax_scale, diversity_topk, concept_channel, matched_concepts, bm25_topk, hybrid_fusion, filtered_search,
    semantic_fusion, filter_candidates, search_meta,
    concept_bigrams, concept_index, unit_rollup, concept_rollup, taxonomy_units, taxonomy_concepts, corpus_totals, concept_top, unit_sidebar, owner_concepts,
    owner_chunks, upsert_docs, upsert_chunks, delete_cascade, delete_rebuild, replace_concepts, study_cards, study_summary, study_context, study_sources, chunk_notes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*QUERIES, *INGEST_QUERIES)}
