"""Registered queries of sources, the store, enrichment, prompts and sessions; their SQL is in ``ingest_oracle.py``."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.api import Answer, Api
from lectern.functions import text as T
from lectern.functions import units as U
from lectern.library import ingest
from lectern.operators import providers as P
from lectern.operators import study as S
from lectern.operators import taxonomy as X
from lectern.operators.concepts import apply_model_enrichment
from lectern.operators.retrieve import Filters, clamp_k
from lectern.operators.tables import checkpoint, remove, shared_folder
from lectern.plans.corpus import document_table, notes, stored_documents, structured, table
from lectern.sources import connectors, files, store

CREATED = "2024-05-06T07:08:09.000Z"


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# --- sources

#: File names' endings, by the number of the document.
ENDINGS = (".md", ".TXT", ".Html", ".docx", ".pdf", ".exe", ".markdown")
#: Lines on a page of a made PDF file.
PAGE_LINES = 20


def _docx(text: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    style = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
    body = "".join(f"<w:p>{style if i == 0 else ''}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for i, x in enumerate(text.split("\n")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _pdf(text: str) -> bytes:
    lines = text.split("\n")
    pages = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)]
    shown = lambda x: b"(" + x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*\n"
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))
    out = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, page in enumerate(pages):
        content = b"BT /F1 10 Tf 12 TL 40 800 Td\n" + b"".join(map(shown, page)) + b"ET"
        out += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i), b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + x + b"\nendobj\n" for i, x in enumerate(out)) + b"%%EOF"


def upload_parse(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as files of every type, and read again; some types are not supported, and some files too long."""

    def packed(batch: pa.RecordBatch, i: int) -> tuple:
        n, t = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        return n, _docx(t) if n.endswith(".docx") else _pdf(t) if n.endswith(".pdf") else (f"<h2>Top</h2><p>{t}</p>" if n.endswith(".Html") else t).encode()

    name = F.concat(F.lit("notes "), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int")))
    fields = pa.schema([("name", pa.string()), ("content", pa.binary())])
    made = table(spark, d, "documents").select(name.alias("name"), "text").mapInArrow(files.by_pieces(packed, fields), "name string, content binary")
    size = F.when(F.col("name").endswith(".markdown"), 21 * 1024 * 1024).otherwise(F.length("content"))
    good, failed = files.parse_files(made.select("name", size.cast("bigint").alias("length"), "content"))
    none = F.lit(None).cast("string")
    read = good.select(F.col("origin").alias("name"), "external_id", "title", "kind", long(F.length("text")).alias("n_chars"), F.sha1("text").alias("text_sha1"), none.alias("error"))
    return read.unionByName(failed.select("name", *(none.alias(c) for c in ("external_id", "title", "kind")), F.lit(None).cast("bigint").alias("n_chars"), none.alias("text_sha1"), "error"))


def connector_fetch(spark: SparkSession, d: str) -> DataFrame:
    both = [connectors.read_connector(spark, s, live=False) for s in connectors.SERVICES]
    return both[0].unionByName(both[1]).select("external_id", "title", "kind", long(F.length("text")).alias("n_chars"), F.sha1("text").alias("text_sha1"), "error")


def connector_listing(spark: SparkSession, d: str) -> DataFrame:
    both = [connectors.read_connector(spark, s, listing=True, live=False) for s in connectors.SERVICES]
    return both[0].unionByName(both[1]).select("external_id", "title", "kind", "text", "error")


def connector_sync(spark: SparkSession, d: str) -> DataFrame:
    """Selected documents, one of which is not there and fails on its own."""
    found = connectors.read_connector(spark, "notion", ["notion-trees", "nowhere"], live=False)
    return found.select("external_id", long(F.length("text")).alias("n_chars"), "error")


BLOCK_KINDS = ("paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item", "to_do", "quote", "code", "divider", "child_page")


def block_walk(spark: SparkSession, d: str) -> DataFrame:
    """The lines of documents as blocks, in chains of five, each the child of the one before it; the fifth is too deep."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("i", "line")
    lines = table(spark, d, "documents").select("doc_id", line)
    block = lambda i: F.concat_ws("-", F.col("doc_id").cast("string"), i.cast("string"))
    kind = F.element_at(F.array(*map(F.lit, BLOCK_KINDS)), ((F.col("doc_id") + F.col("i")) % len(BLOCK_KINDS) + 1).cast("int"))
    half = F.floor(F.length("line") / 2).cast("int")
    runs = F.array(F.struct(F.substring("line", F.lit(1), half).alias("plain_text")), F.struct(F.lit(None).cast("string").alias("plain_text")), F.struct(F.substring("line", half + 1, F.length("line")).alias("plain_text")))
    blocks = lines.select(F.col("doc_id").alias("page_id"), block(F.col("i")).alias("block_id"), F.when(F.col("i") % 5 > 0, block(F.col("i") - 1)).alias("parent_id"), F.col("i").alias("position"), kind.alias("kind"), runs.alias("rich_text"), F.when(F.col("doc_id") % 2 == 0, "python").alias("language"))
    made = connectors.blocks_to_documents(blocks)
    return made.select(F.col("page_id").alias("doc_id"), long(F.length("text")).alias("n_chars"), F.sha1("text").alias("text_sha1"))


STYLES = ("HEADING_1", "NORMAL_TEXT", "HEADING_6", "HEADING_7", None)


def docs_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The lines of documents as styled paragraphs with blank ones in between."""
    style = lambda i: F.element_at(F.array(*map(F.lit, STYLES)), (i % len(STYLES) + 1).cast("int"))
    own = lambda x, i: F.struct(style(i).alias("style"), F.array(x, F.lit("\n")).alias("runs"))
    blank = F.struct(F.lit("HEADING_2").alias("style"), F.array(F.lit(" "), F.lit("\n\n")).alias("runs"))
    parts = F.flatten(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 0, F.array(own(x, i), blank, blank, blank)).otherwise(F.array(own(x, i)))))
    made = table(spark, d, "documents").select("doc_id", connectors.paragraphs_text(parts).alias("text"))
    return made.select("doc_id", long(F.length("text")).alias("n_chars"), F.sha1("text").alias("text_sha1"))


# --- the store


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, concepts): notes as documents of one chunk, made on 28 days; a concept for each source."""
    docs = stored_documents(spark, d).withColumn("created_at", F.concat(F.lit("2024-02-"), F.lpad((F.col("doc_seq") % 28 + 1).cast("string"), 2, "0")))
    chunks = docs.select(T.chunk_id(F.col("id"), F.lit(0)).alias("id"), F.col("id").alias("document_id"), "text")
    concepts = document_table(spark, d).select("id", "owner_id", F.col("title").alias("name"))
    return docs, chunks, concepts


def newest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 of one owner's listing."""
    top = store.list_documents(_stored(spark, d)[0], "de").limit(40)
    rank = F.row_number().over(Window.orderBy(F.col("created_at").desc(), "doc_seq"))
    return top.select(long(rank).alias("rank"), "external_id", "created_at")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first document of one owner by its id, and by an owner whose it isn't."""
    docs = _stored(spark, d)[0]
    first = docs.filter("owner_id = 'en'").orderBy("doc_seq").first()["id"]
    found = store.get_document(docs, "en", first).unionByName(store.get_document(docs, "de", first))
    return found.select("id", "external_id", "title")


def reset_owner(spark: SparkSession, d: str) -> DataFrame:
    left = store.reset_owner(*_stored(spark, d), "fr")
    named = [x.select(F.lit(n).alias("table"), "id") for n, x in zip(("documents", "chunks", "concepts"), left, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def store_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Documents written to the store, replaced by a second version, read again, and passed on as JSON."""
    docs, chunks, concepts = _stored(spark, d)
    fit = lambda x, t: x.select(*(F.col(c.name) if c.name in x.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in spark.createDataFrame([], store.SCHEMAS[t]).schema))
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    kept = store.Store(spark, root)
    empty = kept.read("documents")
    kept.write(fit(docs, "documents"), fit(chunks, "chunks"), fit(concepts, "concepts"))
    units = F.array(F.struct((F.col("doc_seq") % 12 + 1).cast("int").alias("number"), F.col("title").alias("label"), F.lit("explicit").alias("confidence")))
    again = docs.filter("owner_id <> 'es'").withColumns({"title": F.upper("title"), "char_count": F.length("text"), "weeks": units})
    kept.write(fit(again, "documents"), fit(chunks, "chunks"), fit(concepts, "concepts"))
    read = store.Store(spark, root).read("documents").unionByName(empty)
    found = checkpoint(read.select(F.to_json(F.struct("*")).alias("row")))
    remove(spark, root)
    rows = found.select(F.from_json("row", store.SCHEMAS["documents"]).alias("r")).select("r.*")
    return rows.select("id", "owner_id", "external_id", "title", long("char_count").alias("char_count"), F.col("weeks")[0]["label"].alias("unit"), long(F.col("weeks")[0]["number"]).alias("number"), "doc_seq")


def library_totals(spark: SparkSession, d: str) -> DataFrame:
    return X.passage_total(stored_documents(spark, d).withColumn("chunk_count", (F.col("doc_seq") % 5).cast("int")))


# --- ingest and enrichment


def _raw(spark: SparkSession, d: str) -> DataFrame:
    n = structured(spark, d)
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("  too short "), F.col("doc_id").cast("string"))).otherwise(F.regexp_replace("text", "\n", "\r\n"))
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    return n.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("external_id"), "title", text.alias("text"), "kind", F.lit(None).cast("string").alias("origin"), day.alias("updated_at"))


def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    """All notes as one batch of one owner, some of them too short."""
    documents, _, rejected = ingest(_raw(spark, d), "owner", CREATED)
    none = F.lit(None).cast("string")
    good = documents.select("external_id", "id", "title", "kind", long("char_count").alias("char_count"), long("chunk_count").alias("chunk_count"), joined(F.transform("weeks", lambda w: w["label"])).alias("units"), "llm_enriched", "created_at", "updated_at", none.alias("error"))
    bad = rejected.select("external_id", *(none.alias(c) for c in ("id", "title", "kind")), *(F.lit(None).cast("bigint").alias(c) for c in ("char_count", "chunk_count")), none.alias("units"), F.lit(None).cast("boolean").alias("llm_enriched"), none.alias("created_at"), none.alias("updated_at"), "error")
    return good.unionByName(bad)


#: Characters of a note that its first section has.
FIRST = 300


def _model(prompt: str) -> str:
    """A model for the test: fails, answers nonsense, or places and names the first section, by the length of the prompt."""
    n = len(prompt)
    if n % 3 == 0:
        raise RuntimeError("model failed")
    if n % 3 == 1:
        return "no JSON"
    return json.dumps({"scheme": "Week", "sections": [{"ordinal": 0, "week_number": None if n % 2 == 0 else n % 12 + 1, "concepts": [" Alpha ", "", "Beta", "Gamma", "Delta", "Omega"]}]})


def model_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Notes of two sections each, enriched by a model where it answers; every fourth note has no unit, and every eighth none but in its second section."""
    n = notes(spark, d)
    tagged, none = U.tag(F.col("scheme"), F.col("number"), F.lit("explicit")), U.unplaced()
    section = lambda i, text, week: F.struct(F.lit(i).alias("ordinal"), text.alias("text"), F.array("title").alias("headings"), week.alias("week"), F.array(F.lit("Mined")).alias("concepts"))
    first = section(0, F.substring("text", 1, FIRST), F.when(F.col("doc_id") % 4 == 0, none).otherwise(tagged))
    second = section(1, F.substring("text", F.lit(FIRST + 1), F.length("text")), F.when(F.col("doc_id") % 8 == 4, none).otherwise(tagged))
    chunks = n.select(F.col("doc_id").alias("document_id"), F.explode(F.array(first, second)).alias("c")).select("document_id", "c.*")
    done = apply_model_enrichment(chunks, P.LanguageModel(_model).enrich(chunks))
    return done.select(F.col("document_id").alias("doc_id"), long("ordinal").alias("ordinal"), F.col("week.label").alias("label"), F.col("week.confidence").alias("confidence"), joined("concepts").alias("concepts"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of a note and what a model is shown of it; some have no headings or concepts."""
    some = lambda n, *v: F.when(F.col("doc_id") % n == 0, F.array().cast("array<string>")).otherwise(F.array(*v))
    n = notes(spark, d).withColumns({"headings": some(3, F.col("title"), F.col("source")), "concepts": some(5, F.col("source"), F.lit("Sampling"))})
    both = n.select("doc_id", T.embedding_text(F.col("headings"), F.col("concepts"), F.col("text")).alias("e"), T.outline(F.col("number"), F.col("headings"), F.col("text")).alias("o"), T.approx_tokens(F.col("text")).alias("t"))
    return both.select("doc_id", F.sha1("e").alias("embedding_sha1"), F.sha1("o").alias("outline_sha1"), long("t").alias("approx_tokens"))


# --- lines


def line_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Which lines look like headings, and of which level."""
    lines = structured(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    line = F.col("line")
    marked = T.markdown_heading(line)
    return lines.select("doc_id", long("i").alias("line"), long(marked["level"]).alias("marked_level"), marked["text"].alias("marked_text"), T.is_bare_heading(line).alias("bare"), long(T.bare_heading_level(line)).alias("bare_level"))


def overlap_tails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tail_overlap(F.col("text")).alias("tail"))


def clean_newlines(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" \r\n"), F.regexp_replace("text", "\n", "\r\n"), F.lit("\r\n "))
    return table(spark, d, "documents").select("doc_id", F.sha1(T.normalise_newlines(raw)).alias("text_sha1"))


def facet_toggle(spark: SparkSession, d: str) -> DataFrame:
    chosen = F.array(*map(F.lit, ("Week 1", "Topic 3", "Lecture 5")))
    return notes(spark, d).select("doc_id", joined(T.toggle(chosen, F.col("title"))).alias("chosen"))


# --- requests

SCOPES = (
    S.StudyRequest("o"),
    S.StudyRequest("o", "poem", "  heaps "),
    S.StudyRequest("o", "flashcards", None, Filters(concepts=["Trees", "Heaps"], weeks=["Week 3"])),
    S.StudyRequest("o", "quiz", "", Filters(weeks=["Week 3"], week_numbers=[4, 5])),
    S.StudyRequest("o", "summary", "sampling", Filters(concepts=["Bias"], weeks=["Lecture 2"], week_numbers=[7])),
)


def study_scopes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, S.check_mode(r.mode), *S.scope_of(r)) for i, r in enumerate(SCOPES)], "request bigint, mode string, scope string, query string")


def clamped_k(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, clamp_k(k)) for i, k in enumerate((None, -3, 0, 1, 8, 30, 31, 99))], "request bigint, k bigint")


ENVIRONMENTS = ({}, {"OPENAI_API_KEY": "x"}, {"VOYAGE_API_KEY": "x", "OPENAI_API_KEY": "x"}, {"EMBEDDING_PROVIDER": "local", "VOYAGE_API_KEY": "x"}, {"EMBEDDING_PROVIDER": "openai", "OPENAI_API_KEY": "x", "VOYAGE_API_KEY": "x"}, {"EMBEDDING_PROVIDER": "openai", "VOYAGE_API_KEY": "x"}, {"EMBEDDING_PROVIDER": "other", "VOYAGE_API_KEY": "x"})


def provider_choice(spark: SparkSession, d: str) -> DataFrame:
    chosen = [P.embedder(e) for e in ENVIRONMENTS]
    return spark.createDataFrame([(i, c.id, c.model, c.dimensions, c.semantic) for i, c in enumerate(chosen)], "environment bigint, provider string, model string, dimensions bigint, semantic boolean")


def _service(texts: list[str]) -> list[dict]:
    """An embedding service for the test: answers last first, and says in the third place whether the batch was too large."""
    return [{"index": i, "embedding": [float(len(texts[i])), 100.0, float(len(texts) > 128)]} for i in reversed(range(len(texts)))]


def remote_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = P.RemoteEmbedder("voyage", _service).embed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))
    return e.select("doc_id", *(F.round(F.col("embedding")[i], 6).alias(c) for i, c in enumerate("xyz")))


def sign_in(spark: SparkSession, d: str) -> DataFrame:
    """Users by their e-mail, their cookies, and what is read from cookies, some of which are cut off or made by hand."""
    mail = F.concat(F.lit(" Jo.van_"), F.replace(F.col("c_name"), F.lit("#"), F.lit("-")), F.lit("@Example.org "))
    made = table(spark, d, "customer").select("c_custkey", T.build_user(mail).alias("u")).withColumn("cookie", T.session_cookie(F.col("u")))
    sent = F.when(F.col("c_custkey") % 5 == 0, F.expr("substring(cookie, 1, length(cookie) div 2)")).when(F.col("c_custkey") % 7 == 1, F.lit('{"id":"7","email":"ann_lee@x.org"}')).when(F.col("c_custkey") % 7 == 2, F.lit('{"id":"7","name":"Ann"}')).otherwise(F.col("cookie"))
    back = made.withColumn("b", T.session_user(sent))
    return back.select("c_custkey", F.col("u.id").alias("id"), F.col("u.name").alias("name"), F.col("u.email").alias("email"), "cookie", F.col("b.id").alias("back_id"), F.col("b.name").alias("back_name"), F.col("b.email").alias("back_email"))


def _writer(prompt: str) -> str:
    """A model for the test, of summaries only."""
    if prompt.startswith("mode: summary"):
        return json.dumps({"summary": "Written.", "key_points": ["a", "b"]})
    raise RuntimeError("model failed")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A session of requests over a library of the sample notes: step, status, and what the answer says."""
    root = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    api, written = Api(spark, root), Api(spark, root, model=P.LanguageModel(_writer))
    steps: list[tuple[str, int, str]] = []

    def step(name: str, answer: Answer, tell: Callable[[dict], object]) -> Answer:
        steps.append((name, answer.status, str(tell(answer.body)) if answer.status == 200 else answer.body["error"]))
        return answer

    labels = lambda rows: "|".join(r["label"] for r in rows)
    step("login without an address", api.login("nobody"), str)
    step("sources without a session", api.sources(None), str)
    step("sources with a broken session", api.sources("%7B%22id"), str)
    me = step("login", api.login(" jo.doe@example.org "), lambda b: b["user"]["name"]).cookie
    step("listing", api.connector(me, "notion"), lambda b: "|".join(sorted(x["external_id"] for x in b["documents"])))
    step("unknown connector", api.connector(me, "other"), str)
    step("sync", api.sync(me, "notion", CREATED, ["notion-trees", "notion-exam", "nowhere"]), lambda b: f"{len(b['ingested'])}, {b['failed'][0]['name']}: {b['failed'][0]['reason']}")
    step("sync all", api.sync(me, "notion", CREATED), lambda b: f"{len(b['ingested'])}, {len(b['failed'])}")
    found = step("sources", api.sources(me), lambda b: f"{len(b['documents'])}, {b['totals']['passages']}, {b['capabilities']['embedding_provider']}, {b['capabilities']['llm']}")
    step("sources of another", api.sources(api.login("other@example.org").cookie), lambda b: len(b["documents"]))
    step("taxonomy", api.taxonomy(me), lambda b: f"{labels(b['weeks'])}, {b['document_count']}, {b['chunk_count']}")
    step("empty search", api.search(me, {"query": "  "}), str)
    step("search", api.search(me, {"query": "colouring and rotation", "top_k": 1}), lambda b: f"{b['results'][0]['document']['title']}, {b['results'][0]['week']['label']}, {len(b['results'])}, {b['stale_index']}")
    step("search in a unit", api.search(me, {"query": "shortest paths in week 2"}), lambda b: f"{b['applied_weeks']}, {labels(x['week'] for x in b['results'])}")
    step("summary", api.study(me, {"query": "greedy choice", "filters": {"kinds": ["notion"], "weeks": ["Unplaced"]}}), lambda b: f"{b['generated_by']}, {b['scope']}, {len(b['key_points'])}")
    step("quiz", api.study(me, {"mode": "quiz", "filters": {"weeks": ["Week 3"]}}), lambda b: f"{b['generated_by']}, {b['scope']}, {b['summary'] == S.QUIZ_NOTE}, {len(b['flashcards'])}")
    step("study of nothing", api.study(me, {"filters": {"weeks": ["Week 40"]}}), lambda b: b["summary"] == S.EMPTY_SUMMARY)
    step("written summary", written.study(me, {"query": "graphs"}), lambda b: f"{b['generated_by']}, {b['summary']}, {'|'.join(b['key_points'])}")
    step("quiz that the model fails", written.study(me, {"mode": "quiz", "query": "graphs"}), lambda b: b["generated_by"])
    trees = next(x["id"] for x in found.body["documents"] if x["title"] == "Trees, Week 3")
    step("delete what is not there", api.delete(me, "nothing"), str)
    step("delete", api.delete(me, trees), lambda b: b["ok"])
    step("taxonomy afterwards", api.taxonomy(me), lambda b: f"{labels(b['weeks'])}, {b['document_count']}")
    step("logout", api.logout(), lambda b: b["ok"])
    remove(spark, root)
    return spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], "step bigint, request string, status bigint, answer string")


INGEST_QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    upload_parse, connector_fetch, connector_listing, connector_sync, block_walk, docs_paragraphs,
    newest_documents, point_lookup, reset_owner, store_snapshot, library_totals, ingest_documents, model_enrichment, embedding_texts,
    line_shapes, overlap_tails, clean_newlines, facet_toggle, study_scopes, clamped_k, provider_choice, remote_embedding, sign_in, requests,
)
