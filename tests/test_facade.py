"""The library, its requests, connectors with stubbed services, the store and the stream, on small collections of our own."""

import http.server
import json
import threading
import zlib

import pytest
from pyspark.sql import functions as F
from test_library import docx

from lectern.api import Api
from lectern.library import Library
from lectern.operators.providers import LanguageModel, RemoteEmbedder, describe_error
from lectern.operators.retrieve import Filters
from lectern.operators.study import EMPTY_SUMMARY, QUIZ_NOTE, StudyRequest
from lectern.sources import connectors
from lectern.sources.files import parse_files
from lectern.sources.pdf import pdf_pages
from lectern.sources.store import Store
from lectern.streaming.ingest import RAW_SCHEMA, ingest_stream

NOW = "2024-01-02T03:04:05.000Z"
HEAPS = "# Week 2: Heaps\n## Binary heaps\nA binary heap keeps every parent before its children, and so the first element first.\n\n# Week 4: Hashing\n## Hash tables\nA hash table finds a key by where its hash says that it must be."


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/heaps.md").write_text(HEAPS)
    (tmp_path / "in/page.html").write_text("<h1>Lecture 3: Sorting</h1><p>Merge sort splits, sorts both halves and merges them again in order.</p>")
    (tmp_path / "in/empty.txt").write_text("nothing much")
    (tmp_path / "in/tool.exe").write_text("binary")
    (tmp_path / "in/broken.docx").write_bytes(b"no zip")
    return tmp_path


def titles(df):
    return sorted(r["title"] for r in df.collect())


def test_library_from_upload_to_reset(spark, folder):
    lib = Library(spark, f"{folder}/store", "me")
    assert lib.sources().count() == 0 and lib.search("heaps")[0].count() == 0
    with pytest.raises(ValueError, match="no files"):
        (folder / "none").mkdir()
        lib.upload(f"{folder}/none", NOW)
    report, failed = lib.upload(f"{folder}/in", NOW)
    assert titles(report) == ["heaps", "page"]
    assert {r["name"]: r["error"].split(":")[0] for r in failed.collect()} == {"empty.txt": "document is too short", "tool.exe": "unsupported file type", "broken.docx": "BadZipFile"}
    report, failed = lib.sync("notion", NOW, ["notion-graphs", "nowhere"], live=False)
    assert titles(report) == ["Graphs, Weeks 1-2"] and [tuple(r) for r in failed.collect()] == [("nowhere", "unknown document nowhere")]
    lib.sync("notion", NOW, live=False)
    # one document each, however often it came; the newer sync is last
    assert [r["title"] for r in lib.sources().collect()] == ["heaps", "page", "Exam preparation", "Graphs, Weeks 1-2", "Trees, Week 3"]
    assert lib.totals().first()["document_count"] == 5 and lib.totals().first()["passages"] == lib.taxonomy()[2].first()["chunk_count"] == 10
    assert Library(spark, f"{folder}/store", "you").sources().count() == 0

    units, concepts, _ = lib.taxonomy()
    assert [r["label"] for r in units.collect()] == ["Lecture 3", "Week 1", "Week 2", "Week 3", "Week 4", "Unplaced"]
    names = [r["name"] for r in concepts.collect()]
    assert sorted(n for n in names if n.startswith("Bellman")) == ["Bellman Ford Recap", "Bellman-Ford"] and "Binary Heaps" in names

    results, meta = lib.search("binary heap", k=3)
    rows = results.orderBy("rank").collect()
    assert rows[0]["document"]["title"] == "heaps" and len(rows) == 3 and "embedding" not in results.columns
    assert rows[0]["week"]["label"] == "Week 2" and rows[0]["breakdown"]["lexical"] > 0 and not meta.first()["stale_index"]
    of = lambda q, **f: sorted({r["week"]["label"] for r in lib.search(q, Filters(**f), 30)[0].collect()})
    assert of("paths", weeks=["Week 4"]) == ["Week 4"] and of("paths", week_numbers=[3]) == ["Lecture 3", "Week 3"] and of("paths in week 4") == ["Week 4"]
    assert of("paths", kinds=["notion"]) == ["Unplaced", "Week 1", "Week 2", "Week 3"] and of("paths", document_ids=[rows[0]["document_id"]]) == ["Week 2", "Week 4"]
    assert of("paths", concepts=["HASH TABLES"]) == ["Week 4"] and of("paths", weeks=["Week 9"]) == []
    assert lib.search("paths in week 4")[1].first()["applied_weeks"] == ["unit 4"]
    with pytest.raises(ValueError):
        lib.search("   ")

    # a changed file replaces its passages, also after a restart
    (folder / "in/heaps.md").write_text("# Week 7: Tries\nA trie shares the beginnings of its words, one letter a level, down to the leaves.")
    again = Library(spark, f"{folder}/store", "me")
    again.upload(f"{folder}/in", NOW)
    assert again.sources().count() == 5 and "Week 4" not in [r["label"] for r in again.taxonomy()[0].collect()]
    heaps = next(r["id"] for r in again.sources().collect() if r["title"] == "heaps")
    assert not again.delete("nothing") and not Library(spark, f"{folder}/store", "you").delete(heaps) and again.delete(heaps)
    assert "Week 7" not in [r["label"] for r in again.taxonomy()[0].collect()]
    again.reset()
    assert [x.count() for x in again.store.tables()] == [0, 0, 0]


def test_study_with_and_without_a_model(spark, folder):
    def answer(prompt: str) -> str:
        if prompt.startswith("mode: summary"):
            return json.dumps({"summary": "All of it.", "key_points": ["one", "two"]})
        if prompt.startswith("mode: flashcards"):
            return json.dumps({"flashcards": [{"front": "f", "back": "b", "concept": "c"}]})
        if prompt.startswith("mode: quiz"):
            raise RuntimeError("no more questions")
        return json.dumps({"scheme": "Week", "sections": [{"ordinal": 0, "week_number": 9, "concepts": [" Priority queues ", ""]}]})

    plain = Library(spark, f"{folder}/plain", "me")
    assert plain.study(StudyRequest("me"))["summary"] == EMPTY_SUMMARY
    plain.upload(f"{folder}/in", NOW)
    found = plain.study(StudyRequest("me", "poem", "binary heap"))
    assert found["mode"] == "summary" and found["generated_by"] == "extractive" and len(found["key_points"]) == len(found["sources"]) == 3
    assert found["key_points"][0].startswith("A binary heap keeps") and found["sources"][0]["document_title"] == "heaps"
    quiz = plain.study(StudyRequest("me", "quiz", None, Filters(weeks=["Week 4"])))
    assert quiz["scope"] == "Week 4" and quiz["summary"] == QUIZ_NOTE and quiz["flashcards"][0]["front"] == "What do your notes say about Hash Tables?"

    lib = Library(spark, f"{folder}/model", "me", model=LanguageModel(answer))
    report, _ = lib.upload(f"{folder}/in", NOW)
    assert all(r["llm_enriched"] for r in report.collect()) and lib.capabilities()["llm"]
    units = {r["label"]: r["concepts"] for r in lib.taxonomy()[0].collect()}
    # the first section of each goes to unit 9 of its own scheme, the second of heaps stays, without concepts
    assert units == {"Lecture 9": ["Priority queues"], "Week 4": [], "Week 9": ["Priority queues"]}
    assert lib.study(StudyRequest("me", "summary", "heaps"))["key_points"] == ["one", "two"]
    assert lib.study(StudyRequest("me", "flashcards", "heaps"))["flashcards"] == [{"front": "f", "back": "b", "concept": "c"}]
    failed = lib.study(StudyRequest("me", "quiz", "heaps"))
    assert failed["generated_by"] == "extractive" and failed["summary"] == QUIZ_NOTE


def test_errors_of_a_model_are_told_apart(spark):
    class Refused(Exception):
        status = 401

    class Busy(Exception):
        code = 429

    assert "credentials" in describe_error(Refused()) and "rate limit" in describe_error(Busy()) and describe_error(ValueError("odd")) == "odd"

    def fails(prompt: str) -> str:
        raise ValueError("odd")

    row = LanguageModel(fails).ask(spark.createDataFrame([("p",)], "p string"), F.col("p"), "a int").first()
    assert row["answer"] is None and row["answer_error"] == "odd"


def test_a_remote_embedder_sees_the_cleaned_query(spark, folder):
    embedder = RemoteEmbedder("voyage", lambda texts: [{"index": i, "embedding": [float(len(t)), 10.0]} for i, t in enumerate(texts)])
    lib = Library(spark, f"{folder}/remote", "me", embedder)
    lib.upload(f"{folder}/in", NOW)
    row = lib.search("week 2 binary heap", k=1)[0].first()
    vector = lambda n: (n / (n * n + 100) ** 0.5, 10 / (n * n + 100) ** 0.5)
    chunk = lib.store.read("chunks").filter(F.col("id") == row["id"]).first()
    want = sum(a * b for a, b in zip(vector(len("binary heap")), chunk["embedding"], strict=True))
    assert abs(row["breakdown"]["dense"] - want) < 1e-9
    # under another embedder the index is stale
    results, meta = Library(spark, f"{folder}/remote", "me").search("binary heap")
    assert meta.first()["stale_index"] and {r["breakdown"]["dense"] for r in results.collect()} == {0.0}


def test_requests(spark, folder):
    api = Api(spark, f"{folder}/api")
    assert api.login("nobody").status == api.login(None).status == 400
    assert api.sources(None).status == api.sources("no cookie").status == api.sources("%7B%22id%22").status == 401
    done = api.login(" Ann_Lee@Example.org ")
    assert done.body["user"]["name"] == "Ann Lee" and done.body["user"]["email"] == "Ann_Lee@Example.org" and api.logout().cookie == ""
    me = done.cookie
    assert api.upload(me, f"{folder}/in", NOW).body["failed"][0].keys() == {"name", "reason"}
    found = api.sources(me)
    assert found.status == 200 and found.body["capabilities"]["embedding_provider"] == "local" and [c["id"] for c in found.body["connectors"]] == ["notion", "gdocs"]
    assert found.body["totals"] == {"document_count": 2, "passages": 3}
    assert api.connector(me, "nothing").status == 404 and len(api.connector(me, "gdocs").body["documents"]) == 3 and api.connector(None, "gdocs").status == 401
    assert api.sync(me, "nothing", NOW).status == 404 and len(api.sync(me, "gdocs", NOW, ["gdoc-stats-1"]).body["ingested"]) == 1
    assert api.search(me, {"query": " "}) .status == 400
    hit = api.search(me, {"query": "binary heap", "filters": {"weeks": ["Week 2"]}, "top_k": 2}).body
    assert hit["results"][0]["week"]["label"] == "Week 2" and hit["applied_weeks"] == ["Week 2"] and hit["provider"]["id"] == "local" and not hit["stale_index"]
    assert api.study(me, {"mode": "flashcards", "query": "heap"}).body["flashcards"]
    assert {"weeks", "concepts", "document_count", "chunk_count"} == set(api.taxonomy(me).body)
    doc = found.body["documents"][0]["id"]
    assert api.delete(me, "nothing").status == 404 and api.delete(me, doc).status == 200 and len(api.sources(me).body["documents"]) == 2
    assert api.upload(me, f"{folder}/not there", NOW).status == 400


def service(url, token, body=None, headers=None):
    """Both services, as their readers call them."""
    text = lambda x: [{"plain_text": x}]
    if url.endswith("/v1/search"):
        assert body["page_size"] == 50 and headers["Notion-Version"]
        page = {"id": "p1", "url": "u1", "last_edited_time": "t1", "properties": {"Name": {"type": "title", "title": text("Week 1 notes")}}}
        return {"results": [page, {"id": "p2", "properties": {"x": {"type": "number"}}}, {"id": "p3"}]}
    if "/blocks/p1/" in url:
        if "start_cursor" in url:
            return {"results": [{"id": "b9", "type": "divider", "divider": {}}, {"id": "b10", "type": "child_page", "child_page": {"title": "Inner"}}], "has_more": False}
        first = [{"id": "b1", "type": "heading_1", "heading_1": {"rich_text": text("Top")}}, {"id": "b2", "type": "bulleted_list_item", "has_children": True, "bulleted_list_item": {"rich_text": text("outer")}}]
        return {"results": [*first, {"id": "b3", "type": "code", "code": {"rich_text": text("x = 1"), "language": "python"}}], "has_more": True, "next_cursor": "c2"}
    if "/blocks/b" in url:
        deeper = "/blocks/b2dddd/" not in url
        return {"results": [{"id": url.split("/")[-2] + "d", "type": "to_do", "has_children": deeper, "to_do": {"rich_text": text("inner"), "checked": True}}]}
    if "/blocks/p3/" in url:
        raise RuntimeError("gone")
    if "drive/v3/files" in url:
        return {"files": [{"id": "d1", "name": "Stats", "webViewLink": "w1", "modifiedTime": "m1"}]}
    if "/documents/d1" in url:
        run = lambda s, *t: {"paragraph": {"paragraphStyle": {"namedStyleType": s}, "elements": [{"textRun": {"content": x}} for x in t] + [{}]}}
        return {"body": {"content": [{"sectionBreak": {}}, run("TITLE", "Stats", "\n"), run("HEADING_2", "Samp", "ling\n"), run("HEADING_2", " \n"), run("NORMAL_TEXT", "A sample.\n\n"), {"paragraph": {}}, {"paragraph": {}}, {"paragraph": {}}, run(None, "End\n")]}}
    return {"results": []}


def read(reader):
    return [row for part in reader.partitions() for row in reader.read(part)]


def test_live_connectors(spark, monkeypatch):
    monkeypatch.setattr(connectors, "call", service)
    monkeypatch.setenv("NOTION_TOKEN", "t")
    monkeypatch.setenv("GOOGLE_ACCESS_TOKEN", "t")
    assert [c["live"] for c in connectors.connectors()] == [True, True]
    schema = connectors.NotesConnector({}).schema()
    rows = read(connectors.ConnectorReader({"service": "notion"}))
    assert [(r[0], r[1], r[4], r[5]) for r in rows] == [("p1", "Week 1 notes", "u1", "t1"), ("p2", "Untitled Notion page", None, None), ("p3", "Untitled Notion page", None, None)]
    # one page's failure is its own; its children end at the third level below it
    assert [r[8] for r in rows] == [None, None, "gone"] and [b["depth"] for b in rows[0][6]] == [0, 0, 1, 2, 3, 0, 0, 0]
    made = spark.createDataFrame(rows, schema).select("external_id", connectors.blocks_text(F.col("blocks")).alias("t")).collect()
    assert made[0]["t"] == "# Top\n\n- outer\n  - [ ] inner\n    - [ ] inner\n      - [ ] inner\n\n```python\nx = 1\n```\n\n---\n\n## Inner" and made[1]["t"] == ""
    rows = read(connectors.ConnectorReader({"service": "gdocs", "ids": "d1,d9"}))
    made = spark.createDataFrame(rows, schema).select(connectors.paragraphs_text(F.col("paragraphs")).alias("t")).collect()
    assert made[0]["t"] == "Stats\n## Sampling\n\nA sample.\n\nEnd" and rows[0][4:6] == ("w1", "m1") and rows[1][1] == "d9"
    assert [r[2] for r in read(connectors.ConnectorReader({"service": "gdocs", "list": "true"}))] == [None]
    assert len(read(connectors.ConnectorReader({"service": "notion", "live": "false"}))) == 3
    monkeypatch.delenv("NOTION_TOKEN")
    assert not connectors.ConnectorReader({"service": "notion"}).token
    for options in ({"service": "notion", "live": "true"}, {"service": "other"}):
        with pytest.raises(ValueError):
            connectors.ConnectorReader(options)


def test_calls_carry_the_token_and_raise_on_errors():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            ok = self.path == "/ok" and self.headers["Authorization"] == "Bearer t"
            self.send_response(200 if ok else 503)
            self.end_headers()
            self.wfile.write(self.rfile.read(int(self.headers["Content-Length"])) if ok else b"out of order")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert connectors.call(f"{url}/ok", "t", {"a": 1}) == {"a": 1}
    with pytest.raises(RuntimeError, match="503: out of order"):
        connectors.call(f"{url}/bad", "t", {})
    server.shutdown()


def pdf(contents, extra=b""):
    """A PDF file with a page for each (stream, whether to compress it)."""
    out = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(contents))) + b"] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>"]
    cmap = b"1 beginbfchar <0041> <00E9> endbfchar 1 beginbfrange <0042> <0044> <0061> endbfrange"
    out += [b"<< /Type /Font /BaseFont /Helvetica >>", b"<< /Type /Font /ToUnicode %d 0 R >>" % (5 + 2 * len(contents))]
    for i, (stream, packed) in enumerate(contents):
        data = zlib.compress(stream) if packed else stream
        out += [b"<< /Type /Page /Contents [%d 0 R] >>" % (6 + 2 * i), b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " * packed) + data + b"\nendstream"]
    out.append(b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream")
    return b"%PDF-1.5\n" + extra + b"".join(b"%d 0 obj\n" % (i + 1) + x + b"\nendobj\n" for i, x in enumerate(out)) + b"%%EOF"


def test_pdf(spark):
    pages = [(b"BT /F1 9 Tf (Week\\0401: a \\(b\\)) Tj 0 -12 Td [(two) -300 (wor) 20 (ds)] TJ T* (n\xe9xt) ' ET", False), (b"BT /F2 9 Tf <00410042 0044> Tj ET", True), (b"BT ET", False)]
    assert pdf_pages(pdf(pages)) == ["Week 1: a (b)\ntwo words\n\nnéxt", "éac", ""]
    for bad in (b"hello", pdf(pages, b"/Encrypt 9 0 R\n")):
        with pytest.raises(ValueError):
            pdf_pages(bad)
    files = [("a.PDF", pdf(pages)), ("b.pdf", b"no pdf"), ("c.docx", docx())]
    good, failed = parse_files(spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in files], "name string, length long, content binary"))
    assert {r["title"]: r["text"] for r in good.collect()}["a"] == "Week 1: a (b)\ntwo words\n\nnéxt\n\néac"
    assert [r["name"] for r in failed.collect()] == ["b.pdf"]


def test_a_store_without_a_readable_pointer_is_empty(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.version() is None and [x.count() for x in store.tables()] == [0, 0, 0]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/current").mkdir()
    (tmp_path / "s/current/x.json").write_text("{broken")
    assert [x.count() for x in store.tables()] == [0, 0, 0]


def test_stream_upserts_batch_by_batch(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    row = lambda text: json.dumps({"external_id": "e1", "title": "Week 5", "text": text, "kind": "upload"})
    long = "A sample is random if every unit had the same chance of being drawn."
    (tmp_path / "raw/1.json").write_text(row(long) + "\n" + row(long).replace("e1", "e2"))
    lib = Library(spark, f"{tmp_path}/store", "me")
    run = lambda: ingest_stream(spark.readStream.schema(RAW_SCHEMA).json(f"{tmp_path}/raw"), lib, f"{tmp_path}/cp", NOW).awaitTermination()
    run()
    (tmp_path / "raw/2.json").write_text(row(long + " And more of it."))
    run()
    sizes = {r["external_id"]: r["char_count"] for r in lib.sources().collect()}
    assert sizes == {"e1": len(long) + 16, "e2": len(long)}
