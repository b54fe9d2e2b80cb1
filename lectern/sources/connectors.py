"""Connectors as Spark data sources: list and fetch documents of a note service, live or from fixtures.

``spark.dataSource.register(NotesConnector)``, then
``spark.read.format("notes_connector").option("service", "notion").load()``. Options:
``ids`` (comma-separated external ids), ``list`` (true: references only), ``live`` (true, false, or auto, which is the default: live where the service's variable holds a token).
A document that can't be fetched is a row with its ``error``; ``read_connector`` makes text of blocks and paragraphs.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.functions.text import trim

#: Services: the variable of the token, name and description.
SERVICES = {
    "notion": ("NOTION_TOKEN", "Notion", "Pages of a Notion workspace."),
    "gdocs": ("GOOGLE_ACCESS_TOKEN", "Google Docs", "Documents of a Google Drive."),
}
# Fixed values of the services' interfaces.
PAGE_SIZE, LISTED, BLOCKS, DEPTH = 50, 50, 100, 3
NOTION_VERSION = "2022-06-28"
GOOGLE_MIME = "application/vnd.google-apps.document"

#: Own sample documents: (external id, title, text).
FIXTURES = {
    "notion": (
        ("notion-graphs", "Graphs, Weeks 1-2", "# Week 1: Graph basics\n## Adjacency lists\nAn adjacency list stores, for each vertex, the vertices next to it; sparse graphs stay small that way.\n\n## Breadth-first search\nBreadth-first search visits vertices by distance from the source and finds shortest paths by edges.\n\n# Week 2: Shortest paths\n## Bellman-Ford\nBellman-Ford relaxes every edge again and again, and so copes with negative weights."),
        ("notion-trees", "Trees, Week 3", "# Week 3: Balanced trees\n## Red-black trees\nRed-black trees keep the longest path within twice the shortest by colouring and rotation.\n\n## Bellman Ford recap\nA last look at Bellman Ford before the exam, with its running time and its use of relaxation."),
        ("notion-exam", "Exam preparation", "Checklist\nRevise the proofs from the first half, redo every exercise sheet once, and sleep before the exam.\n\nOpen questions\nWhen does a greedy choice stay safe, and how would one show that it does not?"),
    ),
    "gdocs": (
        ("gdoc-stats-1", "Statistics notes", "Lecture 1: Sampling\nA sample is random if every unit had the same chance of being drawn into it, known in advance.\nBias\nA biased sample stays biased however large it grows; only the design can mend that.\n\nLecture 2: Estimation\nAn estimator is consistent if it settles on the true value as the sample grows."),
        ("gdoc-stats-2", "More statistics", "Lecture 3: Tests\nA p-value says how surprising the data would be if the null hypothesis held.\nt-tests\nA t-test compares two means in units of their standard error, which it has to estimate.\n\nChapter 9 of the book covers the same ground."),
        ("gdoc-loose", "Loose notes", "these notes have no headings at all, only paragraphs that run on until the writer stopped.\n\nthe second paragraph is there so that there are two of them, and both are long enough to keep."),
    ),
}


BLOCK = "struct<kind:string,text:string,depth:int,language:string>"
PARAGRAPH = "struct<style:string,runs:array<string>>"


def block_markdown(block: Column) -> Column:
    """One block (kind, text, depth, language) as Markdown; list items are indented by depth, headings, code and dividers stand apart."""
    kind, text = block["kind"], F.coalesce(block["text"], F.lit(""))
    item = lambda mark: F.concat(F.repeat(F.lit("  "), block["depth"]), F.lit(mark), text)
    apart = lambda *parts: F.concat(F.lit("\n"), *parts, F.lit("\n"))
    fence = F.lit("```")
    return (
        F.when(kind == "heading_1", apart(F.lit("# "), text))
        .when(kind.isin("heading_2", "child_page"), apart(F.lit("## "), text))
        .when(kind == "heading_3", apart(F.lit("### "), text))
        .when(kind == "bulleted_list_item", item("- "))
        .when(kind == "numbered_list_item", item("1. "))
        .when(kind == "to_do", item("- [ ] "))
        .when(kind == "quote", F.concat(F.lit("> "), text))
        .when(kind == "code", apart(fence, F.coalesce(block["language"], F.lit("")), F.lit("\n"), text, F.lit("\n"), fence))
        .when(kind == "divider", F.lit("\n---\n"))
        .otherwise(text)
    )


def _joined(lines: Column) -> Column:
    """Lines as one text, with at most one empty line in a row."""
    return trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def blocks_text(blocks: Column) -> Column:
    return _joined(F.transform(blocks, block_markdown))


def rich_text(runs: Column) -> Column:
    """The text of array<struct<plain_text>>."""
    return F.array_join(F.transform(F.coalesce(runs, F.array().cast("array<struct<plain_text:string>>")), lambda r: F.coalesce(r["plain_text"], F.lit(""))), "")


def blocks_to_documents(blocks: DataFrame) -> DataFrame:
    """page_id, text from landed block rows: page_id, parent_id (null at the top), block_id, position, kind, rich_text, language.

    Children follow their parent, down to ``DEPTH`` levels. Each block looks its ancestors up, one join a level; blocks that reach no top drop out.
    """
    place = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    walked = blocks.select("page_id", "kind", rich_text(F.col("rich_text")).alias("text"), "language", F.col("parent_id").alias("up"), F.lit(0).alias("depth"), place("position").alias("path"))
    above = blocks.select("page_id", F.col("block_id").alias("up"), F.lit(True).alias("_found"), F.col("parent_id").alias("_next"), place("position").alias("_place"))
    for level in range(1, DEPTH + 1):
        # a block at the top has no parent to meet; one whose parent isn't there is in no walk
        walked = walked.join(above, ["page_id", "up"], "left").filter("up IS NULL OR _found")
        walked = walked.select("page_id", "kind", "text", "language", F.col("_next").alias("up"), F.when(F.col("_found"), level).otherwise(F.col("depth")).alias("depth"), F.concat_ws("/", "_place", "path").alias("path"))
    walked = walked.filter("up IS NULL")
    part = F.struct("path", F.struct("kind", "text", F.col("depth").cast("int").alias("depth"), "language").alias("block"))
    placed = walked.groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return placed.select("page_id", blocks_text(F.transform("parts", lambda p: p["block"])).alias("text"))


def paragraphs_text(paragraphs: Column) -> Column:
    """Text of array<struct<style,runs>>: runs joined, final newlines cut, headings marked, blank paragraphs kept as empty lines."""

    def one(p: Column) -> Column:
        text = F.regexp_replace(F.array_join(p["runs"], ""), r"\n+\z", "")
        level = F.regexp_extract(F.coalesce(p["style"], F.lit("")), r"\AHEADING_([1-6])\z", 1)
        return F.when(trim(text) == "", F.lit("")).when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text)).otherwise(text)

    return _joined(F.transform(paragraphs, one))


def call(url: str, token: str, body: dict | None = None, headers: dict | None = None) -> dict:
    """One authenticated request; any status but 2xx raises with the status and the body."""
    data = json.dumps(body).encode() if body is not None else None
    request = urllib.request.Request(url, data=data, headers={"Authorization": f"Bearer {token}", "Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{url} answered {e.code}: {e.read().decode(errors='replace')[:500]}") from e


def _notion_blocks(token: str, block: str, depth: int = 0) -> Iterator[dict]:
    """The blocks under one, page by page of the listing, children after their parent."""
    cursor = None
    while True:
        url = f"https://api.notion.com/v1/blocks/{block}/children?page_size={BLOCKS}" + (f"&start_cursor={cursor}" if cursor else "")
        page = call(url, token, headers={"Notion-Version": NOTION_VERSION})
        for b in page["results"]:
            inner = b.get(b["type"]) or {}
            text = inner.get("title", "") if b["type"] == "child_page" else _plain(inner.get("rich_text"))
            yield {"kind": b["type"], "text": text, "depth": depth, "language": inner.get("language")}
            if b.get("has_children") and depth < DEPTH:
                yield from _notion_blocks(token, b["id"], depth + 1)
        cursor = page.get("next_cursor") if page.get("has_more") else None
        if not cursor:
            return


def _plain(runs: list[dict] | None) -> str:
    return "".join(r.get("plain_text") or "" for r in runs or [])


def _live(service: str, token: str) -> Iterator[tuple]:
    if service == "notion":
        found = call("https://api.notion.com/v1/search", token, {"filter": {"property": "object", "value": "page"}, "page_size": LISTED}, {"Notion-Version": NOTION_VERSION})
        for p in found["results"]:
            titles = [_plain(v.get("title")) for v in (p.get("properties") or {}).values() if v.get("type") == "title"]
            yield p["id"], (titles or [""])[0] or "Untitled Notion page", p.get("url"), p.get("last_edited_time")
    else:
        query = urllib.parse.quote(f"mimeType='{GOOGLE_MIME}' and trashed=false")
        found = call(f"https://www.googleapis.com/drive/v3/files?q={query}&pageSize={PAGE_SIZE}&fields=files(id,name,webViewLink,modifiedTime)", token)
        for d in found["files"]:
            yield d["id"], d["name"], d.get("webViewLink"), d.get("modifiedTime")


def _paragraphs(token: str, doc: str) -> Iterator[dict]:
    for part in (call(f"https://docs.googleapis.com/v1/documents/{doc}", token).get("body") or {}).get("content", []):
        if (p := part.get("paragraph")) is not None:
            runs = [(e.get("textRun") or {}).get("content") or "" for e in p.get("elements", [])]
            yield {"style": (p.get("paragraphStyle") or {}).get("namedStyleType"), "runs": runs}


class _Doc(InputPartition):
    def __init__(self, row: tuple):
        self.value = row


class ConnectorReader(DataSourceReader):
    """One partition for each document, so texts are fetched on the executors, and each fails on its own."""

    def __init__(self, options: dict):
        self.service = options.get("service", "")
        if self.service not in SERVICES:
            raise ValueError(f"unknown connector {self.service!r}")
        variable = SERVICES[self.service][0]
        given, asked = os.environ.get(variable, ""), options.get("live", "auto").lower()
        if asked == "true" and not given:
            raise ValueError(f"live {self.service} needs {variable}")
        self.token = "" if asked == "false" else given
        self.listing = options.get("list", "false").lower() == "true"
        self.ids = [i for i in options.get("ids", "").split(",") if i]

    def partitions(self) -> list[InputPartition]:
        rows = list(_live(self.service, self.token) if self.token else ((i, t, None, None) for i, t, _ in FIXTURES[self.service]))
        if not self.ids:
            return [_Doc(r) for r in rows]
        known = {r[0]: r for r in rows}
        # what the listing's first page doesn't show may still be there live; of the fixtures it is all
        return [_Doc(known.get(i, (i, None, None, None))) for i in self.ids]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        doc, title, origin, updated = partition.value
        text = blocks = paragraphs = error = None
        try:
            if not self.listing:
                if not self.token:
                    text = next((x for i, _, x in FIXTURES[self.service] if i == doc), None)
                    error = f"unknown document {doc}" if text is None else None
                elif self.service == "notion":
                    blocks = list(_notion_blocks(self.token, doc))
                else:
                    paragraphs = list(_paragraphs(self.token, doc))
        except Exception as e:  # one document's failure is that document's answer
            error = str(e)
        yield doc, title or doc, text, self.service, origin, updated, blocks, paragraphs, error


class NotesConnector(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes_connector"

    def schema(self) -> str:
        return f"external_id string, title string, text string, kind string, origin string, updated_at string, blocks array<{BLOCK}>, paragraphs array<{PARAGRAPH}>, error string"

    def reader(self, schema) -> DataSourceReader:
        return ConnectorReader(dict(self.options))


def connectors() -> list[dict]:
    """The registry: id, name, description, whether a token makes it live, and the variable that would."""
    return [{"id": s, "name": name, "description": about, "live": bool(os.environ.get(variable)), "requires": variable} for s, (variable, name, about) in SERVICES.items()]


def read_connector(spark: SparkSession, service: str, ids: list[str] | None = None, listing: bool = False, live: bool | None = None) -> DataFrame:
    """external_id, title, text, kind, origin, updated_at, error; live where the service's variable holds a token, unless ``live`` says otherwise."""
    spark.dataSource.register(NotesConnector)
    reader = spark.read.format("notes_connector").options(service=service, list=str(listing).lower(), live="auto" if live is None else str(live).lower(), ids=",".join(ids or []))
    text = F.coalesce("text", F.when(F.col("blocks").isNotNull(), blocks_text(F.col("blocks"))), F.when(F.col("paragraphs").isNotNull(), paragraphs_text(F.col("paragraphs"))))
    return reader.load().withColumn("text", text).drop("blocks", "paragraphs")
