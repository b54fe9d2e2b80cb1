"""Uploads: files of any supported type to text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import file_title, is_supported, page_text, strip_html
from lectern.sources.pdf import pdf_pages

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_html(data: bytes) -> str:
    """Paragraphs of a Word file as HTML, headings with their level."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    out = []
    for p in body.iter(f"{_W}p"):
        text = escape("".join(t.text or "" for t in p.iter(f"{_W}t")), quote=False)
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"[Hh]eading ?([1-6])", style.get(f"{_W}val", "")) if style is not None else None
        tag = f"h{level[1]}" if level else "p"
        out.append(f"<{tag}>{text}</{tag}>")
    return "".join(out)


#: Rows and bytes of content that a task hands on at once, at least one row.
PIECE_ROWS, PIECE_BYTES = 64, 1 << 20
_PARSED = "name string, html string, pages array<string>, error string"


def by_pieces(make: Callable[[pa.RecordBatch, int], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the row that ``make`` gives for each row, handed on in pieces, so that what is made of a batch isn't held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                held.append(make(batch, i))
                size += len(batch.column(1)[i].as_buffer() or b"")
                if len(held) >= PIECE_ROWS or size >= PIECE_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
            # freed memory goes back before the next batch is read: other tasks run beside this one
            pa.default_memory_pool().release_unused()

    return run


def _parse_binary(batch: pa.RecordBatch, i: int) -> tuple:
    name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
    try:
        return (name, None, pdf_pages(data), None) if name.lower().endswith(".pdf") else (name, docx_html(data), None, None)
    except Exception as e:  # one file's failure is that file's answer
        return name, None, None, f"{type(e).__name__}: {e}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, failed) of files (name, length, content): the parser goes by extension, each file fails on its own.

    documents: external_id, title, text, kind, origin, updated_at. failed: name, error.
    Only PDF and Word files pass through Python.
    """
    low = F.lower("name")
    binary = low.endswith(".pdf") | low.endswith(".docx")
    reason = F.when(~is_supported(F.col("name")), "unsupported file type").when(F.col("length") > fixed.MAX_UPLOAD_BYTES, "file is over 20 MB")
    gated = files.withColumn("_error", reason)
    ok = gated.filter("_error is null")
    text = F.decode("content", "UTF-8")
    plain = ok.filter(~binary).select("name", F.when(low.endswith(".html") | low.endswith(".htm"), strip_html(text)).otherwise(text).alias("text"), F.lit(None).cast("string").alias("error"))
    fields = pa.schema([("name", pa.string()), ("html", pa.string()), ("pages", pa.list_(pa.string())), ("error", pa.string())])
    parsed = ok.filter(binary).select("name", "content").mapInArrow(by_pieces(_parse_binary, fields), _PARSED)
    packed = parsed.select("name", F.when(F.col("pages").isNotNull(), page_text(F.col("pages"))).otherwise(strip_html(F.col("html"))).alias("text"), "error")
    both = plain.unionByName(packed)
    none = F.lit(None).cast("string")
    documents = both.filter("error is null").select(F.concat(F.lit("upload:"), "name").alias("external_id"), file_title(F.col("name")).alias("title"), "text", F.lit("upload").alias("kind"), F.col("name").alias("origin"), none.alias("updated_at"))
    failed = gated.filter("_error is not null").select("name", F.col("_error").alias("error")).unionByName(both.filter("error is not null").select("name", "error"))
    return documents, failed
