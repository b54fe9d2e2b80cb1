"""Structure-aware chunking: sections by heading, passages packed to a target size with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.units import canonical_scheme, find_markers

_SPACE = fixed.SPACES
_S = f"[{_SPACE}]"
_MARKDOWN = re.compile(rf"(#{{1,6}}){_S}+(.*[^{_SPACE}]){_S}*\Z")
_UNIT = re.compile(rf"(?:{fixed.UNIT_NAMES}|w[0-9])(?![A-Za-z0-9_])", re.IGNORECASE | re.ASCII)
_SENTENCES = re.compile(fixed.SENTENCE.replace(r"\s", _S).replace(r"\z", r"\Z"))
_BREAK = re.compile(rf"[.!?]{_S}")


@dataclass
class Section:
    """Paragraphs under one trail of headings, each with its offset in the source."""

    trail: list[str]
    paragraphs: list[tuple[str, int]] = field(default_factory=list)


def heading_of(line: str, starts_block: bool) -> tuple[int, str] | None:
    """(level, text) if a line is a heading: marked as one or, where a block may start, by its shape."""
    if marked := _MARKDOWN.match(line):
        return len(marked[1]), marked[2]
    bare = line.strip(_SPACE)
    shaped = starts_block and 1 <= len(bare) <= 60 and len(re.split(f"{_S}+", bare)) <= 9 and re.match("[A-Z0-9]", bare) and bare[-1] not in ".,;:!?"
    return (2 if _UNIT.match(bare) else 3, bare) if shaped else None


def sections(source: str) -> list[Section]:
    """Every heading opens a section, whose trail has the last heading of each level above its own."""
    levels: dict[int, str] = {}
    out = [Section([])]
    lines: list[str] = []
    at = start = 0

    def close() -> None:
        if text := "\n".join(lines).strip(_SPACE):
            out[-1].paragraphs.append((text, start))
        lines.clear()

    for raw in source.split("\n"):
        line = raw.removesuffix("\r")
        if found := heading_of(line, not lines):
            close()
            level, text = found
            levels = {k: v for k, v in levels.items() if k < level} | {level: text}
            out.append(Section([levels[k] for k in sorted(levels)]))
        elif line.strip(_SPACE):
            if not lines:
                start = at
            lines.append(line)
        else:
            close()
        at += len(line) + 1
    close()
    return out


def overlap(text: str) -> str:
    """What the next passage repeats of this one."""
    if len(text) <= fixed.CHUNK_OVERLAP:
        return text
    tail = text[-fixed.CHUNK_OVERLAP :]
    cut = _BREAK.search(tail)
    return tail[cut.start() + 2 :] if cut else tail


def pack_sentences(text: str) -> Iterator[str]:
    """A paragraph over the maximum in pieces under it, where its sentences allow; the last piece stays open."""
    held = ""
    for sentence in _SENTENCES.findall(text) or [text]:
        if held and len(held) + len(sentence) > fixed.CHUNK_MAX:
            yield held
            held = overlap(held)
        held += sentence
    yield held


def passages(section: Section) -> Iterator[tuple[str, int]]:
    """(text, offset) of a section's passages, also those too short to keep."""
    held, at = "", 0
    for text, offset in section.paragraphs:
        if not held:
            at = offset
        joined = f"{held}\n\n{text}" if held else text
        if len(joined) > fixed.CHUNK_MAX:
            if held:
                yield held, at
            *whole, held = pack_sentences(text)
            yield from ((piece, offset) for piece in whole)
            at = offset
        elif len(joined) >= fixed.CHUNK_TARGET:
            yield joined, at
            held, at = overlap(joined), offset + len(text)
        else:
            held = joined
    if held:
        yield held, at


def split_document(source: str) -> list[tuple[str, list[str], int]]:
    """(text, headings, offset) of all passages that are long enough, in order."""
    found = ((text.strip(_SPACE), s.trail, at) for s in sections(source) for text, at in passages(s))
    return [x for x in found if len(x[0]) >= fixed.CHUNK_LEAST]


_CHUNK = "struct<ordinal:int,text:string,headings:array<string>,offset:int>"


def _split(texts: pd.Series) -> pd.Series:
    as_rows = lambda t: [{"ordinal": i, "text": x, "headings": h, "offset": o} for i, (x, h, o) in enumerate(split_document(t or ""))]
    return texts.map(as_rows)


def chunk_documents(docs: DataFrame, key: str = "document_id", title: str = "title", text: str = "text") -> DataFrame:
    """key, ordinal, text, headings, week: the passages of each document and the unit each belongs to.

    Packing is sequential within a document, so it runs in Arrow batches, next to
    the scan and without a shuffle. Units stay native: markers of title and text
    together, of the document's main scheme only; the last one at or before a
    passage counts, explicit if near, and one in the title is the default.
    """
    marked = docs.select(key, F.coalesce(F.col(title), F.lit("")).alias("_title"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    marked = marked.withColumn("_m", find_markers(F.concat("_title", F.lit("\n"), "_text"))).withColumn("_scheme", canonical_scheme(F.col("_m")))
    shift = F.length("_title") + 1
    own = F.transform(F.filter("_m", lambda m: m["scheme"] == F.col("_scheme")), lambda m: F.struct((m["index"] - shift).alias("at"), m["number"].alias("number")))
    chunks = marked.withColumn("_own", own).select(key, "_scheme", "_own", F.explode(F.pandas_udf(_split, f"array<{_CHUNK}>")(F.col("_text"))).alias("c"))

    before = F.filter("_own", lambda m: (m["at"] >= 0) & (m["at"] <= F.col("c.offset")))
    last = F.try_element_at(before, F.lit(-1))
    default = F.get(F.filter("_own", lambda m: m["at"] < 0), F.lit(0))["number"]
    number = F.coalesce(last["number"], default)
    near = F.coalesce(last["at"] >= F.col("c.offset") - fixed.EXPLICIT_WITHIN, F.lit(False))
    placed = F.struct(number.alias("number"), F.concat("_scheme", F.lit(" "), number.cast("string")).alias("label"), F.when(near, "explicit").otherwise("inherited").alias("confidence"))
    none = F.struct(F.lit(None).cast("int").alias("number"), F.lit("Unplaced").alias("label"), F.lit("inferred").alias("confidence"))
    return chunks.select(key, F.col("c.ordinal").alias("ordinal"), F.col("c.text").alias("text"), F.col("c.headings").alias("headings"), F.when(number.isNull(), none).otherwise(placed).alias("week"))
