"""Study material from retrieved passages: summaries, flashcards, quizzes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import card_concept, card_front, lead_sentence, snippet
from lectern.operators.retrieve import Filters

MODES = ("summary", "flashcards", "quiz")
EMPTY_SUMMARY = "No passage fits this scope. Loosen the filters, or add sources."
QUIZ_NOTE = "A quiz needs a language model; these are flashcards made from the passages."


@dataclass
class StudyRequest:
    owner_id: str
    mode: str = "summary"
    query: str | None = None
    filters: Filters = field(default_factory=Filters)


def check_mode(mode: str | None) -> str:
    return mode if mode in MODES else "summary"


def scope_of(request: StudyRequest) -> tuple[str, str]:
    """(scope, query): without a query the filters say what to look for, and without those the scope's own words do."""
    f, asked = request.filters, (request.query or "").strip()
    scope = ", ".join([*([asked] if asked else []), *f.concepts, *f.weeks, *(f"unit {n}" for n in f.week_numbers)]) or "your whole library"
    return scope, asked or " ".join(f.concepts) or scope


def sources(results: DataFrame) -> DataFrame:
    return results.select("query_id", "rank", F.col("id").alias("chunk_id"), F.col("document.title").alias("document_title"), snippet(F.col("text"), 200).alias("snippet"))


def key_points(results: DataFrame, limit: int = fixed.KEY_POINTS) -> DataFrame:
    return results.filter(F.col("rank") <= limit).select("query_id", "rank", lead_sentence(F.col("text")).alias("key_point"))


def flashcards(results: DataFrame, limit: int = fixed.CARDS) -> DataFrame:
    concept = card_concept(F.col("concepts"), F.col("headings"), F.col("document.title"))
    return results.filter(F.col("rank") <= limit).select("query_id", "rank", card_front(concept).alias("front"), lead_sentence(F.col("text")).alias("back"), concept.alias("concept"))


def context(results: DataFrame) -> DataFrame:
    """query_id, context: the passages as a model prompt shows them, in rank order."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("document.title"), F.lit(" — "), F.col("week.label"), F.lit(" — "), F.array_join("headings", " › "), F.lit("\n"), F.col("text"))
    each = results.select("query_id", F.struct("rank", part.alias("part")).alias("p"))
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("context"))
