"""Concepts: mined from headings and recurring word pairs, rolled up by document, indexed over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.spans import let
from lectern.functions.text import concept_description, heading_concept, is_concept_word, normalise_concept, short_id, surface_words, title_case
from lectern.functions.units import confidence_rank


_PAIRS = "array<struct<pair:string,surface:string>>"


def word_pairs(text: Column) -> Column:
    """array<struct<pair,surface>>: the pairs of neighbouring concept words of four letters or more, in order; pair is in lower case."""
    fits = lambda w: (F.length(w) >= 4) & is_concept_word(F.lower(w))

    def neighbours(w: Column) -> Column:
        # a word that doesn't fit is null, and so are its pairs
        kept = F.transform(w, lambda x: F.when(fits(x), x))
        joined = let(kept, lambda k: F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.when(F.size(w) < 2, F.array().cast(_PAIRS)).otherwise(F.transform(F.filter(joined, lambda x: x.isNotNull()), lambda x: F.struct(F.lower(x).alias("pair"), x.alias("surface"))))

    return let(surface_words(text), neighbours)


def _recurring(chunks: Column) -> Column:
    """array<struct<ordinal,pair,n,surface>> from array<struct<ordinal,heading,pairs>>, the chunks of one document: counts by chunk of the pairs that recur in the document."""
    places = lambda c: F.transform(c["pairs"], lambda p, i: F.struct(p["pair"].alias("pair"), c["ordinal"].alias("ordinal"), i.alias("at"), p["surface"].alias("surface")))

    def runs(s: Column) -> Column:
        n = F.size(s)
        before = lambda i: F.get(s, F.greatest(i - 1, F.lit(0)))
        new = lambda i: (i == 0) | (s[i]["pair"] != before(i)["pair"]) | (s[i]["ordinal"] != before(i)["ordinal"])

        def counted(starts: Column) -> Column:
            each = F.transform(starts, lambda i, j: F.struct(s[i]["ordinal"].alias("ordinal"), s[i]["pair"].alias("pair"), (F.coalesce(F.get(starts, j + 1), n) - i).alias("n"), s[i]["surface"].alias("surface")))
            same = lambda e, x: F.coalesce(x["pair"] == e["pair"], F.lit(False))
            return let(each, lambda a: F.filter(a, lambda e, j: (e["n"] > 1) | ((j > 0) & same(e, F.get(a, F.greatest(j - 1, F.lit(0))))) | same(e, F.get(a, j + 1))))

        return F.when(n > 0, let(F.filter(F.sequence(F.lit(0), n - 1), new), counted))

    return let(F.array_sort(F.flatten(F.transform(chunks, places))), runs)


def mine_concepts(chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """doc, ordinal, concepts: of each chunk its heading's concept and its most frequent pairs that recur in the document.

    One pair goes with a heading, two without one; a pair whose first word is part
    of the heading's concept adds nothing. Chunks without concepts have an empty list.
    Pairs are filtered and counted within arrays: one shuffle brings the chunks of a document together.
    """
    heading = heading_concept(F.try_element_at("headings", F.lit(-1)))
    found = chunks.select(doc, F.struct("ordinal", heading.alias("heading"), word_pairs(F.col("text")).alias("pairs")).alias("c"))
    whole = found.groupBy(doc).agg(F.collect_list("c").alias("c")).withColumn("r", F.coalesce(_recurring(F.col("c")), F.array().cast("array<struct<ordinal:int,pair:string,n:int,surface:string>>")))
    each = whole.select(doc, F.explode(F.transform("c", lambda c: F.struct(c["ordinal"].alias("ordinal"), c["heading"].alias("heading")))).alias("c"), "r").select(doc, "c.ordinal", "c.heading", "r")
    new = F.filter("r", lambda x: (x["ordinal"] == F.col("ordinal")) & (F.instr(F.lower(F.coalesce("heading", F.lit(""))), F.split(x["pair"], " ")[0]) == 0))
    best = F.array_sort(F.transform(new, lambda x: F.struct((-x["n"]).alias("n"), F.collate(x["pair"], "UNICODE").alias("pair"), x["surface"].alias("surface"))))
    named = F.transform(F.slice(best, 1, F.when(F.col("heading").isNull(), 2).otherwise(1)), lambda x: title_case(x["surface"]))
    none = F.array().cast("array<string>")
    return each.select(doc, "ordinal", F.concat(F.when(F.col("heading").isNull(), none).otherwise(F.array("heading")), named).alias("concepts"))


def apply_model_enrichment(chunks: DataFrame, enrichment: DataFrame | None, doc: str = "document_id") -> DataFrame:
    """Chunks with a model's answer (doc, ordinal, week_number, concepts) in place of mined concepts.

    For a document that the model answered, chunks it left out have no concepts. A
    unit number that differs from the detected one becomes an inferred tag in
    the document's scheme, that of its first placed chunk or else Week. No answer: as mined.
    """
    if enrichment is None:
        return chunks
    answered = enrichment.select(doc).distinct().withColumn("_answered", F.lit(True))
    scheme = chunks.filter("week.number is not null").groupBy(doc).agg(F.split(F.min_by("week.label", "ordinal"), " ")[0].alias("_scheme"))
    given = enrichment.select(doc, "ordinal", F.col("week_number").alias("_week"), F.col("concepts").alias("_concepts"))
    rows = chunks.join(answered, doc, "left").join(scheme, doc, "left").join(given, [doc, "ordinal"], "left")
    moved = F.col("_week").isNotNull() & ~F.col("_week").eqNullSafe(F.col("week.number"))
    inferred = F.struct(F.col("_week").cast("int").alias("number"), F.concat(F.coalesce("_scheme", F.lit("Week")), F.lit(" "), F.col("_week").cast("string")).alias("label"), F.lit("inferred").alias("confidence"))
    concepts = F.when(F.col("_answered"), F.coalesce("_concepts", F.array().cast("array<string>"))).otherwise(F.col("concepts"))
    return rows.withColumns({"week": F.when(moved, inferred).otherwise(F.col("week")), "concepts": concepts}).select(chunks.columns)


def unit_rollup(chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """doc, number, label, confidence: the units of each document, by number, with the strongest tag, the first at ties."""
    best = F.min_by("week", F.struct(confidence_rank(F.col("week.confidence")), F.col("ordinal")))
    return chunks.groupBy(doc, F.col("week.number").alias("number")).agg(best.alias("w")).select(doc, "number", "w.label", "w.confidence")


def concept_rollup(chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """doc, concepts: distinct without regard to case, in the first spelling, in reading order of the language."""
    each = chunks.select(doc, "ordinal", F.posexplode("concepts").alias("pos", "concept"))
    first = each.groupBy(doc, F.lower("concept").alias("key")).agg(F.min_by("concept", F.struct("ordinal", "pos")).alias("concept"))
    return first.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.collate("concept", "UNICODE").alias("k"), F.col("concept").alias("c")))), lambda x: x["c"]).alias("concepts"))


def concept_index(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per owner and concept key: id, name, description, chunk_ids, document_ids, week_labels.

    ``chunks`` carry ``seq``, their place in the corpus; the first spelling names a
    concept, chunk ids repeat where a chunk spells it twice, and the first three
    contexts describe it. The windowed part sees (title, heading) only.
    """
    owned = chunks.join(documents.select(F.col("id").alias("document_id"), "owner_id", "title"), "document_id")
    each = owned.select("owner_id", "seq", F.col("id").alias("chunk_id"), "document_id", "week", "title", F.try_element_at("headings", F.lit(-1)).alias("heading"), F.posexplode("concepts").alias("pos", "concept"))
    each = each.withColumn("key", normalise_concept(F.col("concept"))).filter("key <> ''")
    order = F.struct("seq", "pos")
    grouped = each.groupBy("owner_id", "key").agg(
        F.min_by("concept", order).alias("name"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.array_sort(F.collect_set("document_id")).alias("document_ids"),
        F.array_sort(F.collect_set("week.label")).alias("week_labels"),
    )
    place = F.row_number().over(Window.partitionBy("owner_id", "key").orderBy("seq", "pos"))
    context = F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("heading", F.lit("")))
    contexts = each.select("owner_id", "key", place.alias("n"), context.alias("context")).filter("n <= 3").groupBy("owner_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "context"))), lambda x: x["context"]).alias("contexts"))
    return grouped.join(contexts, ["owner_id", "key"]).select(
        short_id(F.col("owner_id"), F.col("key")).alias("id"), "owner_id", "name", concept_description(F.col("name"), F.col("contexts")).alias("description"), "chunk_ids", "document_ids", "week_labels"
    )
