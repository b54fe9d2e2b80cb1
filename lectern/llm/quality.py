"""Quality rules: Jensen-Shannon distance of character-class and common-word histograms to language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.spans import let
from lectern.llm.common import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Function words that make up each language's word histogram, with one more class for all other words.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ein"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "por"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
#: Character classes, taken out of the text one after the other; the last class is all that remains.
CHAR_CLASSES = (r"\p{Ll}+", r"\s+", r"\p{Lu}+", r"[.,;:!?'\"()-]+", r"[0-9]+", SYMBOLS)
#: Words in a document below which a histogram says too little to judge by.
MIN_WORDS_CHARS, MIN_WORDS_COMMON = 50, 100
#: Distances (square roots of divergences in bits, so between 0 and 1) above which a document fails.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.25


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the array holds twice or more.

    Windows are compared by a 64-bit hash. Where all hashes differ, which is the
    common case, nothing is sorted; else windows are sorted by hash, those equal to
    a neighbour are put in order, and each covers 3 words less what the next covers too.
    """

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, j: (F.get(s, j)["h"] == e["h"]) & (j >= 0)
            twice = F.filter(s, lambda e, j: F.coalesce(same(e, F.greatest(j - 1, F.lit(-1))), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda e: e["i"]))

        def total(a: Column) -> Column:
            return F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(placed, starts), total))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered))


def _char_counts(text: Column) -> Column:
    """array<int>: characters of each class and of none."""

    def step(rest: Column, classes: tuple[str, ...], counts: list[Column]) -> Column:
        if not classes:
            return F.array(*counts, F.length(rest))
        return let(F.regexp_replace(rest, classes[0], ""), lambda left: step(left, classes[1:], [*counts, F.length(rest) - F.length(left)]))

    return step(text, CHAR_CLASSES, [])


def _common_counts(text: Column, lang: Column, n_words: Column) -> Column:
    """array<int>: occurrences of each common word of the language and of all other words; null for other languages."""
    low = F.lower(text)
    out = F.lit(None).cast("array<int>")
    for code, words in COMMON_WORDS.items():
        found = F.regexp_extract_all(low, F.lit(rf"(?<![^\x20\x09-\x0D])(?:{'|'.join(words)})(?![^\x20\x09-\x0D])"), F.lit(0))

        def counts(f: Column, words: tuple[str, ...] = words) -> Column:
            each = F.transform(F.array(*map(F.lit, words)), lambda c: F.size(F.filter(f, lambda x: x == c)))
            return F.concat(each, F.array(n_words - F.size(f)))

        out = F.when(lang == code, let(found, lambda f: counts(f))).otherwise(out)
    return out


def text_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without its text, with ``_q``: struct of all counts of a document. One scan, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        return let(
            F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            lambda w: F.struct(
                F.size(w).alias("n_words"),
                F.length(F.array_join(w, "")).alias("word_chars"),
                (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
                _char_counts(t).alias("chars"),
                _common_counts(t, F.col(lang_col), F.size(w)).alias("common"),
            ),
        )

    return docs.withColumn("_q", let(text, counts)).drop(text_col)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
    return let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null if either is null."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    each = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.when(p.isNotNull() & q.isNotNull(), F.round(F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))), 6))


def quality_rules(docs: DataFrame, good: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, the counts, both distances, ``base_failed`` and ``kept``.

    A language's reference is the mean of the shares of its documents among ``good`` (a
    table of ids, by default all documents) that have
    ``MIN_WORDS_CHARS`` words; documents of a language without word list or reference, or of
    none, are held against the mean of all such documents, by characters alone. Without any good document nothing is judged by distance. Documents under
    the minimum lengths are not judged by distance (it is null) and pass the
    method. Null text counts as empty; repeated rows are judged each, and count each in references; an empty
    table gives an empty result; further columns of ``docs`` are ignored.

    The counts are written once, without texts; of them those of good documents are found by their ids. The references are five rows at
    most, one for each word list and one for all other languages, and broadcast.
    """
    known = F.col("_lang").isin(*COMMON_WORDS)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.col(text_col).alias("_text"))
    counted = text_counts(rows, "_text", "_lang").select("_id", F.when(known, F.col("_lang")).otherwise(F.lit("")).alias("_lang"), "_q.*")
    counted = checkpoint(counted.withColumns({"_p": _shares(F.col("chars")), "_w": _shares(F.col("common"))}).drop("chars", "common"))

    n_chars, n_common = len(CHAR_CLASSES) + 1, len(COMMON_WORDS["en"]) + 1
    mean = lambda c, n: F.array(*(F.avg(F.get(c, F.lit(i))) for i in range(n)))
    long = counted.filter(F.col("n_words") >= MIN_WORDS_CHARS).select("_id", "_lang", "_p", "_w")
    long = long if good is None else long.join(good.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    by_lang = checkpoint(long.groupBy("_lang").agg(mean("_p", n_chars).alias("_rp"), mean("_w", n_common).alias("_rw"), F.count(F.lit(1)).alias("_n")))
    of_lang = by_lang.filter("_lang <> ''").drop("_n")
    of_all = by_lang.agg(F.array(*(F.sum(F.get("_rp", F.lit(i)) * F.col("_n")) / F.sum("_n") for i in range(n_chars))).alias("_all"))
    judged = counted.join(F.broadcast(of_lang), "_lang", "left").crossJoin(F.broadcast(of_all)).select(
        F.col("_id").alias(id_col),
        *(F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.when(F.col("n_words") >= MIN_WORDS_CHARS, _distance(F.col("_p"), F.coalesce(F.col("_rp"), F.when(F.get("_all", F.lit(0)).isNotNull(), F.col("_all"))))).alias("char_distance"),
        F.when(F.col("n_words") >= MIN_WORDS_COMMON, _distance(F.col("_w"), F.col("_rw"))).alias("word_distance"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return judged.withColumns({"base_failed": failed, "kept": ~failed & passed})
