"""Course units: markers in a text, the scheme a document uses, and units that a query names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.spans import let, match_spans
from lectern.functions.text import collapse, trim

# boundaries that look at ASCII word characters only
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Struct of a unit tag.
TAG = "struct<number:int,label:string,confidence:string>"
CONFIDENCE = ("explicit", "inherited", "inferred")


def names_of(pattern: str) -> list[str]:
    """The words of a scheme's name pattern."""
    return pattern.removeprefix("(?:").removesuffix(")").split("|")


def marker_pattern() -> str:
    """Any unit marker. No marker holds the start of another, so one search finds what one for each scheme would."""
    names = "|".join(name for *_, name in fixed.UNIT_SCHEMES if name != "w")
    return rf"(?i){START}(?:(?:{names}){fixed.UNIT_GAP}\d{{1,2}}{END}|w\d{{1,2}}{END}(?=[\s:.\-–—]|\z))"


def find_markers(text: Column) -> Column:
    """array<struct<index,scheme,priority,number>>, by index."""
    low, high = fixed.UNIT_NUMBERS
    named = [(names_of(name), scheme, priority) for scheme, priority, name in fixed.UNIT_SCHEMES]

    def marker(s: Column) -> Column:
        def tell(word: Column) -> Column:
            scheme, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
            for words, label, priority in named:
                scheme, rank = F.when(word.isin(*words), label).otherwise(scheme), F.when(word.isin(*words), priority).otherwise(rank)
            number = F.regexp_extract(s["value"], r"(\d+)\z", 1).cast("int")
            return F.struct(s["start"].alias("index"), scheme.alias("scheme"), rank.alias("priority"), number.alias("number"))

        return let(F.lower(F.regexp_extract(s["value"], r"\A[A-Za-z]+", 0)), tell)

    found = F.filter(F.transform(match_spans(text, marker_pattern()), marker), lambda m: m["number"].between(low, high))
    return F.when(text.rlike(marker_pattern()), found).otherwise(F.array().cast("array<struct<index:int,scheme:string,priority:int,number:int>>"))


def canonical_scheme(markers: Column) -> Column:
    """The scheme with the most distinct numbers, at a tie the one of lowest priority number; null without markers."""

    def entry(scheme: str, priority: int) -> Column:
        own = F.array_distinct(F.transform(F.filter(markers, lambda m: m["scheme"] == scheme), lambda m: m["number"]))
        return F.struct(F.size(own).alias("n"), F.lit(-priority).alias("p"), F.lit(scheme).alias("scheme"))

    schemes = dict.fromkeys((s, p) for s, p, _ in fixed.UNIT_SCHEMES)
    best = F.array_max(F.array(*(entry(s, p) for s, p in schemes)))
    return F.when(best["n"] > 0, best["scheme"])


def scheme_by_document(markers: DataFrame, key: str) -> DataFrame:
    """The same from marker rows (key, scheme, priority, number): count distinct numbers, then the best scheme of each key."""
    counted = markers.groupBy(key, "scheme", "priority").agg(F.count_distinct("number").alias("n"))
    return counted.groupBy(key).agg(F.max_by("scheme", F.struct("n", -F.col("priority"))).alias("scheme"))


def tag(scheme: Column, number: Column, confidence: Column) -> Column:
    return F.struct(number.cast("int").alias("number"), F.concat(scheme, F.lit(" "), number.cast("string")).alias("label"), confidence.alias("confidence"))


def unplaced() -> Column:
    return F.struct(F.lit(None).cast("int").alias("number"), F.lit("Unplaced").alias("label"), F.lit("inferred").alias("confidence"))


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "explicit", 0).when(confidence == "inherited", 1).otherwise(2)


def query_intent(text: Column) -> Column:
    """struct<week_numbers,cleaned>: the distinct numbers of units a query names, and the query without their phrases.

    A query of which fewer than three characters would be left stays whole.
    """
    numbers = F.array_distinct(F.transform(find_markers(text), lambda m: m["number"]))
    phrase = rf"(?i){START}(?:{fixed.UNIT_NAMES}){fixed.UNIT_GAP}\d{{1,2}}{END}"
    cleaned = trim(collapse(F.regexp_replace(text, phrase, " ")))
    return F.struct(numbers.alias("week_numbers"), F.when(F.length(cleaned) < 3, text).otherwise(cleaned).alias("cleaned"))


def describe_filter(weeks: Column, numbers: Column) -> Column:
    """What a query is limited to, for its meta row: the labels where there are any, else the numbers."""
    return F.when(F.size(weeks) > 0, weeks).otherwise(F.transform(numbers, lambda n: F.concat(F.lit("unit "), n.cast("string"))))


def units_as_of(blocks: DataFrame, markers: DataFrame, key: str = "document_id", within: int = fixed.EXPLICIT_WITHIN) -> DataFrame:
    """Each block (key, offset) with its unit: the last marker (key, index, scheme, number) at or before it.

    A marker before the text, at a negative index, is the document's default. The
    unit is explicit if its marker is at most ``within`` characters back. One
    window over both tables together: no join, and a hot document's rows are only sorted.
    """
    rows = blocks.withColumns({"_at": F.col("offset"), "_kind": F.lit(1), "_m": F.lit(None).cast("struct<at:int,scheme:string,number:int>")})
    given = markers.select(
        key, F.when(F.col("index") < 0, -1).otherwise(F.col("index")).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("index").cast("int").alias("at"), "scheme", F.col("number").cast("int").alias("number")).alias("_m")
    )
    # of the markers before the text the first one counts
    first = Window.partitionBy(key).orderBy("_m.at")
    given = given.withColumn("_n", F.row_number().over(first)).filter("_at >= 0 or _n = 1").drop("_n")
    order = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(given, allowMissingColumns=True).withColumn("_last", F.last("_m", ignorenulls=True).over(order)).filter("_kind = 1")
    close = (F.col("_last.at") >= 0) & (F.col("_last.at") >= F.col("offset") - within)
    unit = F.when(F.col("_last").isNull(), unplaced()).otherwise(tag(F.col("_last.scheme"), F.col("_last.number"), F.when(close, "explicit").otherwise("inherited")))
    return both.withColumn("week", unit).drop("_at", "_kind", "_m", "_last")


def unit_order(label: str = "label", number: str = "number") -> list[Column]:
    """Schemes together, each by number; what has no unit last."""
    return [F.col(number).isNull(), F.collate(F.split(label, " ")[0], "UNICODE"), F.col(number).asc_nulls_last(), F.collate(F.col(label), "UNICODE")]
