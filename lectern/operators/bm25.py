"""BM25 over term rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.spans import let
from lectern.functions.text import tokenise
from lectern.operators.tables import small


def term_rows(chunks: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf, len: the terms of each row's text, counted within the row, without a shuffle; len counts all its tokens."""

    def counted(s: Column) -> Column:
        n = F.size(s)
        new = lambda i: (i == 0) | (s[i] != F.get(s, F.greatest(i - 1, F.lit(0))))
        each = lambda starts: F.transform(starts, lambda i, j: F.struct(s[i].alias("term"), (F.coalesce(F.get(starts, j + 1), n) - i).cast("bigint").alias("tf"), n.alias("len")))
        return F.when(n > 0, let(F.filter(F.sequence(F.lit(0), n - 1), new), each))

    return chunks.select(key, F.explode(let(F.array_sort(tokenise(text)), counted)).alias("_t")).select(key, "_t.*")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenise(F.col("text")))).alias("term"))


def term_counts(chunks: DataFrame, key: str, text: Column, wanted: DataFrame) -> DataFrame:
    """key, term, tf: how often each wanted term stands in each text and, under a null term, how many other tokens it has.

    Tokens meet the wanted terms next to the scan and are counted there before they are shuffled; every text has a row.
    """
    tokens = chunks.select(key, F.explode_outer(tokenise(text)).alias("_token"))
    marked = tokens.join(small(wanted.select("term").distinct()), F.col("_token") == F.col("term"), "left")
    return marked.groupBy(key, "term").agg(F.count("_token").alias("tf"))


def lengths(counts: DataFrame, key: str = "seq") -> DataFrame:
    """key, len: the tokens of each text, from ``term_counts``."""
    return counts.groupBy(key).agg(F.sum("tf").alias("len"))


def bm25_scores(candidates: DataFrame, counts: DataFrame, queries: DataFrame, key: str = "seq") -> DataFrame:
    """query_id, key, lexical: BM25 of each candidate that holds a query term.

    ``candidates``: (query_id, key, len), what each query's filters left;
    ``counts``: (key, term, tf), those of ``term_counts`` or ``term_rows``; ``queries``: (query_id, text). Number of texts, mean length and
    document frequency are those of the query's own candidates. Each distinct
    query term counts once. A query without candidates gives no rows.
    """
    stats = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    hits = counts.filter("term is not null").select(key, "term", "tf").join(query_terms(queries), "term").join(candidates.select("query_id", key, "len"), ["query_id", key])
    return hit_scores(hits, stats, key)


def hit_scores(hits: DataFrame, stats: DataFrame, key: str = "seq") -> DataFrame:
    """query_id, key, lexical: BM25 from ``hits`` (query_id, key, term, tf, len), the candidates' rows of query terms, and ``stats`` (query_id, n, avg) of all candidates.

    Terms are added up as decimals, whose sum doesn't depend on their order: texts that tie stay tied, so that their place decides between them.
    """
    df = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0)
    k1, b = fixed.BM25_K1, fixed.BM25_B
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    scored = hits.join(df, ["query_id", "term"]).join(stats, "query_id")
    return scored.groupBy("query_id", key).agg(F.sum((idf * gain).cast("decimal(28,18)")).cast("double").alias("lexical"))
