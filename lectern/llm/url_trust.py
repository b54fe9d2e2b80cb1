"""URL filters: rules by host and path, and trust and distrust propagated over host edges for all other pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, checkpoint

#: (host, path, verdict): the fixed rules of the query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING, ITERATIONS = 0.85, 10
#: Verdicts go on from there until a step moves no more than this share of either kind's mass and reaches no further host.
TOLERANCE = 1e-6
#: A host is blocked if more than this share of its score is distrust.
BLOCK_SHARE = 0.5
LINK = r"(?i)\bhref\s{0,8}=\s{0,8}[\"']?((?:[a-z][a-z0-9+.-]{0,30}:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)), F.lit(""))


def apply_rules(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def link_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """src, dst, w: links between different hosts, counted."""
    target = F.col("_link")
    absolute = F.when(target.startswith("//"), F.concat(F.lit("http:"), target)).otherwise(target)
    links = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("_link"))
    return links.select("src", host_of(absolute).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def parent_edges(hosts: DataFrame, weight: float) -> DataFrame:
    """src, dst, w: from each host to its parent domain and back, up to the last label."""
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.transform(F.slice(chain, 1, F.size(chain) - 1), lambda h, i: F.struct(h.alias("a"), chain[i + 1].alias("b")))
    pairs = hosts.select(F.explode(steps).alias("e")).select("e.*").filter("a <> '' and b <> ''").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(both.alias("e")).select("e.*", F.lit(float(weight)).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float | None = None) -> DataFrame:
    """kind, host, score: personalised PageRank of each kind from its own seeds.

    ``score`` is that after ``iterations`` steps. With ``tolerance`` a column
    ``settled`` is added, the score after as many more steps as it takes until one
    changes the scores of either kind by no more than that in all and reaches no host
    for the first time; hosts that only those steps reach have a score of 0.

    ``edges``: src, dst, w; ``seeds``: kind (``trust`` or ``distrust``), host, mass.
    Trust follows edges from the trusted seeds; distrust follows them backwards
    from the blocked ones, to whoever links there. Both kinds share one join and
    one sum an iteration; sums are pre-aggregated before they are shuffled, and
    what a host without edges holds is lost. Edges are normalised once; the
    lineage is cut every few iterations.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    merged = ways.groupBy("kind", "src", "dst").agg(F.sum("w").alias("w"))
    total = merged.groupBy("kind", "src").agg(F.sum("w").alias("t"))
    normal = checkpoint(merged.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("t")).alias("w")))
    mass = seeds.groupBy("kind").agg(F.sum("mass").alias("t"))
    start = checkpoint(seeds.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).join(F.broadcast(mass), "kind").filter("t > 0").select("kind", "host", (F.col("mass") / F.col("t")).alias("score")))

    def step(score: DataFrame) -> DataFrame:
        moved = normal.join(score.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("w") * F.col("score") * damping).alias("score"))
        back = start.withColumn("score", F.col("score") * (1 - damping))
        return moved.unionByName(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))

    score = start
    for i in range(iterations):
        score = step(score)
        if i % 3 == 2 or i == iterations - 1:
            score = checkpoint(score)
    if tolerance is None:
        return score
    settled = score
    while True:
        # the change over the last of a few steps, and hosts that it reached; what a step changes shrinks by the damping at least
        before = step(step(settled))
        last = checkpoint(step(before).join(before.withColumnRenamed("score", "_was"), ["kind", "host"], "left"))
        change = last.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.coalesce("_was", F.lit(0.0)))).alias("d"), F.count(F.when(F.col("_was").isNull() & (F.col("score") > 0), 1)).alias("n")).collect()
        settled = last.drop("_was")
        if all(r["d"] <= tolerance and not r["n"] for r in change):
            break
    both = settled.withColumnRenamed("score", "settled").join(score, ["kind", "host"], "left")
    return both.select("kind", "host", F.coalesce("score", F.lit(0.0)).alias("score"), "settled")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, parent_weight: float = 0.0) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    A page that a rule fits gets the rule's verdict. The pages so allowed and
    blocked are the seeds: a host's seed mass is its number of pages under each
    verdict. Edges are links between hosts, weighted by their number; with a ``parent_weight`` also the steps between a host and its
    parent domain, at that weight. Every other page gets its host's verdict: block if distrust is
    over ``BLOCK_SHARE`` of the host's settled score, unrounded, else allow, which includes hosts
    that nothing reaches or whose trust equals their distrust, and pages without a host. Null urls have empty host and
    path; null or empty html has no links; repeated rows are judged each; an empty
    table gives an empty result; further columns of ``pages`` are ignored.

    ``trust`` and ``distrust`` are the scores after ``ITERATIONS`` steps, to 9 decimals.

    Only hosts and host pairs are shuffled, after pre-aggregation; the join of the
    verdicts to the pages carries no html, and a hot host's pages can be split.
    """
    named = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("_html"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    judged = named.drop("_html").withColumns({"rule": rule, "_ruled": verdict})

    links = checkpoint(link_edges(named, "host", "_html"))
    of_hosts = checkpoint(judged.groupBy("host", "_ruled").agg(F.count(F.lit(1)).cast("double").alias("mass")))
    kind = F.when(F.col("_ruled") == "allow", "trust").when(F.col("_ruled") == "block", "distrust")
    seeds = of_hosts.filter("_ruled is not null and host <> ''").select(kind.alias("kind"), "host", "mass")
    edges = links
    if parent_weight:
        hosts = of_hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).filter("host <> ''").distinct()
        edges = links.unionByName(parent_edges(hosts, parent_weight))
    scores = propagate(edges, seeds, tolerance=TOLERANCE)

    of_kind = lambda k: F.coalesce(F.round(F.sum(F.when(F.col("kind") == k, F.col("score"))), 9), F.lit(0.0)).alias(k)
    settled = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("settled"))), F.lit(0.0))
    bad = (settled("distrust") > BLOCK_SHARE * (settled("trust") + settled("distrust"))).alias("_bad")
    by_host = checkpoint(scores.groupBy("host").agg(of_kind("trust"), of_kind("distrust"), bad))
    joined = judged.join(by_host, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    own = F.when(F.col("_bad"), "block").otherwise("allow")
    return joined.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"), "trust", "distrust")
