"""Hybrid retrieval for a set of queries: filters, three channels, fusion, diversity, top k."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import lexical_text
from lectern.functions.units import describe_filter, query_intent
from lectern.functions.vectors import dot, embed_rows
from lectern.operators.bm25 import bm25_scores, hit_scores, lengths, query_terms, term_counts
from lectern.operators.tables import checkpoint, is_few, small

#: Entries of a first list for each result wanted, how much longer the next ones are, and up to which length what was seen is broadcast.
DEPTH, GROWTH, FEW_ROWS = 32, 16, 1024
QUERY_SCHEMA = "query_id bigint, text string, weeks array<string>, week_numbers array<int>, document_ids array<string>, concepts array<string>, kinds array<string>"


@dataclass
class Filters:
    """What a query is limited to; an empty list is no limit. Week numbers count only where no labels are given."""

    weeks: list[str] = field(default_factory=list)
    week_numbers: list[int] = field(default_factory=list)
    document_ids: list[str] = field(default_factory=list)
    concepts: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)


def query_table(spark: SparkSession, queries: list[tuple[int, str, Filters]]) -> DataFrame:
    rows = [(i, t, f.weeks, f.week_numbers, f.document_ids, f.concepts, f.kinds) for i, t, f in queries]
    return spark.createDataFrame(rows, QUERY_SCHEMA)


def clamp_k(k: int | None) -> int:
    return max(1, min(fixed.MAX_K, fixed.TOP_K if k is None else k))


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Queries with all filter columns, ``cleaned`` text, and the units their text names where they pin none themselves."""
    kinds = {"weeks": "string", "week_numbers": "int", "document_ids": "string", "concepts": "string", "kinds": "string"}
    full = queries.withColumns({c: F.coalesce(F.col(c) if c in queries.columns else F.lit(None).cast(f"array<{t}>"), F.array().cast(f"array<{t}>")) for c, t in kinds.items()})
    full = full.withColumn("_intent", query_intent(F.col("text"))).withColumn("cleaned", F.col("_intent.cleaned"))
    pinned = (F.size("weeks") > 0) | (F.size("week_numbers") > 0)
    return full.withColumn("week_numbers", F.when(pinned, F.col("week_numbers")).otherwise(F.col("_intent.week_numbers"))).drop("_intent")


#: A bit for each kind of filter.
_WEEK, _DOCUMENT, _CONCEPT, _KIND = 1, 2, 4, 8
#: Queries without filters meet all chunks: parts that the chunks are dealt to, each of which gets the queries.
PARTS = 64
#: Chunks of one set of concepts in a list, and queries in a block of its scores, about; and tasks for each core that the lists are dealt to.
PACK, TASKS = 1024, 3


def _values(bit: int, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(bit).alias("field"), x.alias("value")))


def filter_mask() -> Column:
    """The kinds of filters that a query has."""
    has = lambda bit, *c: F.when(sum((F.size(x) for x in c[1:]), F.size(c[0])) > 0, bit).otherwise(0)
    return has(_WEEK, "weeks", "week_numbers") + has(_DOCUMENT, "document_ids") + has(_CONCEPT, "concepts") + has(_KIND, "kinds")


def matches(slim: DataFrame, asked: DataFrame, few: bool = True) -> DataFrame:
    """query_id, seq: the chunks that pass all filters of each query that has some.

    A counting match: a query's values and a chunk's attributes are rows that meet by hash, and a chunk passes where each kind of filter that the query has
    was met. Labels count before week numbers; a chunk without the attribute doesn't pass.
    """
    week = F.when(F.size("weeks") > 0, F.transform("weeks", lambda x: F.concat(F.lit("L"), x))).otherwise(F.transform("week_numbers", lambda x: F.concat(F.lit("N"), x.cast("string"))))
    allowed = F.concat(_values(_WEEK, week), _values(_DOCUMENT, F.col("document_ids")), _values(_CONCEPT, F.transform("concepts", lambda x: F.lower(x))), _values(_KIND, F.col("kinds")))
    wanted = asked.select("query_id", filter_mask().alias("_mask"), F.explode(F.array_distinct(allowed)).alias("_f")).select("query_id", "_mask", "_f.*")
    carried = F.concat(
        _values(_WEEK, F.array(F.concat(F.lit("L"), F.col("week.label")), F.concat(F.lit("N"), F.col("week.number").cast("string")))),
        _values(_DOCUMENT, F.array("document_id")), _values(_CONCEPT, F.transform("concepts", lambda x: F.lower(x))), _values(_KIND, F.array("kind")),
    )
    attributes = slim.select("seq", F.explode(carried).alias("_f")).select("seq", "_f.*")
    met = attributes.join(F.broadcast(wanted) if few else wanted, ["field", "value"])
    return met.groupBy("query_id", "seq", "_mask").agg(F.bit_or("field").alias("_met")).filter("_met = _mask").select("query_id", "seq")


def slim_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's kind; those without a document drop out."""
    kinds = small(documents.select(F.col("id").alias("document_id"), "kind"))
    return chunks.select("seq", "document_id", "week", "concepts", "len", "embedding").join(kinds, "document_id")


def pairs(slim: DataFrame, asked: DataFrame, filtered: DataFrame | None, few: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """Each query's candidates: query_id, qv and ``columns`` of the query; seq, document_id, len, concepts, embedding of the chunk.

    ``filtered``: what ``matches`` gave, None where no query has a filter. Queries without filters meet all chunks, a stated set of queries against all rows: chunks are dealt to
    parts, and each part gets the queries, by hash. Nothing is written out here; readers aggregate, or keep the best, within the scan.
    """
    own = asked.select("query_id", "qv", filter_mask().alias("_mask"), *columns)
    chunk = slim.select("seq", "document_id", "len", F.col("concepts").alias("carried"), "embedding")
    dealt = chunk.withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(PARTS)).cast("int"))
    every = own.filter("_mask = 0").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    found = dealt.join(F.broadcast(every) if few else every, "_part").drop("_part", "_mask")
    if filtered is not None:
        some = own.filter("_mask > 0").drop("_mask")
        found = found.unionByName(chunk.join(filtered, "seq").join(F.broadcast(some) if few else some, "query_id"))
    return found


def _odd() -> Column:
    return F.coalesce(F.col("qv").isNotNull() & (F.size("embedding") != F.size("qv")), F.lit(False))


def _dense() -> Column:
    return F.when(F.col("qv").isNotNull() & ~_odd(), dot(F.col("embedding"), F.col("qv")))


def _has_filters(asked: DataFrame) -> bool:
    return not asked.filter(filter_mask() > 0).isEmpty()


def candidates(chunks: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, seq, document_id, len, dense, odd: the chunks that each query's filters leave. Chunks without a document drop out.

    ``dense`` is the dot product with the query's vector, computed where the two meet; ``odd`` says that their widths differ. Queries without a vector have no dense score.
    """
    slim, few = slim_chunks(chunks, documents), is_few(queries)
    filtered = matches(slim, queries, few) if _has_filters(queries) else None
    return pairs(slim, queries, filtered, few).select("query_id", "seq", "document_id", "len", _dense().alias("dense"), _odd().alias("odd"))


def scale(scores: DataFrame, columns: list[str], key: str = "query_id", few: bool = True, ends: DataFrame | None = None) -> DataFrame:
    """``scores`` with the columns scaled to 0..1 over a query's candidates; where all are equal, 1 if they are positive, else 0.

    Two sums a query, joined back: no task holds all of a query's candidates. ``few`` queries may be broadcast.
    ``ends`` has the sums (``_min_`` and ``_max_`` of each column) where these are known.
    """
    if ends is None:
        ends = scores.groupBy(key).agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)))
    joined = scores.join(F.broadcast(ends) if few else ends, key)
    low, high = (lambda c: F.col(f"_min_{c}")), (lambda c: F.col(f"_max_{c}"))
    one = lambda c: F.when(high(c) - low(c) < 1e-9, F.when(high(c) > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - low(c)) / (high(c) - low(c)))
    return joined.withColumns({c: one(c) for c in columns}).select(scores.columns)


def _concept_pairs(concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, name, score: each concept scored once for a query."""
    return concepts.select("name", F.col("embedding").alias("ce")).crossJoin(vectors).filter(F.size("ce") == F.size("qv")).select("query_id", "name", dot(F.col("ce"), F.col("qv")).alias("score"))


def name_scores(concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, concept_key, score: the score of each name, without regard to case."""
    return _concept_pairs(concepts, vectors).groupBy("query_id", F.lower("name").alias("concept_key")).agg(F.min("score").alias("score"))


def carried_scores(chunks: DataFrame, by_name: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, seq, concept: the best score among a chunk's concepts, floor 0. ``queries``: those of ``by_name``, where they are cheaper to count.

    Chunks with the same concepts share their scores: each set of names is scored once for a query. Both sides are packed, chunks of a set as lists of some ``PACK`` and
    its scores as blocks of as many queries, and unpacked where they meet, next to the output: on disk there is a row for each chunk, none for each query and chunk. Rows with the same query
    and score stand together. Blocks that aren't few meet by a shuffle; where there are few sets, each has many chunks, whose parts get the set's blocks each.
    """
    cores = TASKS * chunks.sparkSession.sparkContext.defaultParallelism
    keyed = chunks.select("seq", F.array_sort(F.array_distinct(F.transform("concepts", lambda c: F.lower(c)))).alias("_set"))
    sets = keyed.select("_set").distinct()
    packs, blocks = -(-keyed.count() // PACK) or 1, -(-(by_name if queries is None else queries).select("query_id").distinct().count() // PACK) or 1
    best = sets.select("_set", F.explode("_set").alias("concept_key")).join(by_name, "concept_key").groupBy("query_id", "_set").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("concept"))
    scored = best.groupBy("_set", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("query_id", "concept")).alias("_scores")).drop("_block")
    # a stated number of partitions: packed rows are small, and would be read by few tasks
    dealt = keyed.withColumn("_pack", F.pmod(F.xxhash64("seq"), F.lit(packs))).repartition(cores, "_set", "_pack")
    packed = dealt.groupBy("_set", "_pack").agg(F.collect_list(F.struct("seq")).alias("_chunks"))
    few = is_few(sets, FEW_ROWS)
    if few and is_few(sets, FEW_ROWS // blocks):
        met = packed.join(F.broadcast(scored), "_set")
    else:
        parts = PARTS if few else 1
        met = packed.withColumn("_part", F.pmod("_pack", F.lit(parts)).cast("int")).join(scored.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["_set", "_part"])
    return met.select("_chunks", F.explode("_scores").alias("_s")).select("_s", F.explode("_chunks").alias("_c")).select("_s.query_id", "_c.seq", "_s.concept")


def matched_names(concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, matched_concepts: the best names over the threshold."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name"))
    matched = _concept_pairs(concepts, vectors).filter(F.col("score") > fixed.CONCEPT_THRESHOLD).withColumn("r", rank).filter(F.col("r") <= fixed.MATCHED_CONCEPTS)
    return matched.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("matched_concepts"))


def concept_scores(chunks: DataFrame, concepts: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, seq, concept): the best score among a chunk's concepts, floor 0; and (query_id, matched_concepts)."""
    return carried_scores(chunks, name_scores(concepts, vectors), vectors), matched_names(concepts, vectors)


def fuse(scores: DataFrame, weights: dict[str, float], few: bool = True) -> DataFrame:
    """``scores`` (query_id, dense, lexical, concept) with the weighted sum of the scaled channels; raw scores stay beside it."""
    scaled = scale(scores.withColumns({f"_{c}": F.col(c) for c in weights}), [f"_{c}" for c in weights], few=few)
    first, *others = (F.lit(weights[c]) * F.col(f"_{c}") for c in ("dense", "lexical", "concept"))
    return scaled.withColumn("score", sum(others, first)).select(*scores.columns, "score")


def diversify(scores: DataFrame, k: int, decay: float = fixed.DIVERSITY) -> DataFrame:
    """Each further hit of a document counts less; then the best k of each query. Ties go by place in the corpus.

    Scores aren't negative, so a hit that k of its own document go before is not among the best k: both ranks are
    limits, which cut each task's rows before they meet.
    """
    order = [F.col("score").desc(), F.col("seq")]
    nth = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(*order))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_less").desc(), F.col("_before"), F.col("seq")))
    ranked = scores.withColumn("_nth", nth).filter(F.col("_nth") <= k).withColumn("_before", -F.col("score")).withColumn("_less", F.col("score") / (1 + F.lit(decay) * (F.col("_nth") - 1)))
    return ranked.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("score", F.col("_less")).drop("_nth", "_before", "_less")


def _scaled(x: Column, channel: str) -> Column:
    """A score on the scale of its channel's ends ``_low_`` and ``_high_``, as ``scale`` has it."""
    low, high = F.col(f"_low_{channel}"), F.col(f"_high_{channel}")
    return F.when(high - low < 1e-9, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((x - low) / (high - low))


def _own_concept() -> Column:
    """The best score of a chunk's concepts, by the query's map ``_scores``; 0 at least."""
    known = F.filter(F.transform("carried", lambda c: F.try_element_at("_scores", F.lower(c))), lambda x: x.isNotNull())
    return F.greatest(F.coalesce(F.array_max(known), F.lit(0.0)), F.lit(0.0))


def lexical_scores(slim: DataFrame, filtered: DataFrame | None, asked: DataFrame, stats: DataFrame, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, seq, lexical: BM25 of the candidates that hold a query term, from the terms' rows alone; candidates without one have no row."""
    hits = counts.filter("term is not null").join(terms, "term")
    free = F.broadcast(asked.filter(filter_mask() == 0).select("query_id"))
    own = hits.join(free, "query_id", "left_semi").join(slim.select("seq", "len"), "seq").select("query_id", "seq", "term", "tf", "len")
    if filtered is not None:
        own = own.unionByName(hits.join(filtered, ["query_id", "seq"], "left_semi").join(slim.select("seq", "len"), "seq").select("query_id", "seq", "term", "tf", "len"))
    return hit_scores(own, F.broadcast(stats))


def threshold_topk(slim: DataFrame, filtered: DataFrame | None, asked: DataFrame, lexical: DataFrame, weights: dict[str, float], k: int, depth: int = DEPTH) -> DataFrame:
    """The rows of ``diversify`` for each query, without a row for each of its candidates.

    ``asked``: query_id, qv, _scores, filters, and the ends of each channel over the query's candidates. A round reads two sorted lists of a query: the candidates best by dense and concept
    score together, a limit that cuts each task's rows within the scan, and those best by lexical score. What is in neither
    scores at most the sum of both lists' last entries. Once the k-th result counts more than that, nothing unseen can come before it or change its place
    among its document's hits; queries that aren't there yet go on with lists of ``GROWTH`` times the length, until they hold all.
    """
    part = lambda: F.lit(weights["dense"]) * _scaled(F.coalesce(_dense(), F.lit(0.0)), "dense") + F.lit(weights["concept"]) * _scaled(_own_concept(), "concept")
    place = F.row_number().over(Window.partitionBy("query_id", "by_word").orderBy(F.col("value").desc(), "seq"))
    ends = [f"_{e}_{c}" for c in weights for e in ("low", "high")]
    done, open_, length = [], asked, max(1, depth * k)
    while True:
        parts = pairs(slim, open_, filtered, True, ("_scores", *ends)).select("query_id", "seq", F.lit(False).alias("by_word"), part().alias("value"))
        words = lexical.join(F.broadcast(open_.select("query_id", *ends)), "query_id").select("query_id", "seq", F.lit(True).alias("by_word"), _scaled(F.col("lexical"), "lexical").alias("value"))
        lists = checkpoint(parts.unionByName(words).withColumn("_r", place).filter(F.col("_r") <= length).drop("_r"))

        seen = lists.groupBy("query_id", "seq").agg(F.bool_or("by_word").alias("_worded"))
        seen = F.broadcast(seen) if length <= FEW_ROWS else seen
        rows = slim.select("seq", "document_id", F.col("concepts").alias("carried"), "embedding").join(seen, "seq").join(F.broadcast(open_), "query_id")
        scores = lexical.join(seen, ["query_id", "seq"]).select("query_id", "seq", "lexical")
        rows = rows.join(F.broadcast(scores) if length <= FEW_ROWS else scores, ["query_id", "seq"], "left")
        raw = {"dense": F.coalesce(_dense(), F.lit(0.0)), "lexical": F.coalesce("lexical", F.lit(0.0)), "concept": _own_concept()}
        first, *others = (F.lit(weights[c]) * _scaled(F.col(c), c) for c in ("dense", "lexical", "concept"))
        scored = rows.withColumns(raw).withColumn("score", sum(others, first)).select("query_id", "seq", "document_id", "dense", "lexical", "concept", "score")
        top = checkpoint(diversify(scored, k))

        last = lists.groupBy("query_id").agg(*(f(F.when(c, x)).alias(n) for c, w in ((~F.col("by_word"), "part"), (F.col("by_word"), "word")) for f, x, n in ((F.count, F.lit(1), f"_n_{w}"), (F.min, F.col("value"), f"_last_{w}"))))
        kth = top.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
        state = last.join(F.broadcast(open_.select("query_id", *ends)), "query_id").join(F.broadcast(kth), "query_id", "left")
        unseen = F.col("_last_part") + F.lit(weights["lexical"]) * F.when(F.col("_n_word") >= length, F.col("_last_word")).otherwise(_scaled(F.lit(0.0), "lexical"))
        going = state.filter((F.col("_n_part") >= length) & ~F.coalesce(F.col("_kth") > unseen + 1e-9, F.lit(False))).select("query_id")
        left = [r["query_id"] for r in going.collect()]  # the queries are few
        if not left:
            done.append(top)
            break
        done.append(top.filter(~F.col("query_id").isin(left)))
        open_, length = open_.filter(F.col("query_id").isin(left)), length * GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def scan_topk(found: DataFrame, stale: DataFrame, lexical: DataFrame, concept: DataFrame, weights: dict[str, float], k: int, few: bool) -> DataFrame:
    """The same from a row for each query and candidate: the plain way, for sets of queries that can't be broadcast."""
    joined = found.select("query_id", "seq", "document_id", "dense").join(stale, "query_id").withColumn("dense", F.when(~F.col("stale_index"), F.col("dense"))).drop("stale_index")
    joined = joined.join(lexical, ["query_id", "seq"], "left").join(concept, ["query_id", "seq"], "left")
    scores = checkpoint(joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("dense", "lexical", "concept")}))
    return diversify(fuse(scores, weights, few), k)


def retrieve(chunks: DataFrame, documents: DataFrame, concepts: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, vectors: DataFrame | None = None, semantic: bool = False, plain: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, meta) for all queries at once.

    ``chunks``: seq, id, document_id, text, headings, concepts, week, embedding;
    ``vectors``: (query_id, qv) of the queries, by default the hashed embedding of
    their cleaned text. All statistics of a channel are those of the query's own
    candidates. If any candidate has a vector of another width, the index is stale
    and dense and concept scores are 0 for all. ``meta`` has a row for each query,
    also for those without candidates: applied_weeks, matched_concepts, stale_index.

    The ends of the channels are sums over the candidates, taken within the scan; then ``threshold_topk`` reads as much of the sorted lists as the result needs. Sets of
    more queries, or queries times concepts, than may be broadcast go the plain way, as they do with ``plain``.
    """
    asked = checkpoint(prepare_queries(queries))
    few = is_few(asked)
    if vectors is None:
        vectors = embed_rows(asked.select("query_id", "cleaned"), "query_id", F.col("cleaned"), "qv").select("query_id", "qv")
    vectors = checkpoint(vectors)
    texts = asked.select("query_id", F.col("cleaned").alias("text"))
    # texts are tokenised once; what is left are a few counts each
    terms = query_terms(texts)
    counts = checkpoint(term_counts(chunks, "seq", lexical_text(F.col("headings"), F.col("concepts"), F.col("text")), terms))
    sized = chunks.join(lengths(counts), "seq")
    # what the channels need of a chunk is stored once for all queries: as many rows as chunks
    slim = checkpoint(slim_chunks(sized, documents))
    weights = fixed.SEMANTIC_WEIGHTS if semantic else fixed.LOCAL_WEIGHTS
    known = asked.join(vectors, "query_id", "left")
    by_name = checkpoint(name_scores(concepts, vectors))
    filtered = checkpoint(matches(slim, asked, few)) if _has_filters(asked) else None

    if not plain and few and is_few(by_name):
        maps = by_name.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("concept_key", "score"))).alias("_scores"))
        known = checkpoint(known.join(maps, "query_id", "left"))
        found = pairs(slim, known, filtered, few, ("_scores",)).select("query_id", "len", _odd().alias("odd"), F.coalesce(_dense(), F.lit(0.0)).alias("dense"), _own_concept().alias("concept"))
        ends = (F.min("dense"), F.max("dense"), F.min("concept"), F.max("concept"))
        names = ("_low_dense", "_high_dense", "_low_concept", "_high_concept")
        stats = checkpoint(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), F.bool_or("odd").alias("stale_index"), *(e.alias(x) for e, x in zip(ends, names, strict=True))))
        stale = stats.select("query_id", "stale_index")
        lexical = checkpoint(lexical_scores(slim, filtered, known, stats.select("query_id", "n", "avg"), counts, terms))
        worded = lexical.groupBy("query_id").agg(F.count(F.lit(1)).alias("_m"), F.min("lexical").alias("_least"), F.max("lexical").alias("_high_lexical"))
        # a stale index has no dense and concept scores; candidates without a term have no lexical one
        whole = known.join(stats, "query_id").join(worded, "query_id", "left").withColumns({x: F.when(F.col("stale_index"), 0.0).otherwise(F.col(x)) for x in names})
        whole = whole.withColumns({"_low_lexical": F.when(F.col("_m") == F.col("n"), F.col("_least")).otherwise(0.0), "_high_lexical": F.coalesce("_high_lexical", F.lit(0.0))})
        whole = whole.withColumns({"qv": F.when(~F.col("stale_index"), F.col("qv")), "_scores": F.when(~F.col("stale_index"), F.col("_scores"))})
        top = threshold_topk(slim, filtered, checkpoint(whole.drop("n", "avg", "stale_index", "_m", "_least")), lexical, weights, k)
    else:
        found = checkpoint(pairs(slim, known, filtered, few).select("query_id", "seq", "document_id", "len", _dense().alias("dense"), _odd().alias("odd")))
        lexical = bm25_scores(found, counts, texts)
        stale = checkpoint(found.groupBy("query_id").agg(F.bool_or("odd").alias("stale_index")))
        concept = carried_scores(chunks, by_name.join(stale.filter("not stale_index"), "query_id", "left_semi"))
        top = scan_topk(found, stale, lexical, concept, weights, k, few)
    top = F.broadcast(top) if few else top
    shown = documents.select(F.col("id").alias("document_id"), F.struct("id", "title", "kind", "origin").alias("document"))
    results = chunks.drop("embedding", "document_id").join(top, "seq").join(shown, "document_id")
    results = results.select("query_id", "rank", "seq", "id", "document_id", "ordinal", "text", "headings", "week", "concepts", "document", "score", F.struct("dense", "lexical", "concept").alias("breakdown"))

    return results, _described(asked, vectors, concepts, stale)


def _described(asked: DataFrame, vectors: DataFrame, concepts: DataFrame, stale: DataFrame) -> DataFrame:
    """A row for each query: query_id, cleaned, applied_weeks, stale_index, matched_concepts. ``stale``: (query_id, stale_index) of those with candidates."""
    matched = matched_names(concepts, vectors.join(stale.filter("not stale_index"), "query_id", "left_semi"))
    meta = asked.select("query_id", "cleaned", describe_filter(F.col("weeks"), F.col("week_numbers")).alias("applied_weeks")).join(stale, "query_id", "left").join(matched, "query_id", "left")
    return meta.withColumns({"stale_index": F.coalesce("stale_index", F.lit(False)), "matched_concepts": F.coalesce("matched_concepts", F.array().cast("array<string>"))})


def describe(chunks: DataFrame, documents: DataFrame, concepts: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The ``meta`` of ``retrieve``, for whoever wants no results: it depends on every candidate's width of vector, but on no text and no score.

    Chunks of equal attributes and width are alike to all filters: they are grouped within the scan, and the groups meet the queries.
    """
    asked, vectors = checkpoint(prepare_queries(queries)), checkpoint(vectors)
    few = is_few(asked)
    # a chunk counts by its place, as in retrieve, where its terms are found by it
    known = chunks.filter("seq is not null").withColumn("len", F.lit(0))
    alike = ["document_id", "week", "concepts", "kind", "_width"]
    groups = slim_chunks(known, documents).withColumn("_width", F.size("embedding")).groupBy(*alike).agg(F.min("seq").alias("seq"))
    groups = checkpoint(groups.withColumns({"len": F.lit(0), "embedding": F.col("_width")}))
    filtered = checkpoint(matches(groups, asked, few)) if _has_filters(asked) else None
    width = asked.join(vectors.select("query_id", F.size("qv").alias("_asked")), "query_id", "left").withColumn("qv", F.col("_asked"))
    found = pairs(groups, width, filtered, few)
    odd = F.coalesce(F.col("qv") != F.col("embedding"), F.lit(False))
    return _described(asked, vectors, concepts, checkpoint(found.groupBy("query_id").agg(F.bool_or(odd).alias("stale_index"))))
