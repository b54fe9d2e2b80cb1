"""Search by sorted lists and filters by counting, against the plain ways."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieve as R

WORDS = [f"term{i}" for i in range(40)]
CHUNKS = "seq bigint, id string, document_id string, ordinal int, text string, headings array<string>, week struct<number:int,label:string,confidence:string>, concepts array<string>, embedding array<double>"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = []
    for i in range(300):
        week = (i % 7, f"Week {i % 7}", "explicit") if i % 5 else (None, None, "none")
        rows.append((i, f"c{i}", f"d{rng.randint(0, 25)}", 0, " ".join(rng.choices(WORDS, k=rng.randint(0, 30))), ["Top"], week, rng.sample(["Heap", "Tree", "Graph"], rng.randint(0, 2)), [0.0] * 6 if i % 9 == 0 else vector()))
    chunks = spark.createDataFrame(rows, CHUNKS)
    # documents 24 and 25 are gone
    documents = spark.createDataFrame([(f"d{i}", f"Doc {i}", ["upload", "notion", None][i % 3], None) for i in range(24)], "id string, title string, kind string, origin string")
    concepts = spark.createDataFrame([(n, vector()) for n in ("heap", "tree", "graph")], "name string, embedding array<double>")
    f = R.Filters
    asked = [(f(), 4), (f(weeks=["Week 2"], week_numbers=[5]), 3), (f(week_numbers=[1, 5]), 2), (f(document_ids=["d1", "d2", "d25"]), 5), (f(concepts=["HEAP", "tree"]), 1), (f(kinds=["upload"], concepts=["graph"]), 2), (f(weeks=["Week 99"]), 2), (f(), 0)]
    queries = R.query_table(spark, [(n, " ".join(rng.sample(WORDS, k)) + " plain", own) for n, (own, k) in enumerate(asked)])
    vectors = spark.createDataFrame([(n, vector()) for n in range(len(asked)) if n != 3], "query_id bigint, qv array<double>")
    return chunks, documents, concepts, queries, vectors


def told(found):
    results, meta = found
    rows = sorted((r["query_id"], r["rank"], r["seq"], round(r["score"], 9), *(round(x, 9) for x in r["breakdown"])) for r in results.collect())
    return rows, sorted(str(r) for r in meta.collect())


@pytest.mark.parametrize("semantic", [False, True])
def test_sorted_lists_give_what_a_scan_gives(spark, corpus, monkeypatch, semantic):
    want = told(R.retrieve(*corpus[:4], 5, corpus[4], semantic, plain=True))
    assert len(want[0]) > 25
    assert told(R.retrieve(*corpus[:4], 5, corpus[4], semantic)) == want
    # short lists, so that several rounds are needed
    lengths, write = [], R.checkpoint
    monkeypatch.setattr(R, "GROWTH", 2)
    monkeypatch.setattr(R, "threshold_topk", partial(R.threshold_topk, depth=1))
    monkeypatch.setattr(R, "checkpoint", lambda df: lengths.append(0) or write(df))
    assert told(R.retrieve(*corpus[:4], 5, corpus[4], semantic)) == want
    assert len(lengths) > 12


def test_a_stale_index_has_lexical_scores_only(corpus):
    chunks, documents, concepts, queries, vectors = corpus
    odd = chunks.withColumn("embedding", F.when(F.col("seq") == 40, F.slice("embedding", 1, 2)).otherwise(F.col("embedding")))
    found = told(R.retrieve(odd, documents, concepts, queries, 4, vectors))
    assert found == told(R.retrieve(odd, documents, concepts, queries, 4, vectors, plain=True))
    assert any("stale_index=True" in r for r in found[1]) and any("stale_index=False" in r for r in found[1])


def test_filters_by_counting(corpus):
    chunks, documents, _, queries, _ = corpus
    asked = R.prepare_queries(queries).withColumn("qv", F.lit(None).cast("array<double>"))
    found = R.candidates(chunks.withColumn("len", F.lit(0)), documents, asked)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    kinds = {r["id"]: r["kind"] for r in documents.collect()}
    want = set()
    for q in asked.collect():
        for c in chunks.collect():
            week = c["week"]["label"] in q["weeks"] if q["weeks"] else not q["week_numbers"] or c["week"]["number"] in q["week_numbers"]
            own = not q["concepts"] or {x.lower() for x in q["concepts"]} & {x.lower() for x in c["concepts"]}
            if c["document_id"] in kinds and week and own and (not q["document_ids"] or c["document_id"] in q["document_ids"]) and (not q["kinds"] or kinds[c["document_id"]] in q["kinds"]):
                want.add((q["query_id"], c["seq"]))
    got = [(r["query_id"], r["seq"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_search_over_nothing(corpus):
    chunks, documents, concepts, queries, vectors = corpus
    results, meta = R.retrieve(chunks.limit(0), documents, concepts, queries, 4, vectors)
    assert results.count() == 0 and meta.count() == 8
    results, meta = R.retrieve(chunks, documents, concepts, queries.limit(0), 4, vectors)
    assert results.count() == 0 and meta.count() == 0


def test_what_a_search_says_of_itself_needs_no_text_and_no_search(corpus):
    chunks, documents, concepts, queries, vectors = corpus
    odd = chunks.withColumn("embedding", F.when(F.col("seq") == 40, F.slice("embedding", 1, 2)).when(F.col("seq") != 44, F.col("embedding")))
    for c in (chunks, odd):
        want = R.retrieve(c, documents, concepts, queries, 4, vectors)[1]
        found = R.describe(c.drop("text", "headings"), documents, concepts, queries, vectors)
        assert found.columns == want.columns
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
