"""What went wrong on larger tables, on small ones."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import vectors as V
from lectern.functions.text import raw_words, tokenise
from lectern.functions.vectors import dot
from lectern.operators import dense as D
from lectern.operators import retrieve as R
from lectern.operators.bm25 import hit_scores
from lectern.plans.queries import queries
from lectern.sources import files
from lectern.sources.connectors import blocks_to_documents


def test_blocks_are_walked_without_a_limit_of_rows(spark):
    def rows(page):
        # a chain of five, of which the fifth is too deep; a block without its parent; two in a ring
        chain = [(page, f"b{i}", f"b{i - 1}" if i else None, i, "paragraph", [(f"line {i}",)], None) for i in range(5)]
        return [*chain, (page, "lost", "nowhere", 9, "paragraph", [("lost",)], None), (page, "x", "y", 7, "quote", [("x",)], None), (page, "y", "x", 8, "quote", [("y",)], None)]

    schema = "page_id bigint, block_id string, parent_id string, position int, kind string, rich_text array<struct<plain_text:string>>, language string"
    blocks = spark.createDataFrame([r for page in range(40) for r in rows(page)], schema)
    spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
    try:
        found = blocks_to_documents(blocks).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted(found) == [(page, "line 0\nline 1\nline 2\nline 3") for page in range(40)]


@pytest.fixture(scope="module")
def sides(spark):
    """Vectors and queries with copies, gaps, other widths, none at all, and values that are no numbers; and the score of each two, one by one."""
    rng = random.Random(4)
    vector = lambda w=6: [rng.gauss(0, 1) for _ in range(w)]
    same = vector()
    odd = {3: None, 5: [], 8: vector(3), 9: [None, *vector(5)], 11: [float("nan"), *vector(5)], 12: [float("inf"), *vector(2)], 13: vector(9)}
    rows = [(i, f"d{rng.randint(0, 11)}", odd.get(i, same if i % 4 == 0 else vector())) for i in range(300)]
    vectors = spark.createDataFrame(rows, "seq bigint, document_id string, e array<double>").repartition(3)
    asked = spark.createDataFrame([(i, e) for i, _, e in rows if i % 20 == 0 or i in odd], "query_id bigint, qv array<double>")
    plain = vectors.crossJoin(asked).select("query_id", "seq", "document_id", dot(F.col("e"), F.col("qv")).alias("score"))
    return vectors, asked, plain


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_scores_and_their_ends_by_blocks(sides, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    monkeypatch.setattr(D, "QUERY_BLOCK", 4)
    vectors, asked, plain = sides
    assert told(D.scores(vectors, asked)) == told(plain.drop("document_id"))
    assert told(D.ends(vectors, asked)) == told(plain.groupBy("query_id").agg(F.min("score"), F.max("score")))


def test_minmax_scale_has_no_row_expression_for_each_pair(spark):
    found = queries()["minmax_scale"](spark, "/root/testdata/sf0.001")
    assert "zip_with" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("by_document", [True, False])
def test_the_best_by_blocks_hold_the_best_of_all(sides, monkeypatch, few, by_document):
    monkeypatch.setattr(D, "BLOCK", 64)
    monkeypatch.setattr(D, "QUERY_BLOCK", 4)
    monkeypatch.setattr(D, "TASKS", 1)
    monkeypatch.setattr(D, "is_few", lambda df: few)
    vectors, asked, plain = sides
    # diversity counts on scores that aren't negative, and numbers
    asked = asked.filter("query_id % 20 = 0") if by_document else asked
    vectors = vectors.filter("seq > 13") if by_document else vectors
    plain = plain.join(asked.select("query_id"), "query_id").join(vectors.select("seq"), "seq")
    found = D.best(vectors, asked, 3, by_document)
    assert found.count() < plain.count() / 2

    def top(df):
        df = df.withColumn("score", F.round("score", 6))
        if by_document:
            return R.diversify(df.select("query_id", "seq", "document_id", "score"), 3).select("query_id", "rank", "seq", "document_id", "score")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seq"))
        return df.withColumn("rank", rank).filter("rank <= 3").select("query_id", "rank", "seq", "document_id", "score")

    assert told(top(found)) == told(top(plain))


def test_texts_that_tie_stay_tied(spark, tmp_path):
    # the same terms in each text, in many orders; more texts with some of them make their weights differ
    terms = {t: i % 5 + 1 for i, t in enumerate("abcdefghijkl")}
    hits = [(0, seq, t, tf, 10) for seq in range(200) for t, tf in random.Random(seq).sample(sorted(terms.items()), len(terms))]
    hits += [(0, 1000 + i, t, 1, 5) for i, t in enumerate("aabcccddddefffgghijjjjjkk")]
    # rows of a text in several files, so that each is summed up in another order
    random.Random(1).shuffle(hits)
    spark.createDataFrame(hits, "query_id bigint, seq bigint, term string, tf bigint, len bigint").repartition(8).write.parquet(f"{tmp_path}/hits")
    hits = spark.read.parquet(f"{tmp_path}/hits")
    stats = spark.createDataFrame([(0, 5000, 13.7)], "query_id bigint, n bigint, avg double")
    assert hit_scores(hits, stats).filter("seq < 1000").select("lexical").distinct().count() == 1


def test_concept_scores_are_shared_by_sets_of_concepts(spark):
    rng = random.Random(9)
    names = ["Heap", "tree", "GRAPH", "unknown"]
    rows = [(i, rng.choice([None, [], ["heap", "Heap"], [None, "Tree"], rng.sample(names, 2)])) for i in range(200)]
    chunks = spark.createDataFrame(rows, "seq bigint, concepts array<string>")
    score = {(q, n): rng.uniform(-1, 1) for q in range(5) for n in ("heap", "tree", "graph")}
    by_name = spark.createDataFrame([(q, n, x) for (q, n), x in score.items()], "query_id bigint, concept_key string, score double")
    found = R.carried_scores(chunks, by_name)
    known = [(i, {c.lower() for c in cs or [] if c} & {"heap", "tree", "graph"}) for i, cs in rows]
    assert told(found) == sorted(str((q, i, max(0.0, *(score[q, n] for n in own)))) for i, own in known if own for q in range(5))
    # no shuffle and no sum of a row for each query and chunk
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_files_are_parsed_in_pieces_of_a_batch():
    made = []
    schema = pa.schema([("name", pa.string()), ("n", pa.int64())])
    run = files.by_pieces(lambda b, i: made.append(i) or (b.column(0)[i].as_py(), len(b.column(1)[i].as_py() or b"")), schema)
    sizes = [10] * 200 + [files.PIECE_BYTES] * 3 + [None, 0, 5]
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(len(sizes))]), pa.array([None if n is None else b"x" * n for n in sizes], type=pa.binary())], names=["name", "content"])
    out = run(iter([batch]))
    first = next(out)
    assert first.num_rows == len(made) == files.PIECE_ROWS
    found = [first, *out]
    assert [r["n"] for b in found for r in b.to_pylist()] == [n or 0 for n in sizes] and max(b.num_rows for b in found) == files.PIECE_ROWS


def test_embeddings_are_made_in_batches_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(2)
    some = ["heap", "don’t", "p-value", "x1", "the", "y" * 3000, "Ordnung", "graph"]
    texts = [None, "", "!", "one", *(" ".join(rng.choices(some, k=rng.randint(1, 30))) for _ in range(40))]
    # keys may repeat
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "k int, t string")
    made = V.embed_rows(rows, "k", F.col("t"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = [r["embedding"] for r in made.collect()]

    def hashed(word, salt):
        h = fixed.FNV_SEED ^ salt
        for c in word:
            h = (h ^ ord(c)) * fixed.FNV_PRIME & 0xFFFFFFFF
        return h

    parts = rows.select(raw_words(F.col("t")).alias("w"), tokenise(F.col("t")).alias("c")).collect()
    assert len(got) == len(parts) == len(texts)
    for r, vector in zip(parts, got, strict=True):
        w, c = r["w"] or [], r["c"] or []
        found = [(t, fixed.WORD_SALT, fixed.WORD_WEIGHT) for t in c] + [(f"^{t}$"[i : i + 4], fixed.GRAM_SALT, fixed.GRAM_WEIGHT) for t in c for i in range(len(t) - 1)]
        sums = [0.0] * fixed.DIMENSIONS
        for t, salt, weight in found + [(f"{a}~{b}", fixed.PAIR_SALT, fixed.PAIR_WEIGHT) for a, b in zip(w, w[1:], strict=False)]:
            h = hashed(t, salt)
            sums[h % fixed.DIMENSIONS] += -weight if h >> 31 else weight
        damped = [math.copysign(math.log1p(abs(round(x, 6))), x) for x in sums]
        norm = math.sqrt(sum(x * x for x in damped)) or 1.0
        assert vector == pytest.approx([x / norm for x in damped], abs=1e-12)
    # in small steps, and with all words side by side
    lists = [pa.array([r[k] for r in parts], type=pa.list_(pa.string())) for k in ("w", "c")]
    monkeypatch.setattr(V, "STEP", 7)
    monkeypatch.setattr(V, "LONG_WORDS", 0)
    assert V.embed_batch(*lists).to_pylist() == got
    # a batch may be part of another
    assert V.embed_batch(*(x.slice(5, 20) for x in lists)).to_pylist() == got[5:25]


def test_hashed_embedding_makes_each_embedding_once(spark):
    found = queries()["hashed_embedding"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def asked(spark, name):
    folder = "/root/testdata/sf0.001"
    return told(queries()[name](spark, folder).select("query_id").distinct()), told(spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id"))


def test_semantic_fusion_answers_every_question(spark):
    found, every = asked(spark, "semantic_fusion")
    assert found == every


def test_study_context_is_made_for_every_question(spark):
    found, every = asked(spark, "study_context")
    assert found == every


@pytest.mark.parametrize("few", [1024, 0])
def test_concept_scores_meet_chunks_in_packs(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW_ROWS", few)
    monkeypatch.setattr(R, "PACK", 16, raising=False)
    # a common set, some rare ones, one unknown, and chunks that have their place twice or none
    rows = [(i // 2 if i < 20 else i, ["Heap"] if i % 4 else [f"c{i % 7}", "heap"]) for i in range(400)] + [(None, ["heap"]), (900, ["unknown"])]
    chunks = spark.createDataFrame(rows, "seq bigint, concepts array<string>")
    score = {(q, n): ((q * 7 + k * 3) % 11 - 4) / 8 for q in range(40) for k, n in enumerate(["heap", *(f"c{i}" for i in range(7))])}
    by_name = spark.createDataFrame([(q, n, x) for (q, n), x in score.items()], "query_id bigint, concept_key string, score double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = R.carried_scores(chunks, by_name)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, map(tuple, got))) == sorted(str((q, i, max([0.0, *(score[q, c.lower()] for c in cs)]))) for i, cs in rows if cs != ["unknown"] for q in range(40))
    # where the blocks of scores are few they aren't shuffled to each part of the chunks
    assert re.search(r"(\w+)Join", plan).group(1) == ("BroadcastHash" if few else "SortMerge")
