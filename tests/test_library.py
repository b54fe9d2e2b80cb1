"""Functions and operators of the note engine on a small corpus of our own."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import units as U
from lectern.functions import vectors as V
from lectern.operators.chunking import overlap, split_document
from lectern.operators.providers import LanguageModel, LocalEmbedder, RemoteEmbedder, embedder
from lectern.operators.retrieve import clamp_k, fuse, scale
from lectern.operators.study import StudyRequest, check_mode, scope_of
from lectern.sources.files import docx_html, parse_files


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_words_and_names(spark):
    assert one(spark, T.tokenise(F.col("t")), t="A p-value, depth-first for the win") == ["pvalue", "value", "depthfirst", "depth", "first", "win"]
    assert one(spark, T.title_case(F.col("t")), t="law of NP-complete problems") == "Law of NP-complete Problems"
    assert one(spark, T.normalise_concept(F.col("t")), t="Bayes' Theorem") == "bayes theorem"
    assert one(spark, T.normalise_concept(F.col("t")), t="été") == "t"
    assert one(spark, T.heading_concept(F.col("t")), t="Week 3: Balanced trees") == "Balanced Trees"
    assert one(spark, T.snippet(F.col("t"), 5), t=" ab  cd ef ") == "ab c…"
    assert one(spark, T.strip_html(F.col("t")), t="<h2 id=x>A</h2><script>'</p>'</script><p>b &amp;lt; c<br/>d<!-- e -->") == "## A\nb < c\nd"


def test_units(spark):
    found = one(spark, U.find_markers(F.col("t")), t="Weeks 1-3 éweek 3, w12: Lec. 4 xweek 5 week 60 W7")
    assert [(m["scheme"], m["number"]) for m in found] == [("Week", 3), ("Week", 12), ("Lecture", 4), ("Week", 7)]
    assert one(spark, U.canonical_scheme(U.find_markers(F.col("t"))), t="Lecture 1 Lecture 2 Week 9") == "Lecture"
    intent = one(spark, U.query_intent(F.col("t")), t="week 3 heaps and w4")
    assert (intent["week_numbers"], intent["cleaned"]) == ([3, 4], "heaps and w4")
    assert one(spark, U.query_intent(F.col("t"))["cleaned"], t="Week 3") == "Week 3"


def fnv(token, salt):
    h = 0x811C9DC5 ^ salt
    for c in token:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return h


def test_embedding_against_a_plain_model(spark):
    import math
    import re

    text = "Gradient descent, p-value"
    words = re.findall("[a-z0-9]+(?:['’-][a-z0-9]+)*", text.lower())
    sums = [0.0] * 512
    tokens = ["gradient", "descent", "pvalue", "value"]
    features = [(t, 1, 1.0) for t in tokens] + [(f"^{t}$"[i : i + 4], 2, 0.35) for t in tokens for i in range(len(t) - 1)] + [(f"{a}~{b}", 3, 0.6) for a, b in zip(words, words[1:])]
    for t, salt, w in features:
        h = fnv(t, salt)
        sums[h % 512] += -w if h >> 31 else w
    damped = [math.copysign(math.log1p(abs(x)), x) if x else 0.0 for x in sums]
    norm = math.sqrt(sum(x * x for x in damped))
    got = V.embed_rows(spark.createDataFrame([(1, text), (2, "")], "k int, t string"), "k", F.col("t")).orderBy("k").collect()
    assert [round(x, 6) for x in got[0]["embedding"]] == [round(x / norm, 6) for x in damped]
    assert set(got[1]["embedding"]) == {0.0}


def test_chunks():
    sentence = "This sentence has some forty characters. "
    long = sentence * 60
    source = f"# Week 1: Start\nShort line that is long enough to be kept as a chunk.\n## Part\n{long}\n\nNext paragraph after the long one, also kept."
    found = split_document(source)
    assert [h for _, h, _ in found][0] == ["Week 1: Start"] and found[-1][1] == ["Week 1: Start", "Part"]
    assert all(40 <= len(t) <= 1800 + 180 for t, _, _ in found)
    assert split_document("tiny") == [] and split_document("") == []
    assert overlap("x" * 100) == "x" * 100 and len(overlap("y" * 500)) == 180
    one_block = "\n\n".join(["w" * 700] * 2)
    assert [len(t) for t, _, _ in split_document(one_block)] == [1402, 180]


def test_min_max_and_fusion(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (2, 3.0), (3, 0.0)], "query_id int, v double")
    assert sorted(r["v"] for r in scale(rows, ["v"]).collect()) == [0.0, 0.0, 1.0, 1.0, 1.0]
    scores = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0)], "query_id int, dense double, lexical double, concept double")
    assert sorted(r["score"] for r in fuse(scores, {"dense": 0.35, "lexical": 0.5, "concept": 0.15}).collect()) == [0.35, 0.5]
    assert (clamp_k(None), clamp_k(99), clamp_k(-1), clamp_k(0)) == (8, 30, 1, 1)


def test_study_requests():
    from lectern.operators.retrieve import Filters

    assert scope_of(StudyRequest("o")) == ("your whole library", "your whole library")
    assert scope_of(StudyRequest("o", query=" heaps ", filters=Filters(concepts=["Trees"], week_numbers=[3]))) == ("heaps, Trees, unit 3", "heaps")
    assert check_mode("poem") == "summary"


def test_providers(spark):
    assert isinstance(embedder({}), LocalEmbedder) and embedder({"OPENAI_API_KEY": "x"}).dimensions == 1536
    fake = RemoteEmbedder("voyage", lambda texts: [{"index": i, "embedding": [3.0, 4.0]} for i in reversed(range(len(texts)))])
    assert fake.embed(spark.createDataFrame([("a",)], "t string"), "t", F.col("t")).first()["embedding"] == [0.6, 0.8]
    df = spark.createDataFrame([("p",)], "p string")
    assert LanguageModel().ask(df, F.col("p"), "a int").first()["answer"] is None
    assert LanguageModel(lambda p: '{"a": 5}').ask(df, F.col("p"), "a int").first()["answer"]["a"] == 5


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a &lt; b</w:t></w:r></w:p></w:body></w:document>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def test_files(spark):
    assert docx_html(docx()) == "<h1>Top</h1><p>a &lt; b</p>"
    files = [("a.HTML", b"<h1>T</h1><p>x"), ("b.md", b"# b"), ("c.exe", b""), ("d.docx", docx()), ("e.docx", b"no zip")]
    df = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in files], "name string, length long, content binary")
    good, bad = parse_files(df)
    assert {r["title"]: r["text"] for r in good.collect()} == {"a": "# T\nx", "b": "# b", "d": "# Top\na < b"}
    assert {r["name"] for r in bad.collect()} == {"c.exe", "e.docx"}


@pytest.mark.parametrize("parts", [1, 5])
def test_retrieval_does_not_depend_on_partitions(spark, parts):
    from lectern.plans import queries as Q

    got = [tuple(r) for r in Q.diversity_topk(spark, "/root/testdata/sf0.001").repartition(parts).orderBy("query_id", "rank").collect()]
    assert len(got) == 200 and len({r[:2] for r in got}) == 200
