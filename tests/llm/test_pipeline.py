"""The pipeline's stages one after the other, each against a plain Python model of it."""

import random
from collections import Counter

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import BPE, WORDS, edited, groups_of, repeats_removed, shares, solved
from tokenizers import Tokenizer

from lectern.llm import mixing, toxicity
from lectern.llm.sparse_text import sample, words

SLURS = ["nasty", "vile", "rotten", "awful"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: every fourth document toxic, every fourth poor, passages, copies and odd rows."""
    rng = random.Random(17)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage = [line(9) for _ in range(7)]
    rows, labels = [], []
    for i in range(160):
        text = [line(rng.randint(6, 14)) for _ in range(rng.randint(4, 9))]
        if i % 4 == 1:
            text = [f"{x} {rng.choice(SLURS)}" for x in text]
        if i % 4 == 2:
            text = [" | ".join(x.split()) for x in text]
        if i % 10 == 3:
            text[2:2] = passage
        rows.append((i, "\n".join(text)))
        labels.append((i, 0 if i % 4 == 2 else 1, 1 if i % 4 == 1 else 0))
    rows += [(1000 + i, edited(rng, rows[i * 4][1].split(" "), 1)) for i in range(12)]
    rows += [(None, None), (None, "no id at all"), (2000, ""), (2001, None), (7, rows[7][1]), (7, line(60)), (2002, line(90).upper())]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = pd.DataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows], columns=["doc_id", "text", "lang", "source", "n_chars", "rate", "class_id"])
    docs["doc_id"], docs["n_chars"] = docs["doc_id"].astype("Int64"), docs["n_chars"].astype("Int64")
    docs.to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype({"quality": "int32", "toxic": "int32"}).to_parquet(f"{folder}/labels.parquet")
    return folder


def as_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))


def test_stages(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    rows = as_rows(docs)

    model = toxicity.Severity(sample(docs, labels, F.col("toxic")))
    kept = stages["toxicity"](spark, docs, corpus).cache()
    want = [(i, t) for i, t in rows if model.score("", words(t or ""))[0] < toxicity.REJECT]
    assert in_order(as_rows(kept)) == in_order(want) and kept.columns == docs.columns
    assert 30 <= len(rows) - len(want) <= 45 and not any(i % 4 == 1 for i, _ in want if i is not None and i < 160)

    # first is by id; no passage is in two rows with the same id
    lines = stages["line dedup"](spark, kept, corpus).cache()
    # rows equal in id and text are one document
    order = list(dict.fromkeys(in_order(want)))
    left = dict(zip(order, repeats_removed([t or "" for _, t in order]).values(), strict=True))
    got = in_order(as_rows(lines))
    assert lines.columns == docs.columns and Counter((i, t or "") for i, t in got) == Counter((i, left[i, t]) for i, t in want)
    assert sum((t or "") != left[i, t] for i, t in order) >= 7
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines.collect())

    one = stages["near dedup"](spark, lines, corpus).cache()
    rows = in_order(as_rows(lines))
    group = groups_of([t for _, t in rows])
    first = {}
    for (i, t), g in zip(rows, group, strict=True):
        first.setdefault(g, (i, t or ""))
    assert one.columns == docs.columns and [i for i, _ in in_order(as_rows(one))] == [i for i, _ in in_order(list(first.values()))]

    mixed = stages["mixing"](spark, one, corpus).cache()
    scored = mixing.mix(one.select("doc_id", "text"), mixing.fit(docs, labels), whole="good", max_copies=1).toPandas()
    assert mixed.columns == docs.columns and mixed.count() == (scored.copies > 0).sum() < len(scored)
    assert (scored[scored.p_good >= 0.5].copies == 1).all()
    p, t = scored[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), scored.n_words.to_numpy(float)
    size = (p[:, 0] * t).sum() / t.sum() / mixing.TARGETS["good"]
    brute = solved(p, t, [mixing.TARGETS[d] * size for d in mixing.DOMAINS], 1.0, 0)
    assert abs(shares(scored, "rate") - (p * (t * brute)[:, None]).sum(axis=0) / t.sum()).max() < 3e-3

    library = Tokenizer.from_file(BPE)
    coded = stages["bpe"](spark, mixed, corpus).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in as_rows(mixed))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded) == want and all(r["n_tokens"] == len(r["ids"]) for r in coded)


def test_run_is_the_stages_in_order(spark, corpus, tmp_path):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "n_tokens", "ids", "decoded_sha256"} == set(out.columns) and out.count() > 60
    assert out.filter("doc_id % 4 = 1 and doc_id < 160").count() == 0


def test_run_on_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
