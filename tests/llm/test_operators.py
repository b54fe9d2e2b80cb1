"""Each operator against brute force, and on odd input: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from lectern.llm import bag_minhash, mixing, sparse_text, toxicity
from lectern.llm.bpe import WordBpe, bpe_encode
from lectern.llm.common import bit_gate, passes
from lectern.llm.exact_dedup import exact_duplicates
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.near_dedup import block_links, keep_one, near_classes
from lectern.llm.pii import find_pii, span_string
from lectern.llm.quality import quality_rules
from lectern.llm.token_counts import UnigramCounter, count_tokens
from lectern.llm.url_trust import filter_urls, propagate

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} runs on" for i in range(40_000))
#: Names that operators use inside or put out.
CLASHES = ["_id", "_text", "kept", "keep_id", "ids", "n_words", "rate", "_gate", "_ld_id", "class_id", "grade"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [(1, None, "en"), (2, "", None), (3, LONG, "en"), (4, "Same text here", "xx"), (4, "Same text here", "xx"), (5, "same TEXT here", "de"), (None, "Same text here", "fr"), (6, "ÄÖ É", "de")]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHES}) if clash else df


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS, clash=True)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_bit_gate_lets_every_key_through(spark):
    keys = spark.range(0, 5000, 7).withColumn("k", F.xxhash64("id"))
    gated = spark.range(5000).withColumn("k", F.xxhash64("id")).crossJoin(bit_gate(keys, "k", 1 << 16)).filter(passes(F.col("_gate"), F.col("k")))
    assert keys.join(gated, "id", "left_anti").count() == 0 and gated.count() < 1300
    assert spark.range(3).crossJoin(bit_gate(keys.limit(0), "k")).filter(passes(F.col("_gate"), F.col("id"))).count() == 0


def test_exact(odd, none):
    got = sorted(tuple(r) for r in exact_duplicates(odd, digest=True).select("doc_id", "keep_id", "group_size", "kept").collect() if r["doc_id"] is not None)
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 4, False), (4, 5, 4, False), (5, 5, 4, True), (6, 6, 1, True)]
    digest = {r["doc_id"]: r["text_sha256"] for r in exact_duplicates(odd, digest=True).collect()}
    assert digest[6] == hashlib.sha256("ÄÖ É".encode()).hexdigest() and digest[5] == hashlib.sha256(b"same text here").hexdigest()
    assert {r["doc_id"]: r["text_sha256"] for r in exact_duplicates(odd).collect()}[3] is None
    assert exact_duplicates(none).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    digits = lambda v: re.sub("[^0-9]", "", v)
    ok = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 8 <= len(digits(v)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, t) if ok[k](m.group())]


def test_pii_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@.@%+- 0123456789().é😀\n") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "a." * 20_000 + "@" + "b." * 20_000 + "c", "9" * 50_000, "x" * 50_000 + "@"]
    got = find_pii(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).select("doc_id", span_string(F.filter("pii", lambda s: s["kind"].isin(*PLAIN))).alias("s")).collect()
    for r in got:
        assert r["s"] == ",".join(base_spans(texts[r["doc_id"]])), texts[r["doc_id"]][:80]


def test_pii_method_adds_what_checks_and_context_confirm(spark, odd, none):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "IBAN GB83 WEST 1234 5698 7654 32 no", "call 555-123-4567 now", "order 555-123-4567 now"]
    got = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["pii"]] for r in find_pii(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in got[0] and not [k for k, _ in got[1] if k == "iban"]
    assert got[2] == [("phone_local", "555-123-4567")] and got[3] == []
    hexed = hashlib.sha1(b"x").hexdigest()
    texts = [f'token = "{hexed}"', f"commit {hexed}", f"plain {hexed} text", "key " + "a1" * 20, f"password {hexed}g", f"ükey {hexed}ü"]
    got = {r["doc_id"]: [(s["kind"], s["value"], s["score"]) for s in r["pii"]] for r in find_pii(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got == {0: [("secret", hexed, 0.6)], 1: [], 2: [], 3: [], 4: [], 5: [("secret", hexed, 0.6)]}
    assert find_pii(odd).count() == len(ROWS) and find_pii(none).count() == 0


def test_pii_iban_whatever_follows(spark):
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    texts = [f"IBAN {gb} BIC NWBKGB2L", f"IBAN {gb} I paid", f"IBAN {de} BIC COBADEFFXXX", f"IBAN {de} {gb} NO9386011117947", f"IBAN {de}X", f"IBAN {gb[:-1]}3 BIC NWBKGB2L"]
    got = {r["doc_id"]: [s["value"] for s in r["pii"] if s["kind"] == "iban"] for r in find_pii(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got == {0: [gb], 1: [gb], 2: [de], 3: [de, gb, "NO9386011117947"], 4: [], 5: []}


def quality_model(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, none):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "cc", "É#", " ", " ", "\n", "\t"]) for _ in range(rng.randint(0, 120))) for _ in range(200)] + ["a b c " * 5000]
    got = quality_rules(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()
    for r in got:
        assert tuple(r[1:6]) == quality_model(texts[r["doc_id"]])
    odd_rows = quality_rules(odd).collect()
    assert len(odd_rows) == len(ROWS) and all(r["base_failed"] and not r["kept"] for r in odd_rows if r["n_words"] < 50)
    assert quality_rules(none).count() == 0


def test_quality_references_are_the_good_documents(spark):
    prose = " ".join(["The rain in the north of the country is what we all know of it, and it is for that that we talk to a friend with some tea."] * 4)
    junk = " ".join(["#### $$$$ %%%% &&&& ****"] * 30)
    rows = frame(spark, [(1, prose, "en"), *((i, junk, "en") for i in range(2, 30)), (40, prose, "fr"), (41, junk, "xx")])
    good = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (99, "d")], "doc_id bigint, kept string")
    got = {r["doc_id"]: r for r in quality_rules(rows, good).collect()}
    assert got[1]["char_distance"] == got[1]["word_distance"] == 0 and got[2]["char_distance"] > 0.8
    assert got[40]["char_distance"] == 0 and got[40]["word_distance"] is None and got[41]["char_distance"] > 0.8
    # without good documents nothing is judged by distance; by default all count
    assert {r["char_distance"] for r in quality_rules(rows, good.limit(0)).collect()} == {None}
    assert quality_rules(rows).filter("doc_id = 2").first()["char_distance"] < 0.2


def test_url_on_odd_rows(spark):
    link = '<a href="http://blocked.example.com/x">'
    rows = [(1, "http://example.com/en/x", link), (1, "http://example.com/en/x", link), (2, "http://a.org/", link + "é" * 300_000 + " href = '"), (2, "http://a.org/", None), (None, "http://tie.org/", '<a href="//example.com/">')]
    rows += [(3, "http://z.example.com/de", '<a href="http://tie.org/">'), (4, "http://z.example.com/de", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("verdict", F.lit(1)).withColumn("src", F.lit("x"))
    got = filter_urls(pages).collect()
    assert len(got) == len(rows) and {r["verdict"] for r in got if r["page_id"] == 1} == {"block"}
    # a.org and example.com link to a host that com/ allows no page of; tie.org links to the blocked one and is linked to by an allowed one
    by_host = {r["host"]: r for r in got}
    assert by_host["a.org"]["verdict"] == "allow" and by_host["a.org"]["trust"] == by_host["a.org"]["distrust"] == 0
    assert by_host["tie.org"]["trust"] == by_host["tie.org"]["distrust"] > 0 and by_host["tie.org"]["verdict"] == "allow"
    # the parent domain's edges are an option
    assert {r["host"]: r["distrust"] > 0 for r in filter_urls(pages, parent_weight=1.0).collect()}["z.example.com"]


def test_url_rules_and_scores(spark):
    urls = [None, "", "no host", "https://WWW.Example.COM/en/a?b", "http://example.com/en/x", "http://a.example.com/de#f", "x://net/es/", "http://good.org/p", "http://bad.org/p", "http://example.com"]
    html = [""] * 7 + ['<a href="http://example.com/x">', '<A HREF=\'//m.net/es/\'>', None]
    pages = spark.createDataFrame([(i, u, h, 1) for i, (u, h) in enumerate(zip(urls, html))], "page_id bigint, url string, html string, host int")
    got = {r["page_id"]: r for r in filter_urls(pages).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(7)] == [("", ""), ("", ""), ("", ""), ("www.example.com", "/en/a"), ("example.com", "/en/x"), ("a.example.com", "/de"), ("net", "/es/")]
    assert [got[i]["rule"] for i in range(10)] == [None, None, None, "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None]
    assert [got[i]["verdict"] for i in (0, 3, 4, 5, 6)] == ["allow", "allow", "block", "allow", "block"]
    assert filter_urls(pages.limit(0)).count() == 0


def test_propagation_is_page_rank(spark):
    edges = {("a", "b"): 1.0, ("a", "c"): 3.0, ("b", "c"): 1.0, ("c", "a"): 2.0}
    seeds = {"a": 1.0, "b": 1.0}
    score = start = {h: 0.5 for h in seeds}
    for _ in range(6):
        new = {h: 0.15 * s for h, s in start.items()}
        for (x, y), w in edges.items():
            new[y] = new.get(y, 0) + 0.85 * score.get(x, 0) * w / sum(v for (s, _), v in edges.items() if s == x)
        score = new
    rows = spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, w double")
    got = propagate(rows, spark.createDataFrame([("trust", h, m) for h, m in seeds.items()], "kind string, host string, mass double"), iterations=6)
    assert {r["host"]: round(r["score"], 9) for r in got.collect()} == {h: round(s, 9) for h, s in score.items()}


def test_url_verdicts_hold_for_small_scores_and_long_ways(spark):
    # h24 links to h23 and so on to h0, which links to the blocked host; each has its own last label, so no parent joins them
    rows = [("http://example.com/en/x", "")] + [(f"http://h.t{i}/de", f'<a href="http://h.t{i - 1}/">' if i else '<a href="http://example.com/">') for i in range(25)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in filter_urls(pages).collect()}
    assert got[25]["distrust"] == 0 and {got[i]["verdict"] for i in range(26)} == {"block"}
    # a thousand hosts link to one of very many blocked pages' hosts: scores under 5e-10
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("distrust", "b", 1.0), ("distrust", "c", 1e10)], "kind string, host string, mass double")
    small = {r["host"]: r["settled"] for r in propagate(edges, seeds, tolerance=1e-6).collect()}
    assert 0 < small["a"] < 5e-10


FUZZ = "abcdeEéÉßΣσİıñ'’ \t\n\r\x0b\x1c\x85\u00a0\u2003\u3000日本語한각\u0301١²Ⅷ😀👍🏽<|>#$%._-0123456789ǅﬁ"


def fuzz(n):
    rng = random.Random(11)
    texts = ["".join(rng.choice(FUZZ) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return texts + ["".join(rng.choice("aehnortsi") for _ in range(rng.randint(1, 40))) for _ in range(n)] + ["a" * 3000, "<|endoftext|>Hi<|startoftext|> x", "don't we'll I'VE", ""]


def test_bpe_equals_the_library():
    own, library = WordBpe(BPE), Tokenizer.from_file(BPE)
    for t in fuzz(1500):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False), t


def test_token_counts_equal_the_library():
    own, sp = UnigramCounter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    for t in fuzz(1500):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_tokenizers_on_odd_rows(odd, none):
    coded = bpe_encode(odd, BPE).collect()
    assert len(coded) == len(ROWS) and all(r["ids"] == [] and r["decoded"] == "" for r in coded if r["doc_id"] in (1, 2))
    counts = count_tokens(odd, PIECES).collect()
    assert len(counts) == len(ROWS) and {r["n_tokens"] for r in counts if r["doc_id"] in (1, 2)} == {0}
    assert bpe_encode(none, BPE).count() == 0 and count_tokens(none, PIECES).count() == 0


def passages(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(9, 30))) for _ in range(n)]


WORDS = vocabulary(random.Random(1), 500)


def test_line_dedup_removes_repeated_passages_and_nothing_else(spark, odd, none):
    rng = random.Random(9)
    shared = passages(rng, 6)
    rows, clean = [], {}
    for i in range(40):
        own = passages(rng, 8)
        if i % 3 == 0:
            at = rng.randint(0, 8)
            rows.append((i, "\n".join(own[:at] + shared + own[at:]), "en"))
            clean[i] = rows[-1][1] if i == 0 else "\n".join(own)
        else:
            rows.append((i, "\n".join(own + ["short common line"]), "en"))
            clean[i] = rows[-1][1]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == clean
    out = dedup_lines(odd, removed="gone")
    assert out.columns == [*odd.columns, "gone"] and out.count() == len(ROWS)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[1] is None
    assert dedup_lines(none).columns == none.columns and dedup_lines(none).count() == 0


def repeats_removed(texts, least=50):
    """Brute force: every run of lines of ``least`` words or more is looked up at all earlier places."""
    runs = []
    for i, t in enumerate(texts):
        lines = t.split("\n")
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if n[a] and n[b] and sum(n[a : b + 1]) >= least:
                    runs.append((i, a, b, tuple(lines[a : b + 1])))
    first = {}
    for i, a, _, run in runs:
        first[run] = min(first.get(run, (i, a)), (i, a))
    gone = {(i, k) for i, a, b, run in runs if first[run] < (i, a) for k in range(a, b + 1)}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)}


def test_line_dedup_equals_brute_force_on_short_lines(spark):
    rng = random.Random(21)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shapes = [[60], [7] * 8, [6] * 10, [12, 4] * 4, [4, 60, 4], [1] * 55, [7] * 6, [49], [25, 0, 25], [3, 0, 0] * 20]
    texts = []
    for shape in shapes:
        shared = [line(n) for n in shape]
        for _ in range(3):
            around = lambda: [line(rng.choice([0, 2, 4, 12])) for _ in range(rng.randint(0, 5))]
            cut = shared[rng.choice([0, 0, 1]) :]
            texts.append("\n".join([*around(), *cut, *around(), *(shared if rng.random() < 0.3 else [])]))
    texts += ["\n".join(["again and"] * 90), "\n".join(["again and"] * 40)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    want = repeats_removed(texts)
    assert sum(want[i] != t for i, t in enumerate(texts)) > 15 and got == want


def test_line_dedup_does_not_depend_on_what_else_recurs(spark, monkeypatch):
    rng = random.Random(22)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = [line(5), line(20), line(20), line(5), line(6)]
    own = [line(4), line(4)]
    first = "\n".join([line(9), *shared, line(9), *(line(9) for _ in range(5))])
    texts = [first, first, "\n".join([own[0], *shared, own[1]]), *("\n".join([line(60), line(7), line(50)]) for _ in range(20))]
    rows = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    want = repeats_removed(texts)
    assert want[2] == "\n".join(own) and want[1] == ""
    assert {r["doc_id"]: r["text"] for r in dedup_lines(rows).collect()} == want
    # a bitmap that is full lets everything through, and the result is the same
    monkeypatch.setattr("lectern.llm.line_dedup.passes", lambda gate, key: F.lit(True))
    assert {r["doc_id"]: r["text"] for r in dedup_lines(rows).collect()} == want


def test_bag_minhash_is_unbiased():
    import numpy as np

    rng, errors = np.random.default_rng(0), []
    for _ in range(40):
        base = np.unique(rng.integers(1, 2**62, rng.integers(5, 150)).astype(np.uint64))
        u = rng.integers(0, 6, len(base))
        v = np.where(rng.random(len(base)) < 0.6, u, rng.integers(0, 6, len(base)))
        a, b = np.flatnonzero(u), np.flatnonzero(v)
        s = bag_minhash.signatures(np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[base[a], base[b]], np.r_[u[a], v[b]], 2, registers=2000)
        errors.append((s[0] == s[1]).mean() - np.minimum(u, v).sum() / np.maximum(u, v).sum())
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.02


def near_corpus(rng):
    base = [rng.choice(WORDS) for _ in range(120)]
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    return texts


def groups_of(texts):
    """Brute force: the number of the first text that each is connected with by pairs of 0.8 or more."""
    bags = [bag_minhash.bag_of(t or "") for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bag_minhash.similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(texts))]


def test_near_classes_equal_brute_force(spark, odd, none):
    texts = near_corpus(random.Random(4))
    got = {r["doc_id"]: r["class_id"] for r in near_classes(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(groups_of(texts)))
    odd_rows = near_classes(odd).collect()
    assert len(odd_rows) == len(ROWS) and {r["class_id"] for r in odd_rows if r["doc_id"] in (1, 2)} == {1}
    kept = keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert near_classes(none).count() == 0


def edited(rng, words, n):
    copy = list(words)
    for i in rng.sample(range(len(copy)), n):
        copy[i] = rng.choice(WORDS)
    return " ".join(copy)


def test_near_classes_go_by_texts_where_ids_repeat_or_lack(spark):
    rng = random.Random(12)
    x, y, z = ([rng.choice(WORDS) for _ in range(150)] for _ in range(3))
    join = " ".join
    rows = [(3, edited(rng, y, 2)), (7, join(x)), (7, join(y)), (9, edited(rng, x, 2)), (None, join(z)), (None, edited(rng, z, 2)), (None, join(x)), (None, None), (12, "")]
    rows += [(12, edited(rng, z, 1)), (20, join(x)), (20, join(x)), (21, "A  word"), (21, "a word"), (5, join(rng.choices(WORDS, k=80)))]
    docs = frame(spark, [(i, t, "en") for i, t in rows], clash=True)
    want = groups_of([t for _, t in rows])
    got = near_classes(docs).collect()
    # the classes, as sets of rows, are those of brute force, whatever they are called
    key = {(r["doc_id"], r["text_hash"]): r["class_key"] for r in got}
    hashes = [r["h"] for r in docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    mine = [key[i, h] for (i, _), h in zip(rows, hashes, strict=True)]
    assert len(got) == len(rows) and [mine.index(k) for k in mine] == [want.index(g) for g in want]
    smallest = {g: min((-1 if i is None else i for (i, _), w in zip(rows, want, strict=True) if w == g)) for g in set(want)}
    of_key = {k: smallest[g] for k, g in zip(mine, want, strict=True)}
    assert all((-1 if r["class_id"] is None else r["class_id"]) == of_key[r["class_key"]] for r in got)
    left = keep_one(docs).collect()
    assert len(left) == len(set(want)) and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in left) == sorted(smallest.values())


def test_near_recall_by_similarity():
    rng = random.Random(31)
    found = Counter()
    for _ in range(150):
        words = [rng.choice(WORDS) for _ in range(rng.randint(30, 400))]
        texts = [" ".join(words), edited(rng, words, rng.randint(0, max(1, len(words) // 50)))]
        a, b = (bag_minhash.bag_of(t) for t in texts)
        s = bag_minhash.similarity(a, b)
        doc, shingle, weight = bag_minhash.bags([bag_minhash.word_hashes(t) for t in texts])
        keys = bag_minhash.band_keys(bag_minhash.signatures(doc, shingle, weight, 2))
        step = "under" if s < 0.8 else "0.8" if s < 0.87 else "0.87" if s < 0.94 else "0.94"
        found[step, bool((keys[0] == keys[1]).any())] += 1
    assert all(found[k, True] > 15 and not found[k, False] for k in ("0.8", "0.87", "0.94")), found


def test_block_links_equal_pairs():
    texts = near_corpus(random.Random(8))[40:]
    name = lambda i: i.to_bytes(2, "big")
    rows = [{"bag": name(i), "comp": name(i), "x": i % 2 == 0, "_text": t} for i, t in enumerate(texts)]
    bags = [bag_minhash.bag_of(t) for t in texts]
    # those outside the main class ask all others; two of them meet once
    want = {(name(i), name(j)) for i in range(len(texts)) for j in range(i + 1, len(texts)) if bag_minhash.similarity(bags[i], bags[j]) >= 0.8 and not (i % 2 and j % 2)}
    found = block_links([r for r in rows if r["x"]], rows, 0.8)
    assert set(found) == want and len(found) == len(want)


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        kind = i % 4
        words = [rng.choice(WORDS) for _ in range(rng.randint(40, 90))]
        if kind == 1:
            for w in rng.sample(["nasty", "vile", "rotten", "awful"], rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " | ".join(words) if kind == 2 else " ".join(words), "en"))
        labels.append((i, 0 if kind == 2 else 1, 1 if kind == 1 else 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.filter("doc_id < 240"))
    got = {r["doc_id"]: r for r in toxicity.grade_toxicity(docs.filter("doc_id >= 240"), model).collect()}
    assert sum(r["rejected"] for i, r in got.items() if i % 4 == 1) >= 0.9 * len(got) / 4
    assert not any(r["rejected"] for i, r in got.items() if i % 4 != 1)
    assert all(r["p_1"] >= r["p_2"] >= r["p_3"] for r in got.values())
    carried = toxicity.grade_toxicity(odd, model, carry=True)
    assert carried.count() == len(ROWS) and set(odd.columns) <= set(carried.columns)
    assert toxicity.grade_toxicity(none, model).count() == 0
    unfit = toxicity.fit(docs, labels.limit(0))
    assert toxicity.grade_toxicity(docs, unfit).filter("rejected").count() == 0


def ordinal_loss(theta, x, y, m):
    import numpy as np

    cuts = np.cumsum(np.concatenate([theta[m : m + 1], np.exp(theta[m + 1 :])]))
    p = 1 / (1 + np.exp(-(x @ theta[:m])[:, None] + cuts))
    p = np.hstack([np.ones((len(x), 1)), p, np.zeros((len(x), 1))])
    own = p[np.arange(len(x)), y] - p[np.arange(len(x)), y + 1]
    return -np.log(np.maximum(own, 1e-12)).mean() + sparse_text.PRIOR * theta[:m] @ theta[:m] / (2 * len(x))


def test_ordinal_fit_is_the_best_of_plain_descent():
    import numpy as np

    rng = np.random.default_rng(3)
    n, m, grades = 120, 4, 4
    count = rng.poisson(0.8, (n, m))
    y = np.clip((np.log1p(count) @ [1.5, 1.0, 0.0, -1.0] + rng.logistic(size=n) * 0.6).astype(int), 0, grades - 1)
    counts = [Counter({str(j): int(c) for j, c in enumerate(row) if c}) for row in count]
    w, cuts = sparse_text.fit_ordinal(counts, y, {str(j): j for j in range(m)}, grades)
    assert (np.diff(cuts) > 0).all()
    x = np.log1p(count)
    fitted = ordinal_loss(np.concatenate([w, cuts[:1], np.log(np.diff(cuts))]), x, y, m)
    theta, step = np.zeros(m + grades - 1), 1.0
    for _ in range(1500):
        slope = np.array([(ordinal_loss(theta + d, x, y, m) - ordinal_loss(theta - d, x, y, m)) / 2e-5 for d in np.eye(len(theta)) * 1e-5])
        while step > 1e-8 and ordinal_loss(theta - step * slope, x, y, m) > ordinal_loss(theta, x, y, m):
            step /= 2
        theta, step = theta - step * slope, step * 1.5
    assert fitted <= ordinal_loss(theta, x, y, m) + 1e-4


def solved(p, t, want, most=None, whole=None, steps=20_000):
    """Brute force: rates of single documents by plain projected gradient."""
    import numpy as np

    r = np.ones(len(t))
    curve = np.diag((p * t[:, None]).T @ p) / t.sum()
    weight = 1 / np.maximum(curve, want)
    for _ in range(steps):
        gap = ((p * (t * r)[:, None]).sum(axis=0) / t.sum() - want) * weight
        r = np.clip(r - 0.2 * p @ gap, 0, most)
        if whole is not None:
            r[p[:, whole] >= 0.5] = 1
    return r


def shares(rows, by):
    totals = [(rows.n_words * rows[f"p_{d}"] * rows[by]).sum() for d in mixing.DOMAINS]
    return [t / rows.n_words.sum() for t in totals]


@pytest.mark.parametrize("want", [(0.8, 0.15, 0.05), (0.5, 0.4, 0.1), (0.3, 0.3, 0.4)])
def test_mixing_meets_targets(spark, want):
    import numpy as np

    docs, labels = labelled(spark)
    rows = mixing.mix(docs, mixing.fit(docs, labels), targets=dict(zip(mixing.DOMAINS, want, strict=True))).toPandas()
    p, t = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), rows.n_words.to_numpy(float)
    brute = solved(p, t, np.array(want))
    assert np.allclose(shares(rows, "rate"), want, rtol=2e-3) and np.allclose((p * (t * brute)[:, None]).sum(axis=0) / t.sum(), want, rtol=2e-3)
    assert rows.rate.min() >= 0 and (abs(rows.copies - rows.rate) < 1).all()
    # copies are whole numbers: each domain is met to within a document or so
    assert np.allclose(shares(rows, "copies"), want, rtol=0.03, atol=1.5 * t.max() / t.sum()), shares(rows, "copies")


def test_mixing_within_bounds(spark, odd, none):
    import numpy as np

    docs, labels = labelled(spark)
    model, want = mixing.fit(docs, labels), {"good": 0.5, "poor": 0.4, "toxic": 0.1}
    rows = mixing.mix(docs, model, targets=want, whole="good", max_copies=1).toPandas()
    assert rows.rate.max() <= 1 and set(rows.copies) <= {0, 1} and (rows[rows.p_good >= 0.5].copies == 1).all()
    p, t = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), rows.n_words.to_numpy(float)
    size = (p[:, 0] * t).sum() / t.sum() / 0.5
    brute = solved(p, t, np.array([0.5, 0.4, 0.1]) * size, 1.0, 0)
    assert np.allclose(shares(rows, "rate"), (p * (t * brute)[:, None]).sum(axis=0) / t.sum(), atol=2e-3)
    assert mixing.mix(odd, model).count() == len(ROWS) and mixing.mix(none, model).count() == 0
    carried = mixing.mix(odd, model, carry=True)
    assert carried.count() == len(ROWS) and set(odd.columns) <= set(carried.columns)
    assert mixing.mix(docs, mixing.fit(docs, labels.limit(0))).select("rate").distinct().count() == 1


def test_sample_is_bounded_and_whole(spark):
    docs, labels = labelled(spark)
    got = sparse_text.sample(docs, labels, F.col("toxic"), rows=10)
    assert Counter(y for _, y in got) == {0: 10, 1: 10}
    # rows that are too long are not picked in the first place; of rows with one id and of near copies one counts
    long = docs.withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.repeat(F.lit("so long "), 9000)).otherwise(F.col("text")))
    assert Counter(y for _, y in sparse_text.sample(long, labels, F.col("toxic"), rows=10)) == {0: 10, 1: 10}
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more")))).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 400))
    marks = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 400))
    assert len(sparse_text.sample(twice, marks, F.col("toxic"))) == 400
    assert sparse_text.sample(docs, labels.limit(0), F.col("toxic")) == []
