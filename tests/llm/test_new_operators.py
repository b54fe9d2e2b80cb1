"""op11 to op13 against brute force, and on odd input."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LONG, ROWS, frame

from lectern.llm import oracle, queries, set_join, turn_repair, whitening
from lectern.llm.set_join import similar_sets
from lectern.llm.turn_repair import damage, repair, repair_summaries, summaries, suffix_costs, walk
from lectern.llm.whitening import fit, subspace_iteration, whiten

TURNS = "conv_id bigint, turn bigint, role string, text string"
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(block):
    """The cheapest edits of a short block, tried out: (cost, audit)."""
    best = None
    fits = lambda s: not s or (s[1:] if s[0] == "s" else s) == "ua" * (len(s) // 2) != ""
    for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=len(block)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, f, _) in zip(edits, block, strict=True)):
            continue
        for extra in itertools.product(range(3), repeat=len(block) + 1):
            if sum(extra) > 2:
                continue
            for roles in itertools.product("ua", repeat=sum(extra)):
                left, out, audit, cost = list(roles), "", "", 3 * sum(extra)
                for n, (e, (initial, fault, _)) in zip(extra, zip(edits, block, strict=True), strict=False):
                    for _ in range(n):
                        out += left.pop(0)
                        audit += "I"
                    audit += e[0]
                    cost += {"D": 4, "K": 0}.get(e, 3) + (3 if e != "D" and fault == "truncated" else 0)
                    out += "" if e == "D" else initial if e == "K" else e[1]
                out += "".join(left)
                audit += "I" * extra[-1]
                if fits(out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_edits_equal_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        block = [(rng.choice(["s", "u", "a", "u", "a", "x"]), rng.choice([None, None, "blank", "duplicate", "truncated"]), 1) for _ in range(rng.randint(1, 4))]
        costs = suffix_costs(block, {s: 3 * n for s, n in turn_repair._AFTER.items()})
        edits, left = walk(block, costs, "")
        audit = "".join("I" * n + e for n, e, _ in edits) + "I" * turn_repair._AFTER[left]
        assert (costs[0][""], audit) == cheapest(block), block


def conversations(rng, n=25):
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 14)):
            text = rng.choice(["Yes.", "No?", "Well, maybe", " ", "Fine!\n", f"Turn {t}."])
            out.append((c, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), text))
    return out


def test_turn_repair_equals_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = conversations(rng) + [(40, t, ["user", "assistant"][t % 2], f"Long talk {t % 50}.") for t in range(60)]
    rows += [(50, None, "user", "a."), (50, 3, None, "b."), (50, 9, "assistant", None), (None, 1, "user", "c."), (None, 2, "assistant", "d."), (60, 1, "user", "x."), (60, 1, "user", "x."), (60, 1, "user", "a."), (61, None, "user", "")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{folder}/conversations.parquet")
    from sql_compare import compare

    got, want = compare(spark, folder, queries.op11_turn_repair, oracle.OP11)
    assert got == want and len(got) == len({r[0] for r in rows})


def test_turn_repair_does_not_depend_on_the_partitions(spark):
    rng = random.Random(11)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["So.", "And", f"Point {t}.", ""])) for t in range(400)] + conversations(rng, 6)
    df = spark.createDataFrame(rows, TURNS)
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    told = lambda d: sorted((str(r["conv_id"]), *r[1:]) for r in d.collect())
    try:
        spark.conf.set(names[1], "1")
        whole = told(repair_summaries(df, df))
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "9")
        edits = repair(df)
        assert edits.filter("conv_id = 1").select("part").distinct().count() > 3
        assert told(repair_summaries(df, df)) == whole
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_turn_repair_on_odd_rows(spark):
    rows = [(1, 1, "user", "hi."), (1, 1, "user", "hi."), (1, 1, "user", "hi."), (2, None, None, None), (3, 5, "assistant", LONG + "."), (None, 0, "system", "s.")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(7) for c in ("part", "n", "edit", "fault", "conv")})
    got = {r["conv_id"]: r.asDict() for r in summaries(repair(df)).collect()}
    assert got[1]["audit"] == "KDDI" and got[1]["duplicate"] == 2 and got[1]["illegal"] == 2 and got[1]["gaps"] == 0 and got[1]["cost"] == 11
    assert got[2]["audit"] == "D" and got[2]["blank"] == 1 and got[2]["repaired_sha256"] == NOTHING
    assert got[3]["audit"] == "D" or got[3]["audit"] == "IK"
    assert got[3]["cost"] == 3 and got[3]["repaired_sha256"] == hashlib.sha256(f"user:\nassistant:{LONG}.".encode()).hexdigest()
    assert got[None]["audit"] == "D" and got[None]["cost"] == 4
    none = spark.createDataFrame([], TURNS)
    assert repair(none).count() == 0 and repair_summaries(damage(none), none).count() == 0
    gone = repair_summaries(none, df).collect()
    assert len(gone) == 4 and all(tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "", NOTHING) for r in gone)


VECTORS = "vec_id bigint, embedding array<float>"


def plain_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (n * u - s) / n
    values, q = np.linalg.eigh(c.T @ c / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ q / np.sqrt(values), values / (c**2).sum() * n


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 40)) * np.linspace(2, 0.5, 40)
    vectors = [[float(v) for v in r] for r in np.vstack([base, base[:30]])]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0] * 39 + [None]), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, []), (905, [1.0] * 7), (None, vectors[3]), (906, [1e30] * 40)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(7) for c in ("id", "component", "_x", "n")}).repartition(3)
    got = whiten(df).collect()
    n, deviation, white, explained = plain_whitening(vectors, 16)
    assert len(got) == 431 * 16 and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == {*range(430), None}
    table = np.zeros((430, 16))
    for r in got:
        if r["vec_id"] is not None:
            table[r["vec_id"], r["component"] - 1] = r["whitened"]
            assert r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-12 and r["identity_error"] < 1e-10
    assert np.abs(table * np.sign((table * white).sum(axis=0)) - white).max() < 1e-9


def test_subspace_iteration_restarts_and_certifies():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 300))
    v = a.T @ a / 400
    passes = []
    values, vectors = subspace_iteration(lambda q: passes.append(q.shape[1]) or v @ q, 300, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.allclose(values, want, rtol=1e-12) and np.abs(v @ vectors - vectors * values).max() < 1e-12 and max(passes) == whitening.BLOCK


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_whitening_without_variance(spark, rows):
    assert whiten(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_whitening_leaves_out_components_without_variance(spark):
    rows = [(i, [float(i), 0.0, 2.0 * i]) for i in range(6)] + [(9, [9.0, 0.0, 1.0])]
    got = whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["component"] for r in got} == {1, 2} and abs(sum(r["explained"] for r in got if r["vec_id"] == 0) - 1) < 1e-9
    far = whiten(spark.createDataFrame([*rows, (10, [1e9, 0.0, 1e9])], VECTORS)).collect()
    assert all((r["deviation"] is None) == (r["vec_id"] == 10) or r["deviation"] is None for r in far)
    wide = fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0])], VECTORS))
    assert wide.width == 2 and wide.n == 2


def plain_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []) for w in words]


def plain_components(texts, percent=90):
    sets = plain_sets(texts)
    group = list(range(len(texts)))
    root = lambda i: i if group[i] == i else root(group[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            group[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def set_corpus(rng):
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for n in [3, 5, 9, 10, 11, 12, 14, 17, 20, 22, 24, 27, 30, 31, 33, 36, 45, 60, 90, 150, 300, 700]:
        base = [rng.choice(words) for _ in range(n)]
        out.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            out.append(" ".join(copy + [rng.choice(words)] * rng.randint(0, 1 + n // 20)))
        out.append(" ".join(passage[: rng.randint(20, 60)] + base[: n // 3]))
    return [*out, "one", "ONE", "one two", "", "  \n", "one  TWO", "one two three"]


def test_set_join_equals_brute_force(spark):
    for seed in (1, 2):
        texts = set_corpus(random.Random(seed))
        docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_sets(docs).collect()}
        want = plain_components(texts)
        assert got == dict(enumerate(want))
        sets = plain_sets(texts)
        assert len({c for i, (_, c) in enumerate(want) if sets[c] != sets[i]}) > 10


def test_linked_sets_share_a_key():
    rng = random.Random(9)
    missed, seen = 0, 0
    for n in [*range(9, 60), 80, 120, 200, 400, 900]:
        for _ in range(8):
            base = [rng.getrandbits(63) for _ in range(n)]
            apart = rng.randint(0, n // 9)
            gone = rng.randint(0, apart)
            pair = [np.sort(np.array(s, dtype=np.uint64)) for s in (base, base[gone:] + [rng.getrandbits(63) for _ in range(apart - gone)])]
            shared = n - gone
            if 100 * shared < 90 * (len(pair[0]) + len(pair[1]) - shared):
                continue
            seen += 1
            for boundary in (1, 20, 32):
                keys = []
                for s in pair:
                    own = set(set_join.subset_keys(s).tolist()) if len(s) < boundary else set()
                    if len(s) >= set_join.reach(boundary):
                        own |= set(set_join.part_keys(np.zeros(len(s), dtype=np.int64), s, 1)[0].tolist())
                    keys.append(own)
                missed += not keys[0] & keys[1]
    assert seen > 200 and not missed


def test_boundary_follows_cost():
    assert set_join.choose_boundary({15: 100}) > 15 and set_join.choose_boundary({25: 100, 21: 7}) <= 21
    assert set_join.choose_boundary({}) == 1


def test_set_join_on_odd_rows(spark):
    docs = frame(spark, ROWS, clash=True)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar_sets(docs).collect()), key=str)
    n = len(plain_sets([LONG])[0])
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, n, 3), (4, 1, None), (4, 1, None), (5, 1, None), (None, 1, None), (6, 1, 6)], key=str)
    assert similar_sets(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        similar_sets(docs, percent=50)


def test_set_join_equals_its_sql(spark, tmp_path):
    texts = set_corpus(random.Random(5))
    frame(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(999, None, "en"), (1000, "Ä É ö\x0bü", "de")]).write.parquet(f"{tmp_path}/documents.parquet")
    from sql_compare import compare

    got, want = compare(spark, str(tmp_path), queries.op13_set_join, oracle.OP13)
    assert got == want
