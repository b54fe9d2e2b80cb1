"""Near-duplicate classes: BagMinHash bands propose pairs, exact multiset overlap confirms them, connected components group them."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import pieces
from lectern.llm.bag_minhash import BANDS, bags, band_keys, signatures, similarity, word_hashes
from lectern.llm.common import bit_gate, checkpoint, fresh, passes

SIMILARITY = 0.8
#: Documents in one block of a comparison at most, about, and words.
BLOCK, BLOCK_WORDS = 128, 1 << 18
NO_ID = -(1 << 63)
#: (document, shingle, weight) of the multisets of some texts, by document, then shingle.
Bags = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def text_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return bags([word_hashes(t) for t in texts])


def _bag(of: Bags, text: str) -> tuple[np.ndarray, np.ndarray]:
    _, shingle, weight = of([text])
    return shingle, weight


def sign(rows: DataFrame) -> DataFrame:
    """_id, _th, bag (16 bytes that stand for the multiset of shingles), words (its size), bands: of each row of (_id, _th, _text), in one scan."""
    schema = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("bag", pa.binary()), ("words", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            doc, shingle, weight = text_bags(texts)
            keys = band_keys(signatures(doc, shingle, weight, len(texts)))
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            content = [hashlib.md5(shingle[a:b].tobytes() + weight[a:b].astype(np.int64).tobytes()).digest() for a, b in spans]
            sizes = pa.array([int(weight[a:b].sum()) for a, b in spans], type=pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, type=pa.binary()), sizes, lists], schema=schema)

    return rows.mapInArrow(run, "_id bigint, _th bigint, bag binary, words bigint, bands array<bigint>")


def texts_of(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """bag, _text of the wanted bags: the text of each one's first row, which gives the same multiset as all others.

    Texts are shuffled, not their shingles, whose hashes take more room. A bitmap of fixed size keeps the other rows out.
    """
    firsts = checkpoint(nodes.join(wanted.distinct(), "bag", "left_semi").select("bag", F.col("id").alias("_id"), F.col("th").alias("_th")))
    gate = F.broadcast(bit_gate(firsts.select(F.xxhash64("_id", "_th").alias("key")), "key"))
    near = rows.crossJoin(gate).filter(passes(F.col("_gate"), F.xxhash64("_id", "_th"))).select("_id", "_th", "_text")
    # a bag has one id and text, by which the join has dealt the rows already
    return checkpoint(near.join(firsts, ["_id", "_th"]).groupBy("_id", "_th", "bag").agg(F.min("_text").alias("_text")).select("bag", "_text"))


def verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, of: Bags = text_bags) -> DataFrame:
    """a, b, sim, words (of b): the weighted Jaccard similarity of each pair of bags, by the exact overlap of their shingles."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("bag")), nodes, rows)
    both = pairs.join(texts.select(F.col("bag").alias("b"), F.col("_text").alias("tb")), "b").join(texts.select(F.col("bag").alias("a"), F.col("_text").alias("ta")), "a").select("a", "b", "ta", "tb")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sim", pa.float64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out, words = [], []
            for a, ta, tb in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                # rows of the same leader follow each other
                if last is None or last[0] != a.as_py():
                    last = (a.as_py(), _bag(of, ta.as_py()))
                own = _bag(of, tb.as_py())
                out.append(similarity(last[1], own))
                words.append(int(own[1].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary()), pa.array(out, type=pa.float64()), pa.array(words, type=pa.int64())], schema=schema)

    return checkpoint(both.mapInArrow(run, "a binary, b binary, sim double, words bigint"))


def verify_rest(tried: DataFrame, labels: DataFrame, nodes: DataFrame, rows: DataFrame, threshold: float, of: Bags = text_bags) -> DataFrame:
    """a, b: all links between bags of different classes that share a leader.

    Two documents of one bucket share its leader, so no candidate is left out. The
    documents of a leader outside its largest class meet its others, save those that
    two bounds rule out: one minus the similarity is a metric, so documents whose
    similarities to the leader differ by more than 1 - ``threshold`` are no link, nor
    are those whose sizes differ by more than the threshold's ratio. Cells of that width in
    both measures make this a matter of neighbouring cells. Within those, a task holds
    two blocks of documents, fewer the longer they are, and
    counts the overlaps of one document with a whole block at once, through the
    shingles they share. Pairs are never rows; only links come out.
    """
    width, ratio = 1 - threshold + 1e-9, math.log(1 / threshold) + 1e-9
    own = checkpoint(tried.select(F.col("a").alias("g"), F.col("b").alias("bag"), "sim", "words").join(labels, "bag", "left").select("g", "bag", F.coalesce("comp", "bag").alias("comp"), F.floor(F.col("sim") / width).cast("int").alias("s"), F.floor(F.log("words") / ratio).cast("int").alias("w")))
    sizes = own.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("m"))
    sizes = checkpoint(sizes.filter("n > m").select("g", "main"))
    open_ = checkpoint(own.join(sizes, "g").select("g", "s", "w", "bag", "comp", (F.col("comp") != F.col("main")).alias("x")))
    cell = ["g", "s", "w"]
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    out = checkpoint(open_.filter("x").select("g", near("s"), "w", "bag", "comp", "x").select("g", "s", near("w"), "bag", "comp", "x"))
    # how many documents make a block of a cell, and how many blocks its two sides make
    held = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_WORDS) / F.exp((F.col("w") + 1) * ratio))))
    blocks_of = lambda n: F.ceil(F.col(n) / held).cast("int")
    counts = out.groupBy(cell).agg(F.count(F.lit(1)).alias("cx")).join(open_.groupBy(cell).agg(F.count(F.lit(1)).alias("cy")), cell)
    counts = checkpoint(counts.select(*cell, blocks_of("cx").alias("nx"), blocks_of("cy").alias("ny")))

    texts = texts_of(open_.select("bag"), nodes, rows)
    spread = F.xxhash64("bag", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    xs = out.join(counts, cell).join(texts, "bag").select(*cell, "bag", "comp", "x", "_text", F.pmod(spread, F.col("nx")).cast("int").alias("xb"), every("ny").alias("yb"), F.lit(True).alias("asks"))
    ys = open_.join(counts, cell).join(texts, "bag").select(*cell, "bag", "comp", "x", "_text", every("nx").alias("xb"), F.pmod(spread, F.col("ny")).cast("int").alias("yb"), F.lit(False).alias("asks"))
    at = [*cell, "xb", "yb"]
    blocks = xs.unionByName(ys).repartition(*at).sortWithinPartitions(*at).select(*at, "bag", "comp", "x", "asks", "_text")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in itertools.groupby((r for b in batches for r in b.to_pylist()), key=lambda r: tuple(map(r.get, at))):
            block = list(held)
            found = block_links([r for r in block if r["asks"]], [r for r in block if not r["asks"]], threshold, of)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary()) for c in zip(*found, strict=True)], schema=schema)

    return checkpoint(blocks.mapInArrow(run, "a binary, b binary").distinct())


def block_links(xs: list[dict], ys: list[dict], threshold: float, of: Bags = text_bags) -> list[tuple[bytes, bytes]]:
    """(bag, bag) of the pairs of one of ``xs`` and one of ``ys``, of different classes, that reach the similarity; of two that both ask, once."""
    if not xs or not ys:
        return []
    owner, shingle, weight = of([r["_text"] for r in ys])
    order = np.argsort(shingle, kind="stable")
    owner, shingle, weight = owner[order], shingle[order], weight[order]
    total = np.bincount(owner, weights=weight, minlength=len(ys))
    out = []
    for r in xs:
        own, count = _bag(of, r["_text"])
        lo, hi = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
        n = hi - lo
        # the places in ys of each shingle of r, one after the other
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        shared = np.bincount(owner[at], weights=np.minimum(weight[at], np.repeat(count, n)), minlength=len(ys))
        whole = total + count.sum() - shared
        for i in np.flatnonzero((whole > 0) & (shared / np.maximum(whole, 1) >= threshold)):
            y = ys[i]
            if y["comp"] != r["comp"] and (not y["x"] or r["bag"] < y["bag"]):
                out.append((min(r["bag"], y["bag"]), max(r["bag"], y["bag"])))
    return out


def components(links: DataFrame) -> DataFrame:
    """bag, comp: the smallest node that each end of a link (a, b) is connected with.

    Smallest labels spread along links and then along labels, which halves long
    chains; what a hub receives is pre-aggregated. It ends after a step that lowers no label.
    """
    ways = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(ways.groupBy(F.col("a").alias("bag")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    while True:
        near = ways.join(labels.select(F.col("bag").alias("b"), "comp"), "b").select(F.col("a").alias("bag"), "comp", F.lit(False).alias("own"))
        step = labels.select("bag", "comp", F.lit(True).alias("own")).unionByName(near).groupBy("bag").agg(F.min("comp").alias("comp"), F.min(F.when(F.col("own"), F.col("comp"))).alias("was"))
        up = labels.select(F.col("bag").alias("comp"), F.col("comp").alias("up"))
        moved = checkpoint(step.join(up, "comp", "left").select("bag", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was"))
        labels = moved.select("bag", "comp")
        if moved.filter(F.col("comp") != F.col("was")).isEmpty():
            return labels


def linked(nodes: DataFrame, keys: DataFrame, rows: DataFrame, threshold: float, of: Bags = text_bags) -> DataFrame:
    """bag, comp: the connected components of the bags that reach the similarity, bags without a link left out.

    ``nodes`` (bag, id, th) names a row of each bag, ``keys`` (bag, key) those that may be linked: bags that share a key are compared,
    by the rows' texts, without forming all pairs of a key.
    """
    shared = checkpoint(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    gate = F.broadcast(bit_gate(shared, "key"))
    members = checkpoint(keys.crossJoin(gate).filter(passes(F.col("_gate"), F.col("key"))).select("bag", "key").distinct().join(shared, "key"))

    # the member that shares the largest buckets is nearest to the middle of its group
    weight = checkpoint(members.groupBy("bag").agg(F.sum("n").alias("w")))
    leaders = checkpoint(members.join(weight, "bag").groupBy("key").agg(F.max_by("bag", F.struct("w", "bag")).alias("a")))
    pairs = checkpoint(members.join(leaders, "key").filter("bag <> a").select("a", F.col("bag").alias("b")).distinct())
    tried = verify(pairs, nodes, rows, of)
    links = tried.filter(F.col("sim") >= threshold).select("a", "b")
    more = verify_rest(tried, components(links), nodes, rows, threshold, of)
    return components(links.unionByName(more))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, ``kept``, ``class_key``, ``text_hash``.

    Documents whose multisets of five-word shingles (lower-cased words between
    white space) have a weighted Jaccard similarity of ``threshold`` or more are linked;
    a class is a connected component. What is linked are multisets, not ids: equal multisets are one class from the start, and rows that share an
    id but not their text, or have none, go by their own texts. A class is named by its smallest id, of whose rows the one with the
    smallest text hash is kept; rows equal in id and text are one document and all marked. ``class_key``
    (the class's smallest multiset digest, in hex) tells classes apart where repeated ids give two of them the same name.
    A text of one to four words is
    one shingle; null and empty texts are all one class. A null id counts as the smallest. An
    empty table gives an empty result; further columns of ``docs`` are ignored.

    Pairs that share a band are compared without forming all pairs of a bucket.
    Each bucket is first compared with its most central member, which joins most
    near copies into one class. Then, where a leader's documents still span several classes,
    pairs of different classes are compared, all of them but those that the first
    comparison rules out, see ``verify_rest``. A pair at the threshold is missed
    by all bands with a probability under 1e-5, one above it less often.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    signed = checkpoint(sign(rows))
    # equal bags have equal bands
    nodes = checkpoint(signed.groupBy("bag").agg(F.min(F.struct("_id", "_th", "bands")).alias("m")).select("bag", F.col("m._id").alias("id"), F.col("m._th").alias("th"), F.col("m.bands").alias("bands")))

    labels = linked(nodes, nodes.select("bag", F.explode("bands").alias("key")), rows, threshold)

    # a class is named by the first row of all its nodes
    in_class = checkpoint(labels.join(nodes.select("bag", "id", "th"), "bag"))
    first = in_class.groupBy("comp").agg(F.min(F.struct("id", "th")).alias("f"))
    of_class = checkpoint(in_class.select("bag", "comp").join(first, "comp"))
    named = checkpoint(nodes.select("bag", "id", "th").join(of_class, "bag", "left").select("bag", F.coalesce("comp", "bag").alias("comp"), F.coalesce("f.id", "id").alias("class_id"), F.coalesce("f.th", "th").alias("class_th")))
    out = signed.select("_id", "_th", "bag").join(named, "bag")
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    kept = (F.col("_id") == F.col("class_id")) & (F.col("_th") == F.col("class_th"))
    return out.select(given("_id").alias(id_col), given("class_id").alias("class_id"), kept.alias("kept"), F.lower(F.hex("comp")).alias("class_key"), F.col("_th").alias("text_hash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, all columns as they are.

    Rows equal in id and text count as one document, of which one row stays.
    Only rows that may have to go take part in a shuffle; a bitmap of fixed size
    lets the others past.
    """
    found = near_classes(docs, id_col, text_col, threshold)
    p = fresh(docs, "_nd_")
    key = lambda a, b: F.xxhash64(a, b)
    seen = found.groupBy(key(F.col(id_col), F.col("text_hash")).alias(f"{p}key")).agg(F.max("kept").alias(f"{p}kept"), F.count(F.lit(1)).alias(f"{p}n"))
    odd = checkpoint(seen.filter(f"not {p}kept or {p}n > 1"))
    gate = F.broadcast(bit_gate(odd, f"{p}key").withColumnRenamed("_gate", f"{p}gate"))
    gated = docs.withColumn(f"{p}key", key(F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))).crossJoin(gate).withColumn(f"{p}in", passes(F.col(f"{p}gate"), F.col(f"{p}key"))).drop(f"{p}gate")
    left = gated.filter(f"{p}in").join(odd.filter(f"not {p}kept").select(f"{p}key"), f"{p}key", "left_anti").dropDuplicates([f"{p}key"])
    return left.unionByName(gated.filter(f"not {p}in")).drop(f"{p}key", f"{p}in")
