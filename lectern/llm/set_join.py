"""N-gram Jaccard join: fixed-size subsets of small sets, inverted lists of large ones, the boundary between them chosen by cost."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import Memory, pieces
from lectern.llm.bag_minhash import mix
from lectern.llm.common import bit_gate, checkpoint, passes
from lectern.llm.near_dedup import NO_ID, linked

SHINGLE = 3
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Sets of fewer shingles may be joined by their subsets; how many do is a matter of cost.
SMALL = 32
#: Sizes of a label go up by this factor; parts of fewer shingles than THIN are left out where enough others are left.
GROWTH, THIN = 1.5, 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_hash = Memory(lambda w: xxhash.xxh64_intdigest(w), 150_000).__getitem__


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, 1): the distinct shingles of each text, by document, then shingle.

    Words stand between ASCII white space, A-Z lower-cased; a text of one or two words is one shingle.
    """
    found = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([max(len(w), SHINGLE) if w else 0 for w in found], dtype=np.int64)
    words = np.zeros(sizes.sum(), dtype=np.uint64)
    at = 0
    for own, size in zip(found, sizes, strict=True):
        words[at : at + len(own)] = np.fromiter(map(_hash, own), dtype=np.uint64, count=len(own))
        at += size
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        h = mix(h * _GOLD + words[j : n + j] + np.uint64(j + 1))
    inside = doc[:n] == doc[len(doc) - n :]
    h, doc = h[inside], doc[:n][inside]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new], np.ones(int(new.sum()), dtype=np.int64)


def most_apart(size: int, percent: int = PERCENT) -> int:
    """How many shingles two linked sets of at most ``size`` can differ in: with both sizes a and b, the union is 100 (a + b) / (100 + percent) at most."""
    union = 200 * size // (100 + percent)
    return (100 - percent) * union // 100


def most_dropped(size: int, percent: int = PERCENT) -> int:
    """How many shingles a linked partner of a set of ``size`` can lack."""
    return size - -(-percent * size // 100)


def label_of(size: int) -> int:
    return int(math.log(size) / math.log(GROWTH) + 1e-9)


def top_of(label: int) -> int:
    """The largest size that is put under a label."""
    size = int(GROWTH ** (label + 1)) + 2
    while label_of(size) > label:
        size -= 1
    return size


def labels_of(size: int, percent: int = PERCENT) -> list[int]:
    """The labels whose lists a set is entered in: its own and, if a larger partner may have the next one, that too."""
    own = label_of(size)
    return [own, own + 1] if label_of(100 * size // percent) > own else [own]


def shape(label: int, percent: int = PERCENT) -> tuple[int, int]:
    """(parts, parts that may be left out): linked sets under a label differ in so few shingles that one part more than may be left out is the same in both."""
    apart = most_apart(top_of(label), percent)
    spare = apart // 12
    return apart + 1 + spare, spare


def part_keys(doc: np.ndarray, shingle: np.ndarray, count: int, percent: int = PERCENT) -> list[np.ndarray]:
    """Of each of ``count`` sets, the keys of the inverted lists that it is entered in.

    A set's shingles are dealt by hash to as many parts as two linked sets can differ in, and some
    more; a list holds the sets of which one part is the same. Sets that differ in few shingles must meet in a list, and
    a passage or a phrase that many documents share makes no list, as a list of a single shingle would.
    Thin parts are left out, unless a set has more of those than can be spared.
    """
    sizes = np.bincount(doc, minlength=count)
    out: list[list[np.ndarray]] = [[] for _ in range(count)]
    wanted = [labels_of(int(n), percent) if n else [] for n in sizes]
    for turn in range(2):
        labels = np.array([w[turn] if turn < len(w) else -1 for w in wanted])
        own = np.flatnonzero(labels >= 0)
        if not len(own):
            continue
        shapes = np.array([shape(int(k), percent) for k in labels[own]])
        parts = np.zeros(count, dtype=np.int64)
        parts[own] = shapes[:, 0]
        start = np.cumsum(parts) - parts
        mine = labels[doc] >= 0
        d, s = doc[mine], shingle[mine]
        dealt = mix(s ^ mix((labels[d].astype(np.uint64) + np.uint64(1)) * _GOLD))
        at = start[d] + (dealt % parts[d].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(parts.sum()), dtype=np.uint64)
        np.add.at(total, at, mix(s + _GOLD))
        held = np.bincount(at, minlength=len(total))
        place = (np.arange(len(total)) - np.repeat(start, parts)).astype(np.uint64)
        key = mix(mix(total + held.astype(np.uint64)) ^ mix(place * _GOLD + np.repeat(labels, parts).astype(np.uint64))).view(np.int64)
        for i, (n, spare) in zip(own, shapes, strict=True):
            a, b = int(start[i]), int(start[i] + n)
            thick = held[a:b] >= THIN
            out[i].append(key[a:b] if n - thick.sum() > spare else key[a:b][thick])
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]


def subset_keys(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of a set's subsets of all sizes that an intersection with a linked set can have; each is the sum of its hashes."""
    hashes = mix(shingles + _GOLD)
    whole = hashes.sum(dtype=np.uint64, keepdims=True)
    sums = [whole]
    for k in range(1, most_dropped(len(hashes), percent) + 1):
        left_out = np.array(list(combinations(range(len(hashes)), k)))
        sums.append(whole - hashes[left_out].sum(axis=1, dtype=np.uint64))
    return mix(np.concatenate(sums) * _GOLD).view(np.int64)


def subset_cost(size: int, percent: int = PERCENT) -> int:
    return sum(math.comb(size, k) for k in range(most_dropped(size, percent) + 1))


def list_cost(size: int, percent: int = PERCENT) -> int:
    """Entries in lists, and the shingles that must be compared since a shared part proves less than a shared subset."""
    return sum(shape(k, percent)[0] for k in labels_of(size, percent)) + size


def reach(boundary: int, percent: int = PERCENT) -> int:
    """The smallest size of sets that may be linked with one of ``boundary`` shingles."""
    return -(-percent * boundary // 100)


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The boundary of least cost: smaller sets give subsets, sets from its ``reach`` up are entered in lists. ``sizes``: sets of each size under SMALL."""

    def cost(x: int) -> int:
        return sum(n * ((subset_cost(s, percent) if s < x else 0) + (list_cost(s, percent) if s >= reach(x, percent) else 0)) for s, n in sizes.items())

    return min(range(1, SMALL + 1), key=lambda x: (cost(x), x))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))


def _own_sets(texts: list[str]) -> list[np.ndarray]:
    doc, shingle, _ = shingle_sets(texts)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [shingle[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def sign(rows: DataFrame) -> DataFrame:
    """_id, _th, bag (16 bytes that stand for the set), n (its size)."""
    schema = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("bag", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            own = _own_sets(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(_digest, own), type=pa.binary()), pa.array([len(s) for s in own], type=pa.int64())], schema=schema)

    return rows.mapInArrow(run, "_id bigint, _th bigint, bag binary, n bigint")


def set_keys(rows: DataFrame, boundary: int, percent: int = PERCENT) -> DataFrame:
    """bag, keys: of each row's set those of its subsets, of its lists, or of both next to the boundary; empty sets have none."""
    schema = pa.schema([("bag", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "_text"):
            own = _own_sets(texts)
            listed = [s if len(s) >= reach(boundary, percent) else s[:0] for s in own]
            keys = part_keys(np.repeat(np.arange(len(own)), [len(s) for s in listed]), np.concatenate([np.zeros(0, dtype=np.uint64), *listed]), len(own), percent)
            keys = [np.concatenate([k, subset_keys(s, percent)]) if 0 < len(s) < boundary else k for s, k in zip(own, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, own), type=pa.binary()), _lists(keys)], schema=schema)

    return rows.select("_text").mapInArrow(run, "bag binary, keys array<bigint>")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` (distinct three-word shingles), ``component_id``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of shingles; a component is named by its smallest id.
    Equal sets are one node from the start. Sets that share a subset key or a list are compared by their texts, exactly, without
    all pairs of a list: with its most central member first, and the rest in blocks, as near duplicates are
    (``near_dedup.linked``). No pair is missed: the lists hold every pair that can be linked.

    A null text has no shingles, like an empty one; such documents are linked with nothing, so each row is its own component. A null id counts as
    the smallest. Rows that share an id are rows of their own, linked by their texts. An empty table gives an empty result; further columns of
    ``docs`` are ignored.
    """
    if percent * GROWTH < 100:
        raise ValueError(f"percent must be {math.ceil(100 / GROWTH)} or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    signed = checkpoint(sign(rows))
    nodes = checkpoint(signed.filter("n > 0").groupBy("bag").agg(F.min(F.struct("_id", "_th")).alias("m"), F.first("n").alias("n")).select("bag", F.col("m._id").alias("id"), F.col("m._th").alias("th"), "n"))
    sizes = {r["n"]: r["k"] for r in nodes.filter(F.col("n") < SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    # one row of each set is enough; a bitmap of fixed size keeps most others out, and what gets through has the same keys
    place = lambda a, b: F.xxhash64(a, b)
    gate = F.broadcast(bit_gate(nodes.select(place("id", "th").alias("key")), "key"))
    firsts = rows.crossJoin(gate).filter(passes(F.col("_gate"), place("_id", "_th")))
    keyed = checkpoint(set_keys(firsts, choose_boundary(sizes, percent), percent))
    labels = linked(nodes, keyed.select("bag", F.explode("keys").alias("key")), rows, percent / 100, shingle_sets)

    of_class = labels.join(nodes.select("bag", "id"), "bag")
    first = of_class.groupBy("comp").agg(F.min("id").alias("class_id"))
    named = checkpoint(labels.join(first, "comp").select("bag", "class_id"))
    single = nodes.select("bag", "id").join(named, "bag", "left").select("bag", F.coalesce("class_id", "id").alias("class_id"))
    given = lambda c: F.when(c != NO_ID, c)
    out = signed.select("_id", "n", "bag").join(single, "bag", "left")
    return out.select(given(F.col("_id")).alias(id_col), F.col("n").alias("n_shingles"), given(F.coalesce("class_id", "_id")).alias("component_id"))
