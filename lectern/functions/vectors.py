"""Hashed embeddings and vector arithmetic, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.spans import let
from lectern.functions.text import raw_words, tokenise

#: Weights are added up in millionths; features that are counted at once; so many words are hashed one by one rather than side by side.
MICRO, STEP, LONG_WORDS = 1_000_000, 1 << 18, 4


def fnv1a(token: Column, salt: int) -> Column:
    """Salted 32-bit FNV-1a over the characters of a token, as bigint."""
    start = F.lit(fixed.FNV_SEED ^ salt).cast("bigint")
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    # every character is a code point under 2^16 here; those above are hashed as one
    return F.aggregate(chars, start, lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * fixed.FNV_PRIME).bitwiseAND(mask))


def bucket(h: Column) -> Column:
    return (h % fixed.DIMENSIONS).cast("int")


def sign(h: Column) -> Column:
    return F.when(F.shiftright(h, 31).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter of two arrays."""
    each = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(v, lambda x: let(F.sqrt(dot(x, x)), lambda n: F.transform(x, lambda y: F.when(n > 0, y.cast("double") / n).otherwise(y.cast("double")))))


def hashes(start: np.ndarray, chars: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``fnv1a`` of many words at once, each going on from its ``start``: words are ``size`` of ``chars`` from ``first``. A few long ones go on by themselves."""
    order = np.argsort(-size, kind="stable")
    h, first, size = start[order].astype(np.uint32), first[order], size[order]
    # how many words have a j-th character
    left = len(size) - np.cumsum(np.bincount(size)) if len(size) else np.zeros(0, dtype=int)
    j = 0
    while j < len(left) and left[j] > LONG_WORDS:
        k = left[j]
        h[:k] = (h[:k] ^ chars[first[:k] + j]) * np.uint32(fixed.FNV_PRIME)
        j += 1
    for i in range(left[j] if j < len(left) else 0):
        x = int(h[i])
        for c in chars[first[i] + j : first[i] + size[i]].tolist():
            x = (x ^ c) * fixed.FNV_PRIME & 0xFFFFFFFF
        h[i] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def _seed(salt: int, n: int) -> np.ndarray:
    return np.full(n, fixed.FNV_SEED ^ salt, dtype=np.uint32)


def _signed(h: np.ndarray, weight: float) -> np.ndarray:
    """Signed weights, as whole millionths: their sums are exact in any order."""
    return np.where(h >> 31 == 1, -1.0, 1.0) * round(weight * MICRO)


class Words:
    """The words of a batch's texts: a code each, with the row it stands in, and each distinct word once."""

    def __init__(self, lists: pa.Array):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = np.repeat(np.arange(len(lists)), sizes)
        words = coded.dictionary.to_pylist()
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.framed = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32)


def _term_sums(terms: Words, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Words and their four-character windows of ^word$: hashed once for each distinct word, then counted for each row."""
    n = len(terms.size)
    grams = np.maximum(terms.size - 1, 0)
    own = grams + 1
    at = np.cumsum(own) - own
    h = np.empty(int(own.sum()), dtype=np.uint32)
    value = np.empty(len(h))
    h[at] = hashes(_seed(fixed.WORD_SALT, n), terms.chars, terms.first, terms.size)
    value[at] = _signed(h[at], fixed.WORD_WEIGHT)
    rest = np.ones(len(h), dtype=bool)
    rest[at] = False
    start = np.repeat(terms.first + 2 * np.arange(n), grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    h[rest] = hashes(_seed(fixed.GRAM_SALT, len(start)), terms.framed, start, np.full(len(start), 4))
    value[rest] = _signed(h[rest], fixed.GRAM_WEIGHT)
    where = (h % fixed.DIMENSIONS).astype(np.int64)
    for a, b in _steps(own[terms.codes]):
        c = terms.codes[a:b]
        n_each = own[c]
        found = np.repeat(at[c] - (np.cumsum(n_each) - n_each), n_each) + np.arange(int(n_each.sum()))
        add(np.repeat(terms.rows[a:b], n_each), where[found], value[found])


def _pair_sums(words: Words, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Neighbouring words of a row as a~b: what a~ gives is known for each distinct word."""
    half = hashes(_seed(fixed.PAIR_SALT, len(words.size)), words.chars, words.first, words.size)
    half = (half ^ np.uint32(ord("~"))) * np.uint32(fixed.FNV_PRIME)
    a = np.flatnonzero(words.rows[1:] == words.rows[:-1])
    for i, j in _steps(words.size[words.codes[a + 1]]):
        left, right = words.codes[a[i:j]], words.codes[a[i:j] + 1]
        h = hashes(half[left], words.chars, words.first[right], words.size[right])
        add(words.rows[a[i:j]], (h % fixed.DIMENSIONS).astype(np.int64), _signed(h, fixed.PAIR_WEIGHT))


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries with about ``STEP`` of size in all, at least one entry."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, side="right")))
        yield a, b
        a = b


def embed_batch(words: pa.Array, terms: pa.Array) -> pa.Array:
    """The embeddings of a batch of texts from their raw words and their retrieval terms; null lists count as empty."""
    n, wide = len(words), fixed.DIMENSIONS
    sums = np.zeros((n, wide))

    def add(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> None:
        if len(rows):
            low, high = int(rows[0]), int(rows[-1]) + 1
            sums[low:high] += np.bincount((rows - low) * wide + buckets, weights=values, minlength=(high - low) * wide).reshape(-1, wide)

    _term_sums(Words(terms), add)
    _pair_sums(Words(words), add)
    # damped and of unit length, some rows at a time
    for i in range(0, n, 256):
        x = sums[i : i + 256] / MICRO
        x = np.sign(x) * np.log1p(np.abs(x))
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        sums[i : i + 256] = x / np.where(length > 0, length, 1.0)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide, type=pa.int32()), pa.array(sums.ravel()))


def embedding(text: Column) -> Column:
    """array<double> of ``DIMENSIONS``: the hashed embedding of a text, from words, their four-character windows and pairs of words; zeros for null and empty texts.

    Hashing goes character by character, so it runs in Arrow batches, for all words of a batch at once.
    """

    def run(words: pa.Array, terms: pa.Array) -> pa.Array:
        return embed_batch(words, terms)

    # a deterministic one is made twice where its array is exploded: once more before the scan is dealt out, for a filter by size
    return F.arrow_udf(run, "array<double>").asNondeterministic()(raw_words(text), tokenise(text))


def embed_rows(df: DataFrame, key: str, text: Column, out: str = "embedding") -> DataFrame:
    """``df`` with the hashed embedding of each row's text, made next to the scan: nothing is shuffled, and ``key`` may repeat."""
    return df.withColumn(out, embedding(text))
