"""Sparse text features, the bounded labelled sample that models are fitted on, and the fits themselves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lectern.llm.arrow import Memory, pieces
from lectern.llm.bag_minhash import bags, signatures, word_hashes
from lectern.llm.common import checkpoint

#: Labelled rows of each class that a fit reads at most, and the characters that such a row may have.
ROWS_PER_CLASS, ROW_CHARS = 3000, 20_000
#: Classes of labels at most; more are an error.
MOST_CLASSES = 64
#: Features of a model at most, and documents of the sample that must hold one.
FEATURES, MIN_DOCS, LEAST_ODDS = 2000, 3, 1.5
#: Probability, at most, that a feature is in so many documents of a class by chance.
SIGNIFICANCE = 1e-4
#: One over the variance of an ordinal model's weights before it has seen any row.
PRIOR = 0.1
#: Registers of the signatures that tell near copies in the sample, and registers in a band of them.
COPY_REGISTERS, COPY_ROWS = 40, 5
#: Rows that are signed at once.
COPY_BATCH = 200
_WORDS = re.compile(r"[^\W\d_]+").findall
_SYMBOLS = "#*$%&|<>"


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def forms(word: str) -> tuple[str, ...]:
    """A word's features: itself and, for what is built on its stem, its first five letters."""
    return (word, f"{word[:5]}-") if len(word) > 5 else (word,)


class Lookup(Memory):
    """The known features of words; most have none."""

    def __init__(self, known: object):
        super().__init__(lambda w: tuple(f for f in forms(w) if f in known), 100_000)

    def of(self, found: list[str]) -> Counter:
        get = self.__getitem__
        return Counter([f for fs in map(get, found) if fs for f in fs])


def all_forms(found: list[str]) -> Iterator[str]:
    return (f for w in found for f in forms(w))


def style(text: str, found: list[str]) -> list[str]:
    """Marks for how a text is written: each measure cut into steps, with names that no word has."""
    size, n = max(len(text), 1), max(len(found), 1)
    symbols = sum(map(text.count, _SYMBOLS)) / size
    shouted = sum(map(str.isupper, text.split())) / n
    distinct = len(set(found)) / n
    step = lambda x, cuts: sum(x > c for c in cuts)
    return [
        f"<symbols {step(symbols, (0.005, 0.02, 0.05, 0.15))}>",
        f"<shouted {step(shouted, (0.1, 0.3, 0.6))}>",
        f"<distinct {step(distinct, (0.1, 0.2, 0.35, 0.5, 0.7))}>",
        f"<bars {step(text.count('|') / n, (0.02, 0.1, 0.3))}>",
        f"<marks {step(text.count('!') / n, (0.05, 0.2, 0.5))}>",
        f"<words {step(len(found), (5, 15, 30, 50, 100, 1000))}>",
    ]


def sample(docs: DataFrame, labels: DataFrame, classes: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS_PER_CLASS, chars: int = ROW_CHARS) -> list[tuple[str, int]]:
    """(text, class) of at most ``rows`` labelled documents of each class: of those whose text has at most ``chars`` characters, those with the smallest hashes of their ids.

    ``classes`` gives a class from the columns of ``labels``, null for rows without
    one. This bounds what the driver reads: one row for an id and class, the smallest text where an id repeats; in order of id and text, so the
    fit is the same every time. Of near copies among them one is given. Only ids are shuffled, and of them only about three times as many as are picked go on to be sorted.
    """
    marked = labels.select(F.col(id_col).alias("_id"), classes.cast("int").alias("_y")).filter("_id is not null and _y is not null").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).filter(F.length("_text") <= chars)
    fit = checkpoint(marked.join(texts.select("_id").distinct(), "_id", "left_semi"))
    picks = None
    found = fit.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"labels have more than {MOST_CLASSES} classes")
    for y, n in sorted((r["_y"], r["n"]) for r in found):
        part = fit.filter(F.col("_y") == y)
        if n > 4 * rows:
            part = part.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 32)) < F.lit(int(3 * rows / n * (1 << 32))))
        part = part.orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 32)), "_id").limit(rows)
        picks = part if picks is None else picks.unionByName(part)
    if picks is None:
        return []
    found = texts.join(F.broadcast(picks), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    return once([(r["_text"], r["_y"]) for r in sorted(found, key=lambda r: (r["_id"], r["_text"], r["_y"]))])


def once(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """``rows`` with one of each group of near copies, the first: what copies share would pass for what a class shares."""
    seen: set[tuple[int, bytes]] = set()
    out = []
    for start in range(0, len(rows), COPY_BATCH):
        part = rows[start : start + COPY_BATCH]
        signed = signatures(*bags([word_hashes(t) for t, _ in part]), len(part), registers=COPY_REGISTERS)
        for row, registers in zip(part, signed, strict=True):
            keys = {(k, registers[k : k + COPY_ROWS].tobytes()) for k in range(0, COPY_REGISTERS, COPY_ROWS)}
            if not keys & seen:
                out.append(row)
            seen |= keys
    return out


def matrix(counts: list[Counter], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of log(1 + count) of each document's known features."""
    at = [(i, index[w], c) for i, x in enumerate(counts) for w, c in x.items() if w in index]
    row, col, val = (np.array([a[k] for a in at], dtype=t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
    return row, col, np.log1p(val)


def chance(c: int, of: int, share: float) -> float:
    """Upper bound of the logarithm of the probability that c or more of the documents that hold a feature are of a class with that share, if the feature knew nothing of it."""
    rate = c / of
    if rate <= share:
        return 0.0
    rest = (1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0
    return -of * (rate * np.log(rate / share) + rest)


def holders(features: Iterable[Iterable[str]], classes: Iterable[int], n: int) -> list[Counter]:
    """For each of n classes, how many documents hold each feature, from the features of one document after the other: none is kept."""
    out = [Counter() for _ in range(n)]
    for held, y in zip(features, classes, strict=True):
        out[y].update(set(held))
    return out


def choose(held: list[Counter], sizes: np.ndarray, classes: list[int], features: int = FEATURES) -> list[str]:
    """The features with ``LEAST_ODDS`` or more smoothed log odds for one of ``classes`` against the rest that are unlikely by chance; the best by odds times the root of their documents.

    ``held`` and ``sizes``: documents of each class that hold a feature, and all. Features that say little are left out: in long texts their many small weights would outweigh the few that count.
    What counts as chance follows the sizes of the classes (Chernoff's bound of a binomial tail).
    """
    scores: dict[str, float] = {}
    for k in classes:
        n, out = int(sizes[k]), int(sizes.sum() - sizes[k])
        others = [h for j, h in enumerate(held) if j != k]
        for w, c in held[k].items():
            if c >= MIN_DOCS:
                rest = sum(h[w] for h in others)
                odds = np.log((c + 0.5) / (n + 1)) - np.log((rest + 0.5) / (out + 1))
                if odds >= LEAST_ODDS and chance(c, c + rest, n / (n + out)) <= np.log(SIGNIFICANCE):
                    scores[w] = max(scores.get(w, 0.0), odds * np.sqrt(c))
    return sorted(sorted(scores, key=lambda w: (-scores[w], w))[:features])


def _sums(row: np.ndarray, col: np.ndarray, val: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=val * w[col], minlength=n)


def fit_ordinal(counts: list[Counter], y: np.ndarray, index: dict[str, int], grades: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of P(y >= k) = sigmoid(w.x - t_k): one weight vector for all thresholds, which stay in order.

    Thresholds are kept in order as a first value and positive steps; Adam on the mean log likelihood with an L2 penalty
    as of a normal prior of the weights with variance 1 / ``PRIOR``, which counts for less the more rows there are.
    """
    n, m = len(counts), len(index)
    l2 = PRIOR / max(n, 1)
    row, col, val = matrix(counts, index)
    theta = np.zeros(m + grades - 1)
    theta[m] = 0.5
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for i in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[m : m + 1], np.exp(theta[m + 1 :])]))
        f = _sums(row, col, val, theta[:m], n)
        p = np.hstack([np.ones((n, 1)), sigmoid(f[:, None] - cuts), np.zeros((n, 1))])
        own = np.maximum(p[np.arange(n), y] - p[np.arange(n), y + 1], 1e-12)
        slope = p * (1 - p)
        df = (slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / own
        grad = np.zeros_like(theta)
        grad[:m] = -np.bincount(col, weights=val * df[row], minlength=m) / n + l2 * theta[:m]
        dcut = np.zeros((n, grades + 1))
        dcut[np.arange(n), y] -= slope[np.arange(n), y] / own
        dcut[np.arange(n), y + 1] += slope[np.arange(n), y + 1] / own
        by_cut = -dcut[:, 1:grades].sum(axis=0) / n
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad[m] = tail[0]
        grad[m + 1 :] = tail[1:] * np.exp(theta[m + 1 :])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta -= 0.1 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-8)
    return theta[:m], np.cumsum(np.concatenate([theta[m : m + 1], np.exp(theta[m + 1 :])]))


def fit_softmax(counts: list[Counter], y: np.ndarray, index: dict[str, int], classes: int, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(weights by class, biases) of a multinomial logistic regression; Adam on the mean log likelihood with an L2 penalty."""
    n, m = len(counts), len(index)
    row, col, val = matrix(counts, index)
    w, b = np.zeros((classes, m)), np.zeros(classes)
    target = np.eye(classes)[y]
    moments = [np.zeros((classes, m + 1)) for _ in range(2)]
    for i in range(1, steps + 1):
        z = np.stack([_sums(row, col, val, w[k], n) + b[k] for k in range(classes)], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) / n
        grad = np.stack([np.append(np.bincount(col, weights=val * d[row, k], minlength=m) + l2 * w[k], d[:, k].sum()) for k in range(classes)])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        step = 0.05 * (moments[0] / (1 - 0.9**i)) / (np.sqrt(moments[1] / (1 - 0.999**i)) + 1e-8)
        w, b = w - step[:, :m], b - step[:, m]
    return w, b


def apply(docs: DataFrame, id_col: str, text_col: str, names: list[str], score: object, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words`` and the doubles that ``score(text, words)`` gives, over whole texts, without a shuffle.

    With ``carry``, all columns of ``docs`` instead of the id; the new ones replace any of the same name.
    """
    new = ["n_words", *names]
    rows = docs.drop(*new) if carry else docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    kept = StructType(rows.schema.fields if carry else rows.schema.fields[:1])
    schema = StructType([*kept.fields, StructField("n_words", LongType()), *(StructField(n, DoubleType()) for n in names)])
    text = text_col if carry else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            sizes, out = [], []
            for t in texts:
                found = words(t)
                sizes.append(len(found))
                out.append(score(t, found))
            cols = [pa.array(sizes, type=pa.int64()), *(pa.array([o[k] for o in out], type=pa.float64()) for k in range(len(names)))]
            n = len(kept.fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *cols], names=[*batch.schema.names[:n], *new])

    scored = rows.mapInArrow(run, schema)
    return scored if carry else scored.withColumnRenamed("_id", id_col)
