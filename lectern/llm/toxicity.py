"""Toxicity: cumulative-link ordinal regression on sparse word features gives severity grades and expected severity."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import give_back
from lectern.llm.sparse_text import ROWS_PER_CLASS, SIGNIFICANCE, Lookup, all_forms, apply, chance, choose, fit_ordinal, holders, sample, words

#: Grades 0 (clean) to 3; a document is rejected if it has grade 1 or more with at least this probability.
GRADES, REJECT = 4, 0.35
#: A word of the sample counts as evidence from this log odds on, in so many toxic documents.
EVIDENCE_ODDS, EVIDENCE_DOCS = 2.0, 3


def grades_of(texts: list[str], toxic: np.ndarray, held: list[list[Counter]]) -> np.ndarray:
    """Severity of each labelled document: 0 if not toxic, else 1 to 3 by thirds of how many evidence words it holds.

    The labels are yes or no; how severe a toxic text is, is read from the words
    that set toxic documents apart. Those are found in the other half of the sample, so no document's grade comes from words that it made evidence itself.
    ``held``: for each half, how many documents of either class hold each feature.
    """
    half = np.arange(len(texts)) % 2
    count = np.zeros(len(texts))
    for side in (0, 1):
        outside, inside = held[1 - side]
        n, m = int(toxic[half != side].sum()), int((1 - toxic[half != side]).sum())
        strong = {w for w, c in inside.items() if c >= EVIDENCE_DOCS and math.log((c + 0.5) / (n + 1)) - math.log((outside[w] + 0.5) / (m + 1)) >= EVIDENCE_ODDS and chance(c, c + outside[w], n / (n + m)) <= math.log(SIGNIFICANCE)}
        for i in np.flatnonzero((half == side) & (toxic == 1)):
            count[i] = sum(f in strong for f in all_forms(words(texts[i])))
    cuts = np.quantile(count[toxic == 1], [1 / 3, 2 / 3]) if toxic.any() else np.zeros(2)
    return np.where(toxic == 1, 1 + (count > cuts[0]).astype(int) + (count > cuts[1]).astype(int), 0)


class Severity:
    """A fitted model: weights of words, thresholds of grades."""

    def __init__(self, labelled: list[tuple[str, int]]):
        texts, toxic = [t for t, _ in labelled], np.array([y for _, y in labelled], dtype=int)
        self.weights: dict[str, float] = {}
        self.cuts: list[float] = []
        if 0 < toxic.sum() < len(toxic):
            halves = [holders((all_forms(words(t)) for t in texts[k::2]), toxic[k::2], 2) for k in (0, 1)]
            y = grades_of(texts, toxic, halves)
            chosen = choose([halves[0][k] + halves[1][k] for k in (0, 1)], np.bincount(toxic, minlength=2), [1])
            index, known = {w: i for i, w in enumerate(chosen)}, Lookup(frozenset(chosen))
            w, cuts = fit_ordinal([known.of(words(t)) for t in texts], y, index, GRADES)
            self.weights = {k: float(w[i]) for k, i in index.items()}
            self.cuts = [float(c) for c in cuts]
        self.known = Lookup(self.weights)
        give_back()

    def score(self, _: str, found: list[str]) -> tuple[float, ...]:
        """P(grade >= 1), P(grade >= 2), ... ; zeros from a model that had nothing to learn from."""
        if not self.cuts:
            return (0.0,) * (GRADES - 1)
        weights = self.weights
        seen = self.known.of(found)
        # summed in order of the words, so that equal counts give equal sums
        f = sum(weights[w] * math.log1p(seen[w]) for w in sorted(seen))
        return tuple(1 / (1 + math.exp(min(700.0, c - f))) for c in self.cuts)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> Severity:
    """Fitted on a bounded sample: ``rows`` labelled documents of each class, see ``sample``."""
    return Severity(sample(docs, labels, F.when(F.col("toxic") > 0, 1).when(F.col("toxic").isNotNull(), 0), rows=rows))


def grade_toxicity(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``p_1`` to ``p_3`` (probability of that grade or more), ``severity``, ``grade``, ``rejected``.

    ``severity`` is the expected grade, ``grade`` the most severe one reached with
    probability one half. Whole texts; null counts as empty and has the score of a
    text without known words; repeated rows are graded each; an empty table gives
    an empty result; further columns of ``docs`` are left out, or with ``carry``
    kept, the new ones replacing those of the same name. A model fitted on no
    labels, or on one class only, rejects nothing. The model is bounded, and the
    scan needs no shuffle.
    """
    names = [f"p_{k}" for k in range(1, GRADES)]
    scored = apply(docs, id_col, text_col, names, model.score, carry)
    total = lambda cols: sum(cols[1:], cols[0])
    return scored.withColumns(
        {
            "severity": F.round(total([F.col(n) for n in names]), 6),
            "grade": total([(F.col(n) >= 0.5).cast("int") for n in names]),
            "rejected": F.col("p_1") >= REJECT,
            **{n: F.round(n, 6) for n in names},
        }
    )
