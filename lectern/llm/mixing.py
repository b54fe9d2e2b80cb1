"""Mixing to target weights: soft domain membership and nonnegative document rates by projected-gradient least squares."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import give_back
from lectern.llm.common import checkpoint
from lectern.llm.sparse_text import ROWS_PER_CLASS, Lookup, all_forms, apply, choose, fit_softmax, holders, sample, style, words

#: Domains, in the order of the classes below, and the share of tokens that each is to have. By soft membership every
#: document counts a little for each domain, so no mix can have less of a domain than the smallest posterior says.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.89, "poor": 0.1, "toxic": 0.01}
#: Posteriors are given to this many decimals, so documents with equal ones can be solved for together.
DECIMALS = 3
#: What a change of rates weighs against the error of the totals, the share of the least squares by which they may be missed, and the share
#: of its target by which a domain's total may differ from the best one: roughly first, then to the end.
ROUNDS = ((1e-4, 1e-2, 0.03), (1e-6, 1e-2, 0.01), (1e-8, 1e-3, 1e-3))
#: Least squares that count as none.
NOTHING = 1e-15
#: Lengths tried of a step.
LENGTHS = (2.0, *(0.5**i for i in range(8)), *(0.25**i for i in range(4, 20)))
#: Values that a document's chance takes.
CHANCES = 1024


class DomainModel:
    """A fitted classifier: weights of words and style marks for each domain."""

    def __init__(self, labelled: list[tuple[str, int]], prior: np.ndarray | None = None):
        def parts(text: str) -> tuple[list[str], list[str]]:
            found = words(text)
            return found, style(text, found)

        y = np.array([k for _, k in labelled], dtype=int)
        n = np.bincount(y, minlength=len(DOMAINS)) if len(y) else np.zeros(len(DOMAINS))
        self.weights: dict[str, tuple[float, ...]] = {}
        self.bias = [0.0] * len(DOMAINS)
        if (n > 0).sum() > 1:
            held = holders((chain(all_forms(f), marks) for f, marks in (parts(t) for t, _ in labelled)), y, len(DOMAINS))
            chosen = choose(held, n, list(range(len(DOMAINS))))
            del held
            index, known = {w: i for i, w in enumerate(chosen)}, Lookup(frozenset(chosen))
            counts = []
            for text, _ in labelled:
                found, marks = parts(text)
                counts.append(known.of(found) + Counter(m for m in marks if m in index))
            w, b = fit_softmax(counts, y, index, len(DOMAINS))
            self.weights = {k: tuple(float(x) for x in w[:, i]) for k, i in index.items()}
            # the sample holds equally many of each class; the shares among all labels go back into the biases
            shift = np.log(np.maximum(prior, 1e-6)) - np.log(np.maximum(n / n.sum(), 1e-6)) if prior is not None else 0
            self.bias = [float(x) for x in b + shift]
        elif n.sum():
            self.bias = [0.0 if k else -30.0 for k in n > 0]
        self.known = Lookup(self.weights)
        give_back()

    def score(self, text: str, found: list[str]) -> tuple[float, ...]:
        weights = self.weights
        seen = self.known.of(found)
        seen.update(m for m in style(text, found) if m in weights)
        z = list(self.bias)
        for w in sorted(seen):
            x = math.log1p(seen[w])
            for k, v in enumerate(weights[w]):
                z[k] += v * x
        top = max(z)
        e = [math.exp(v - top) for v in z]
        p = [round(v / sum(e), DECIMALS) for v in e]
        return (round(1 - sum(p[1:]), DECIMALS), *p[1:])


def domain_class() -> Column:
    """Class of a label row: 2 toxic, 1 poor, 0 good; null without labels."""
    return F.when(F.col("toxic") > 0, 2).when(F.col("quality") == 0, 1).when(F.col("quality") > 0, 0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> DomainModel:
    """Fitted on a bounded sample, ``rows`` labelled documents of each class; class shares are counted over all labels."""
    of = {r["y"]: r["n"] for r in labels.groupBy(domain_class().alias("y")).agg(F.count(F.lit(1)).alias("n")).filter("y is not null").collect()}
    total = sum(of.values())
    prior = np.array([of.get(k, 0) / total for k in range(len(DOMAINS))]) if total else None
    return DomainModel(sample(docs, labels, domain_class(), rows=rows), prior)


def _rate(pull: list[float], whole: str | None, most: float | None) -> Column:
    """The rate that a document's posteriors get after the steps summed up in ``pull``: 1 less its gradient, brought back to nonnegative, and to ``most`` at most.

    Documents most likely of the domain ``whole`` stay at 1.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    rate = F.lit(1.0) - sum((p[k] * F.lit(pull[k]) for k in range(1, len(p))), p[0] * F.lit(pull[0]))
    rate = F.greatest(F.lit(0.0), rate if most is None else F.least(F.lit(float(most)), rate))
    return F.round(rate if whole is None else F.when(p[DOMAINS.index(whole)] >= 0.5, F.lit(1.0)).otherwise(rate), 6)


def _sums(cells: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of ``part`` (posteriors, tokens): so many numbers a task are shuffled, and so many reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size)
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(DOMAINS) + 1)]
            found += np.ravel(part(np.column_stack(columns[:-1]), columns[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(found)], names=["i", "v"])

    told = cells.select(*(f"p_{d}" for d in DOMAINS), "_t").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in told:
        out[r["i"]] = r["v"]
    return out


def fit_rates(cells: DataFrame, targets: dict[str, float] = TARGETS, whole: str | None = None, most: float | None = None) -> list[float]:
    """The sum of the steps, one number a domain: all that ``_rate`` needs.

    Least squares of the domains' expected token totals against their targets, over nonnegative
    rates (``most`` at most), by projected gradient from all rates 1, with distances
    of rates weighted by tokens. The gradient for a document depends on its posteriors
    alone, so documents with equal ones share a rate: ``cells`` (posteriors, ``_t`` tokens) has
    as many rows as posteriors of ``DECIMALS`` decimals allow. Steps are summed up, and their sum is projected, not each step for itself: so a rate is known from the sum
    alone, and of all rates that meet the targets those nearest to 1 are found. A domain's error is weighted by one over its curvature, or its target if that is larger;
    where all targets can be met, the weights don't matter.

    A step is scaled by the inverse curvature of the rates that no bound holds, and one distributed sum over the cells tries it in several lengths; the driver gets some numbers for each length.
    The change of rates counts too, a little (``ROUNDS``), which makes the problem strictly convex: the best length is the one with the largest lower bound of the least
    squares, and a round ends when the squares are that near to their lower bound, whether or not the targets can be met.
    """
    n = len(DOMAINS)
    top = math.inf if most is None else float(most)

    def tried(pulls: list[np.ndarray]) -> np.ndarray:
        """For each sum of steps, per token: the sum of rate * (start - rate / 2) and of (rate - 1)^2, where start is the rate before it is projected; the domains' totals; the curvature of the rates that move."""

        def part(p: np.ndarray, t: np.ndarray) -> np.ndarray:
            held = np.zeros(len(p), dtype=bool) if whole is None else p[:, DOMAINS.index(whole)] >= 0.5
            rows = []
            for pull in pulls:
                start = 1 - p @ pull
                rate = np.where(held, 1.0, np.clip(start, 0.0, top))
                moves = t * (~held & (start > 0) & (start < top))
                rows.append([t @ (rate * (start - rate / 2)), t @ (rate - 1) ** 2, *((t * rate) @ p), *np.ravel((p * moves[:, None]).T @ p)])
            return np.array(rows)

        return _sums(cells, part, len(pulls) * (2 + n + n * n)).reshape(len(pulls), -1) / total

    first = _sums(cells, lambda p, t: np.append(np.ravel((p * t[:, None]).T @ p), [t @ p[:, k] for k in range(n)] + [t.sum()]), n * n + n + 1)
    total = float(first[-1])
    pull = np.zeros(n)
    if not total:
        return pull.tolist()
    now, curve = first[n * n : -1] / total, first[: n * n].reshape(n, n) / total
    # as many tokens as there are, or as many as make the domain that is whole its share
    size = 1.0 if whole is None or now[DOMAINS.index(whole)] <= 0 else now[DOMAINS.index(whole)] / targets[whole]
    want = np.array([targets[d] for d in DOMAINS]) * size
    weight = 1 / np.maximum(np.maximum(np.diag(curve), want), 1e-9)
    before = ROUNDS[0][0]
    for change, share, off in ROUNDS:
        # where targets are missed, the sum grows as a change of rates weighs less; where they are met, it stays
        pulls, low = [pull, pull * (before / change)], -math.inf
        while True:
            found = tried(pulls)
            bounds = [change * (0.5 - r[0] - want @ x - change / 2 * (x * x / weight).sum()) for r, x in zip(found, pulls, strict=True)]
            best = int(np.argmax(bounds))
            if not bounds[best] > low:
                break
            low, pull, totals, curve = bounds[best], pulls[best], found[best][2 : 2 + n], found[best][2 + n :].reshape(n, n)
            squares = float(weight @ (totals - want) ** 2 + change * found[best][1]) / 2
            # the squares are strongly convex in the totals, so the bound tells how far these are from the best ones
            if squares - low <= max(NOTHING, min(share * squares, float((weight * (off * want) ** 2).min()) / 2)):
                break
            step = np.linalg.solve(curve + change * np.diag(1 / weight), totals - want - change * pull / weight)
            pulls = [pull + step * x for x in LENGTHS]
        before = change
    return [float(x) for x in pull]


def _chance(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(CHANCES)).cast("int")


def _likeliest() -> Column:
    """Number of the domain with the largest posterior, the first one at ties."""
    return F.array_position(F.array(*(F.col(f"p_{d}") for d in DOMAINS)), F.greatest(*(F.col(f"p_{d}") for d in DOMAINS))).cast("int") - 1


def _due(rate: Column, chance: Column) -> Column:
    """Steps of chance by which a document must be helped to get one copy more than its rate's whole part; null for whole rates."""
    part = rate - F.floor(rate)
    return F.when(part > 1e-9, F.floor((1 - part) * CHANCES - chance - 0.5).cast("int"))


def fit_shifts(fine: DataFrame, rate: Column) -> list[int]:
    """For each domain, the help that documents most likely of it get when rates become copies, so that their copies' tokens come to what their rates say.

    ``fine``: posteriors, ``_chance``, ``_t``. The driver gets at most ``2 * CHANCES`` sums a domain.
    """
    part = rate - F.floor(rate)
    sums = fine.withColumns({"_k": _likeliest(), "_due": _due(rate, F.col("_chance")), "_e": F.col("_t") * part}).filter("_due is not null").groupBy("_k", "_due").agg(F.sum("_t").alias("t"), F.sum("_e").alias("e")).collect()
    shifts = []
    for k in range(len(DOMAINS)):
        own = sorted((r["_due"], r["t"], r["e"]) for r in sums if r["_k"] == k)
        left = sum(e for _, _, e in own)
        # documents due before the shift get their copy: add them while that brings the total nearer
        shift = own[0][0] if own else 0
        for due, t, _ in own:
            if abs(left - t) >= abs(left):
                break
            left, shift = left - t, due + 1
        shifts.append(shift)
    return shifts


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float] = TARGETS, whole: str | None = None, max_copies: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, posteriors ``p_good`` ..., ``rate``, ``copies``.

    The targets are shares of tokens (words of whole texts) in a mix of as many
    tokens as ``docs`` has. ``whole`` names a domain that is taken whole instead: its likeliest documents have a rate of 1, and the
    mix is as large as makes that its share. A rate becomes a number of copies: its whole part, and one more with the
    probability of its fraction, by a hash of the id; one shift for each domain then makes up for chance, so that the copies' tokens come to what
    the rates say, as near as single documents allow.
    ``max_copies`` bounds the rates while they are solved for, so that the others make up for it as far as they can; targets
    that need more are then missed. Null text counts as empty; such documents have no tokens, a
    rate as their posteriors say, and weigh nothing. Repeated rows get the same
    answer; a null id hashes like any other; of domains equally likely for a document the first one counts; an empty table gives an empty
    result; further columns of ``docs`` are left out, or with ``carry`` kept, the
    new ones replacing those of the same name (texts are then scored twice
    rather than shuffled). Without labels all domains
    are equally likely for all documents, and all get one rate.
    """
    names = [f"p_{d}" for d in DOMAINS]
    scored = apply(docs, id_col, text_col, names, model.score)
    scored = scored if carry else checkpoint(scored)
    fine = checkpoint(scored.groupBy(*names, _chance(id_col).alias("_chance")).agg(F.sum("n_words").cast("double").alias("_t")))
    pull = fit_rates(checkpoint(fine.groupBy(*names).agg(F.sum("_t").alias("_t"))), targets, whole, max_copies)
    rate = _rate(pull, whole, max_copies)
    shifts = F.array(*map(F.lit, fit_shifts(fine, rate)))
    scored = apply(docs, id_col, text_col, names, model.score, carry=True) if carry else scored
    more = F.coalesce(_due(F.col("rate"), _chance(id_col)) < F.get(shifts, _likeliest()), F.lit(False))
    return scored.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + more.cast("int")).cast("int"))
