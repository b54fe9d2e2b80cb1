"""Embedding whitening: principal components by matrix-free block subspace iteration over centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lectern.llm.common import checkpoint, fresh

COMPONENTS = 16
#: Directions of one pass; a basis of so many blocks starts anew from its best vectors.
BLOCK, BLOCKS = 24, 5
#: A component is certified by a residual of this share of the largest eigenvalue; eigenvalues under the second share count as zero.
TOLERANCE, RANK = 2e-14, 1e-12
#: An entry c becomes floor(SCALE * c) + OFFSET; entries of LARGEST or more count as non-finite.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 40)


@dataclass(frozen=True)
class Whitening:
    """What a fit found: n distinct vectors, per dimension a whole shift and the sum of what is above it, the components as columns, their eigenvalues and shares."""

    width: int
    n: int
    shift: np.ndarray
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(rows: DataFrame, vector_col: str, to: str) -> DataFrame:
    """``rows`` whose vector has finite entries only, and as ``to`` its entries as whole numbers."""
    c = F.transform(vector_col, lambda e: e.cast("double"))
    kept = rows.withColumn(to, c).filter(F.col(to).isNotNull() & F.forall(to, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < LARGEST), F.lit(False))))
    return kept.withColumn(to, F.transform(to, lambda e: F.floor(e * SCALE) + F.lit(OFFSET).cast("bigint")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _collect_sums(fit: DataFrame, width: int, columns: int, part) -> np.ndarray:
    """The sum over all partitions of what ``part`` makes of each batch, an array of so many columns: one partial array a task is shuffled."""
    names = [f"c{j}" for j in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0), width))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(total[:, j].copy()) for j in range(columns))], names=["i", *names])

    sums = fit.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*(F.sum(c).alias(c) for c in names))
    return np.array([r[1:] for r in sorted(map(tuple, sums.collect()))], dtype=float)


def moments(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            n += batch.num_rows
            # entries under 2 ** 46 in batches of under 2 ** 15 rows don't overflow
            for at in range(0, batch.num_rows, 1 << 15):
                total = [a + int(b) for a, b in zip(total, (_matrix(batch.column(0).slice(at, 1 << 15), width)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array([Decimal(v) for v in [*total, n]], type=pa.decimal128(38, 0))], names=["i", "v"])

    found = {r["i"]: int(r["v"]) for r in fit.mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    return found.get(width, 0), [found.get(i, 0) for i in range(width)]


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what of the block is outside ``basis``: QR twice, directions that vanish are left out."""
    block = block[:, np.linalg.norm(block, axis=0) > 0]
    block = block / np.linalg.norm(block, axis=0)
    for _ in range(3):
        block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def subspace_iteration(apply, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k largest eigenvalues, falling; their eigenvectors as columns) of a symmetric matrix of which only products ``apply(Q)`` are known.

    Each pass multiplies one block. Rayleigh-Ritz runs over all blocks so far; the next block is the QR of the residuals of the vectors
    wanted, so that few passes are needed where eigenvalues lie close. It ends when the residuals of all k vectors certify them, or the blocks span the
    whole space. A basis of BLOCKS blocks starts anew from its best vectors, whose products are known.
    """
    rng = np.random.default_rng(1)
    size = min(width, max(BLOCK, k + 8))
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    block = np.linalg.qr(rng.standard_normal((width, size)))[0]
    while True:
        basis, image = np.hstack([basis, block]), np.hstack([image, apply(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        values, ritz, moved = values[::-1], basis @ turn, image @ turn
        residuals = moved - ritz * values
        if basis.shape[1] >= width or (np.linalg.norm(residuals[:, :k], axis=0) <= TOLERANCE * max(abs(values[0]), 1e-300)).all():
            return values[:k], ritz[:, :k]
        if basis.shape[1] + size > BLOCKS * size:
            basis, image, residuals = ritz[:, : 2 * size], moved[:, : 2 * size], residuals[:, : 2 * size]
        block = orthonormal(residuals[:, :size], basis)
        if block.shape[1] < min(size, width - basis.shape[1]):
            extra = orthonormal(rng.standard_normal((width, size)), np.hstack([basis, block]))
            block = np.hstack([block, extra])[:, : min(size, width - basis.shape[1])]


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fitted on each distinct vector once; None where no vector is left. Vectors of another width than most (the smaller one at ties) are left out.

    The covariance is never formed: a pass sends one block of directions to the
    tasks, each adds up X'(XQ) over its centred rows, and the driver gets the sum, as many numbers as dimensions times
    directions.
    """
    p = fresh(rows, "_x")
    whole = whole_vectors(rows, vector_col, p).select(F.col(p).alias("x"))
    widths = whole.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).filter("width > 0")
    width = widths.agg(F.max_by("width", F.struct("n", -F.col("width")))).first()[0]
    if width is None:
        return None
    distinct = checkpoint(whole.filter(F.size("x") == width).distinct())
    n, total = moments(distinct, width)
    shift = np.array([s // n for s in total], dtype=np.int64)
    sums = tuple(s - n * int(m) for s, m in zip(total, shift, strict=True))
    centre = np.array([s / n for s in sums])
    centred = lambda x: (x - shift).astype(float) - centre

    trace = _collect_sums(distinct, width, 1, lambda x: (centred(x) ** 2).sum(axis=0)[:, None]).sum() / n

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            own = centred(x)
            return own.T @ (own @ q)

        return _collect_sums(distinct, width, q.shape[1], part) / n

    values, vectors = subspace_iteration(product, width, min(components, width))
    held = values > max(RANK * values[0], 0)
    values, vectors = values[held], vectors[:, held]
    # either sign will do; this one makes the largest entry positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0) if len(values) else vectors

    k, error = len(values), 0.0
    if k:

        def second(x: np.ndarray) -> np.ndarray:
            white = (centred(x) @ vectors) / np.sqrt(values)
            return np.vstack([white.T @ white, white.sum(axis=0)])

        found = _collect_sums(distinct, width, k, second) / n
        error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return Whitening(width, n, shift, sums, vectors, values, values / trace if trace > 0 else values, error)


def apply(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row with a vector and component: id, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation``: the exact sum over dimensions of (n * x - sum) ** 2, null where it does not fit a long. Components without variance can't
    be whitened and have no rows. Rows without a vector of the fit's width are left out; repeated rows get the same answer, null ids stay; further
    columns are ignored; an empty table gives an empty result.
    """
    p = fresh(rows, "_x")
    schema = StructType([StructField("id", rows.schema[id_col].dataType), StructField("component", IntegerType()), StructField("deviation", LongType()), StructField("whitened", DoubleType())])
    if model is None or not len(model.values):
        found = rows.sparkSession.createDataFrame([], schema)
    else:
        k, shift, centre, n = len(model.values), model.shift, model.centre(), model.n
        sums, turn = np.array(model.sums, dtype=object), model.vectors / np.sqrt(model.values)
        wide = max(model.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), model.width) - shift
                white = (x.astype(float) - centre) @ turn
                most = int(np.abs(x).max()) * n + wide
                if model.width * most * most < 1 << 63:
                    deviation = ((x * n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [int(v) for v in ((x.astype(object) * n - sums) ** 2).sum(axis=1)]
                at = np.repeat(np.arange(batch.num_rows), k)
                deviation = pa.array([v if v < 1 << 63 else None for v in deviation], type=pa.int64()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), deviation, pa.array(white.reshape(-1))], names=["id", "component", "deviation", "whitened"])

        whole = whole_vectors(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias(p)), p, f"{p}w").filter(F.size(f"{p}w") == model.width)
        found = whole.select("id", f"{p}w").mapInArrow(run, schema)
    shares: Column = F.array(*(F.lit(float(v)) for v in (model.explained if model else [])))
    return found.select(
        F.col("id").alias(id_col), "component", F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares.cast("array<double>"), F.col("component") - 1).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``apply`` with a fit on the same rows."""
    return apply(rows, fit(rows, vector_col, components), id_col, vector_col)
