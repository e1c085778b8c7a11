"""Whitening of embeddings by spectral divide and conquer.

The covariance of all usable vectors is summed on the executors. Its eigenvectors are found by
splitting: the polar factor of the covariance less a shift, computed by dynamically weighted Halley
iterations with QR factors, has eigenvalues of plus and minus one, and (factor + identity) / 2 projects
on the components above the shift. Orthonormal bases of both subspaces turn the matrix into two
smaller ones, which are split in the same way until single components are left. Mean and projection are
broadcast, d rows of at most ``COMPONENTS`` numbers, and all vectors are whitened where they are.

Entries are numbers c; what counts is floor(1024 c) + 100,000. Rows whose vector is null, empty or holds
a null, a non-finite entry or one of 2^53 / 1024 or more drop out, and so do vectors that are not of the commonest
length (of equally common ones the largest). A component without variance has no whitened value, and
``deviation`` is null where it is beyond 64 bits. An empty table gives no rows; repeated rows count and
come out each; other columns do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import show_package

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 53) / SCALE
# A component with less than this share of the largest variance has none.
NO_VARIANCE = 1e-12
ROWS = 8192  # vectors handled at once


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH.

    The weights follow a lower bound of the smallest singular value, which the machine's precision gives.
    """
    m = len(a)
    x = a / np.linalg.norm(a)
    low = np.finfo(float).eps / math.sqrt(m)
    identity = np.eye(m)
    for _ in range(30):
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = math.sqrt(1 + d)
        first = root + math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        q = np.linalg.qr(np.vstack([math.sqrt(third) * x, identity]))[0]
        ratio = second / third
        after = ratio * x + (first - ratio) / math.sqrt(third) * (q[:m] @ q[m:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x = after
        low = min(1.0, low * (first + second * square) / (1 + third * square))
        if moved < 1e-15 * m or (1 - low < 1e-15 and moved < 1e-12):
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal matrix whose first ``rank`` columns span what the projector keeps."""
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    q = np.linalg.qr(projector[:, order[:rank]], mode="complete")[0]
    # One step of subspace iteration takes out what rounding has left.
    return np.linalg.qr(projector @ q[:, :rank], mode="complete")[0]


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """A basis in which the matrix falls into two parts, and the size of the first; None if all its values are equal."""
    m = len(a)
    size = np.linalg.norm(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m))
    if spread <= 4 * np.finfo(float).eps * size:
        return None
    best = None
    # The mean lies between the smallest and the largest value; shifts beside it serve if a value is too near.
    for shift in (float(np.median(np.diag(a))), mean, *(mean + spread / m * s for s in (0.13, -0.13, 0.37, -0.37))):
        projector = (polar_factor(a - shift * np.eye(m)) + np.eye(m)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < m:
            continue
        basis = _bases(projector, rank)
        left = np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank])
        if best is None or left < best[2]:
            best = basis, rank, left
        if left <= 4 * m * np.finfo(float).eps * size:
            break
    return None if best is None else best[:2]


def _components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(a) == 1:
        return a[0].copy(), np.eye(1)
    split = _split(a)
    if split is None:
        return np.diag(a).copy(), np.eye(len(a))
    basis, rank = split
    values, vectors = [], []
    for part in (basis[:, :rank], basis[:, rank:]):
        inner = part.T @ a @ part
        e, v = _components((inner + inner.T) / 2)
        values.append(e)
        vectors.append(part @ v)
    return np.concatenate(values), np.hstack(vectors)


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    A second division, of the matrix in the basis found, takes out the rounding of the first.
    """
    if not len(a) or not np.any(a):
        return np.zeros(len(a)), np.eye(len(a))
    _, first = _components(a)
    near = first.T @ a @ first
    values, second = _components((near + near.T) / 2)
    vectors = np.linalg.qr(first @ second)[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    """What the vectors are whitened with. ``sums`` are exact; ``values`` fall."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums.tolist()])

    @property
    def used(self) -> int:
        return min(COMPONENTS, len(self.values))

    @property
    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return self.values[: self.used] / total if total > 0 else np.zeros(self.used)

    @property
    def varied(self) -> np.ndarray:
        """Which of the components used have variance."""
        used = self.values[: self.used]
        return used > NO_VARIANCE * max(self.values[0], 0) if len(used) else np.zeros(0, bool)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        root = np.sqrt(np.where(self.varied, self.values[: self.used], np.nan))
        return (x - self.mean) @ self.vectors[:, : self.used] / root

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact."""
        sums = self.sums.tolist()
        largest = max((abs(self.n * int(e) - s) for column, s in zip(x.T, sums) for e in (column.min(), column.max())), default=0)
        if largest * largest * max(1, len(sums)) < 1 << 63:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * e - s) ** 2 for e, s in zip(row, sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def usable(rows: DataFrame, column: str) -> DataFrame:
    """``id`` and ``vector``, an array of doubles, of the rows that remain."""
    sound = F.forall(
        column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(LARGEST))
    )
    known = rows.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(sound)
    return known.select("id", F.col(column).cast("array<double>").alias("vector"))


def _matrix(vectors: pa.Array, length: int) -> np.ndarray:
    return np.floor(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length) * SCALE).astype(np.int64) + OFFSET


def _parts(batches, length):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _matrix(part.column("vector"), length)


def _added(rows: DataFrame, function, length: int, size: int) -> list[float]:
    """The sum over all vectors of a function that gives ``size`` numbers for a matrix of vectors."""

    def run(batches):
        total = None
        for _, x in _parts(batches, length):
            values = function(x)
            total = values if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "value"])

    kind = "bigint" if function is _sums else "double"
    sums = rows.select("vector").mapInArrow(run, f"at bigint, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    return [r["value"] for r in sorted(sums.collect())]


def _sums(x: np.ndarray) -> np.ndarray:
    return np.append(x.sum(axis=0), len(x))


def fit(vectors: DataFrame, length: int) -> Whitening | None:
    """From the rows of ``usable`` with vectors of that length; None if there are none."""
    sums = _added(vectors, _sums, length, length + 1)
    if not sums:
        return None
    n, sums = sums[-1], np.array(sums[:-1], np.int64)
    mean = np.array([s / n for s in sums.tolist()])
    upper = np.triu_indices(length)

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return (centred.T @ centred)[upper]

    covariance = np.zeros((length, length))
    covariance[upper] = np.array(_added(vectors, products, length, len(upper[0]))) / n
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    return Whitening(n, sums, *components(covariance))


def identity_error(vectors: DataFrame, length: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured on all of them."""
    varied = np.flatnonzero(model.varied)
    if not len(varied):
        return 0.0
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(varied)

    def moments(x: np.ndarray) -> np.ndarray:
        z = shared.value.whitened(x)[:, varied]
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    moved = np.array(_added(vectors, moments, length, k + k * k)) / model.n
    covariance = moved[k:].reshape(k, k) - np.outer(moved[:k], moved[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """Per row that remains and component: ``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    show_package(rows)
    vectors = usable(rows.select(F.col(id_col).alias("id"), F.col(column).alias("vector_")), "vector_")
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = vectors.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    length = lengths["length"]
    vectors = vectors.where(F.size("vector") == length)
    model = fit(vectors, length)
    error = identity_error(vectors, length, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        k = model.used
        for part, x in _parts(batches, length):
            z = model.whitened(x)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            values = pa.array(z.ravel(), mask=np.isnan(z).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(at),
                    values,
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)


def report(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings, "vec_id", "embedding").withColumnRenamed("id", "vec_id")
