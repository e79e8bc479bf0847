"""Embedding whitening from a covariance taken in two passes.

Entries become whole numbers, x = floor(scale * c) + offset. The first pass adds up the x exactly, whatever their size, so
the mean S/n is known as whole part and remainder. The second pass centres each vector with these, so the offset cancels
before anything is multiplied, and adds up outer products by matrix products, one for a slice of rows; partial sums are
merged by treeAggregate. The covariance has the size of one vector squared, whatever the number of rows; LAPACK's symmetric
solver gives its eigenvectors in the driver, and a projection of at most `components` columns goes to the tasks. A third
pass takes the covariance of the whitened vectors themselves, to report how far it is from the identity.

Defined results: a vector that is null, empty or holds a null or non-finite entry is left out, as is one whose length
isn't the commonest (of equally common lengths the longer); null ids and repeated rows are rows like any other. Entries out of
the range of +-2^61 are taken as these bounds. Components whose variance is lost in rounding (under 1e-11 of the largest,
as with fewer rows than entries, or equal vectors only) can't be scaled to 1 and are not returned; an empty table gives an
empty result. Other columns are kept; those with the names of the two results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .vectors import extent, slices, tree_sum

LIMIT = float(2**61)
#: Variances under this share of the largest are rounding.
LEAST = 1e-11


@dataclass
class Whitening:
    scale: float
    offset: int
    n: int
    whole: np.ndarray  # floor(S / n), long
    rest: list[int]  # S - n * whole
    projection: np.ndarray  # entries x components, divided by the roots of the eigenvalues
    variances: np.ndarray  # falling
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of the mean, exactly, and x less the mean."""
        y = whole_numbers(rows, self.scale, self.offset) - self.whole
        return y, y - np.array([r / self.n for r in self.rest])

    def deviations(self, y: np.ndarray) -> list[int] | np.ndarray:
        """The sums of (n * x - S)^2, exact: n * x - S is n * y - rest, whose square is taken apart so that longs hold it."""
        most, high, dims = int(np.abs(y).max(initial=0)), max(self.rest, default=0), y.shape[1]
        fits = max(most * most, most * high) * dims < 2**62
        z, rest = (y, np.array(self.rest, np.int64)) if fits else (y.astype(object), np.array(self.rest, object))
        squares, crossed, constant = (z * z).sum(axis=1), z @ rest, sum(r * r for r in self.rest)
        if fits and self.n * self.n * max(most * most * dims, 1) + 2 * self.n * most * high * dims + constant < 2**62:
            return self.n * self.n * squares - 2 * self.n * crossed + constant
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + constant for a, b in zip(squares, crossed, strict=True)]


def whole_numbers(rows: np.ndarray, scale: float, offset: int) -> np.ndarray:
    return np.clip(np.floor(scale * rows), -LIMIT, LIMIT).astype(np.int64) + offset


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns as whole numbers of any size, by halves of the longs."""
    low, high = (x & (2**31 - 1)).sum(axis=0), (x >> 31).sum(axis=0)
    return high.astype(object) * 2**31 + low.astype(object)


def fit(rows: DataFrame, *, vector_col: str = "embedding", scale: float = 64.0, offset: int = 1_000_000, components: int = 32) -> Whitening:
    """Mean, covariance and projection of all usable vectors."""
    rows = rows.select(vector_col)
    dims, _ = extent(rows, vector_col)
    none = Whitening(scale, offset, 0, np.zeros(dims, np.int64), [0] * dims, np.zeros((dims, 0)), np.zeros(0), np.zeros(0))
    if not dims:
        return none

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.array([0] * (dims + 1), object)
        for _, m, _ in slices(batches, vector_col, dims):
            total = total + np.concatenate([np.array([len(m)], object), column_sums(whole_numbers(m, scale, offset))])
        return total

    n, *by_entry = map(int, tree_sum(rows, sums))
    mean = Whitening(scale, offset, n, np.array([s // n for s in by_entry], np.int64), [s % n for s in by_entry], none.projection, none.variances, none.explained)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((dims, dims))
        for _, m, _ in slices(batches, vector_col, dims):
            _, z = mean.centred(m)
            total += z.T @ z
        return total

    covariance = tree_sum(rows, products) / n
    variances, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    variances, vectors = variances[::-1], vectors[:, ::-1]
    k = int(min(components, (variances > LEAST * max(variances[0], 0)).sum()))
    trace = float(np.trace(covariance))
    model = Whitening(scale, offset, n, mean.whole, mean.rest, vectors[:, :k] / np.sqrt(variances[:k]), variances[:k], variances[:k] / trace if k else none.explained)

    def whitened(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for _, m, _ in slices(batches, vector_col, dims):
            w = model.centred(m)[1] @ model.projection
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        return total

    if k:
        total = tree_sum(rows, whitened) / n
        model.identity_error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Whitening, *, vector_col: str = "embedding", out: str = "whitened", deviation_col: str = "deviation") -> DataFrame:
    """The rows with usable vectors, all columns, with the whitened vector (array of doubles) and the exact sum of (n * x - S)^2
    over its entries (decimal(38,0)); without a shuffle."""
    dims = len(model.whole)
    rows = rows.drop(out, deviation_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField(deviation_col, T.DecimalType(38, 0))])
    if not model.n:
        return rows.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m, at in slices(batches, vector_col, dims):
            y, z = model.centred(m)
            w = z @ model.projection
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            exact = model.deviations(y)
            exact = pa.array(exact).cast(pa.decimal128(38, 0)) if isinstance(exact, np.ndarray) else pa.array([Decimal(x) for x in exact], pa.decimal128(38, 0))
            columns = part.take(pa.array(at)).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel())), exact], names=schema.names)

    return rows.mapInArrow(project, schema)
