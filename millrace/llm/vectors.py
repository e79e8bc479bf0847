"""What the operators on embeddings share: usable vectors as matrices, and sums merged by a tree."""

from __future__ import annotations

import operator
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix that a task looks at in one go.
CELLS = 2_000_000


def usable(vector: Column) -> Column:
    """Neither null nor empty, and no entry is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def extent(rows: DataFrame, vector_col: str) -> tuple[int, float]:
    """The commonest length of usable vectors (of equally common ones the longer) and their greatest norm; (0, 0) without any."""
    vector = F.col(vector_col)
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    found = rows.where(usable(vector)).groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("most")).orderBy(F.desc("n"), F.desc("size")).first()
    return (found["size"], float(np.sqrt(found["most"]))) if found else (0, 0.0)


def matrix_of(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors of `dims` entries as rows of doubles, and which rows of the column they are."""
    import pyarrow.compute as pc  # some 20 MB, which operators without vectors don't need

    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    flat = vectors.filter(sized).flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    rows = flat.astype(np.float64).reshape(-1, dims)
    fine = np.isfinite(rows).all(axis=1)
    return rows[fine], np.flatnonzero(sized.to_numpy(zero_copy_only=False))[fine]


def slices(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of bounded size: the slice, its matrix, and the rows of the slice that it holds."""
    step = max(1, CELLS // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, *matrix_of(part.column(column), dims)


def tree_sum(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Any], plus: Callable[[Any, Any], Any] = operator.add) -> Any:
    """Adds up what `partial` makes of each partition, by treeAggregate; None of an empty table."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = partial(batches)
        yield pa.RecordBatch.from_pydict({"made": pa.array([] if made is None else [pickle.dumps(made)], pa.binary())})

    def add(a: Any, b: Any) -> Any:
        return b if a is None else a if b is None else plus(a, b)

    return rows.mapInArrow(one, "made binary").rdd.map(lambda row: pickle.loads(row[0])).treeAggregate(None, add, add)
