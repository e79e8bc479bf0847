"""Vectors stored by cell, searched from the nearest cell on until no other can hold anything better: exact, and reads a part.

Centroids are fitted by spherical k-means on a bounded sample; every vector is stored under the centroid that it has the
smallest angle to, whether it was in the sample or not. A cell's radius is the greatest angle of its vectors to the centroid,
so by the triangle inequality for angles no vector of the cell is nearer to a query than the query's angle to the centroid
less the radius. A search reads cells in the order of these bounds, twice as many each time, and stops once its k-th row is
nearer than the next bound. How much that saves depends on the vectors: clusters save much, directions at random nothing.

Rows with a null or zero vector, or with null or non-finite entries, have no angle; they are kept in a cell of their own that is
read when the others give fewer than k rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import retrieval

#: The cell of vectors without an angle.
NONE = -1
CELL = "_cell"


def unit_rows(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 as rows, zeros where there is no angle, and which rows have one."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dims))
    out[sized] = vectors.filter(pa.array(sized)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norms = np.sqrt((out * out).sum(axis=1))
    fine = np.isfinite(norms) & (norms > 0)
    out[fine] /= norms[fine, None]
    out[~fine] = 0
    return out, fine


def centroids_of(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its centroid."""
    random = np.random.default_rng(seed)
    found = sample[random.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))
        found[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return found


def build(vectors: DataFrame, path: str, *, id_col: str, vector_col: str = "embedding", cells: int = 64, sample_rows: int = 20_000) -> None:
    """Stores the rows, all columns, under `path`/rows by cell, and the cells' centroids, radii and sizes under `path`/cells."""
    spark = vectors.sparkSession
    dims = vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = dims["n"] if dims else 1
    sample = vectors.where(F.size(vector_col) == width).orderBy(F.xxhash64(id_col)).limit(sample_rows).select(F.col(vector_col).cast("array<double>").alias("v")).collect()
    units, fine = unit_rows(pa.array([r["v"] for r in sample], pa.list_(pa.float64())), width) if sample else (np.zeros((0, width)), np.zeros(0, bool))
    centroids = centroids_of(units[fine], cells) if fine.any() else np.zeros((0, width))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = unit_rows(batch.column(vector_col), width)
            cosines = rows @ centroids.T if len(centroids) else np.zeros((len(rows), 1))
            cell = np.where(known, cosines.argmax(axis=1), NONE) if len(centroids) else np.full(len(rows), NONE)
            angle = np.where(cell == NONE, 0.0, np.arccos(np.clip(cosines.max(axis=1), -1, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, CELL, "_angle"])

    schema = T.StructType([*vectors.schema.fields, T.StructField(CELL, T.IntegerType()), T.StructField("_angle", T.DoubleType())])
    # a large cell is several files, a small one a single one
    vectors.mapInArrow(placed, schema).write.mode("overwrite").partitionBy(CELL).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    sizes = stored.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("radius"))
    middles = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)] + [(NONE, None)], f"{CELL} int, centroid array<double>")
    sizes.join(middles, CELL).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


@dataclass
class Search:
    rows: DataFrame
    cells_read: int
    cells: int
    rows_read: int


def search(spark: SparkSession, path: str, query: Sequence[float], k: int, *, id_col: str, vector_col: str = "embedding", where: Column | None = None, first: int = 2) -> Search:
    """The same rows as `retrieval.top_k` over all that was stored, and how many cells were read for them."""
    stored = spark.read.parquet(f"{path}/rows").drop("_angle")
    cells = spark.read.parquet(f"{path}/cells").collect()  # as many as were asked for
    q = np.array(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))
    bounds = []
    for r in cells:
        angle = float(np.arccos(np.clip(np.array(r["centroid"]) @ q / norm, -1, 1))) if r["centroid"] is not None and norm > 0 else 0.0
        # the greatest cosine that a row of the cell can have, with room for rounding
        bounds.append((float(np.cos(max(angle - r["radius"] - 1e-9, 0.0))) + 1e-9 if r[CELL] != NONE else -2.0, r[CELL], r["n"]))
    bounds.sort(reverse=True)
    at, step, found = 0, first, []
    while at < len(bounds) and (len(found) < k or found[-1][0] <= bounds[at][0]):
        now = [c for _, c, _ in bounds[at : at + step]]
        best = retrieval.top_k(stored.where(F.col(CELL).isin(now)), query, k, id_col=id_col, vector_col=vector_col, where=where).select("score", id_col).collect()
        found += [(r["score"] if r["score"] is not None and r["score"] == r["score"] else -3.0, r[id_col]) for r in best]
        found = sorted(found, key=lambda x: -x[0])[:k]
        at, step = min(at + step, len(bounds)), step * 2
    read = [c for _, c, _ in bounds[:at]]
    rows = retrieval.top_k(stored.where(F.col(CELL).isin(read)), query, k, id_col=id_col, vector_col=vector_col, where=where).drop(CELL)
    return Search(rows, at, len(bounds), sum(n for _, _, n in bounds[:at]))
