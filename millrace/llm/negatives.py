"""Hard negatives by distributed radix selection over whole-number scores.

A row's score for an anchor is the inner product of their vectors as whole numbers, floor(scale * x). An anchor's positives
are its best `positives` other rows of its label; each of them opens a window of scores, from `low` to `high` hundredths of
the positive's own, and the best `negatives` rows of other labels in the window are returned.

Both choices are made by the same radix selection. Each task counts, for all windows of a block of anchors, the scores of its
rows in `buckets` equal parts of the window; the counts are added up by treeAggregate, and the bucket that holds the k-th
score becomes the window of the next digit, until it is one score wide. Only rows from that score up are gathered then, and
of those at the score itself each task gives the k with the smallest ids. Nothing but counts of a size given by the
parameters travels before, however the scores, labels or equal vectors are spread.

The anchors are a stated set of queries against all rows. They are taken in blocks of at most `anchor_rows`, so that what
goes to each task and comes back from it is bounded by parameters: a block of vectors, and anchors x positives x buckets
counts. The rows are read again for every digit of a block, without a shuffle; the work is the scores themselves.

Defined results: rows with a null id or label, or a vector that is null, empty, holds a null or non-finite entry or isn't of the
commonest length (of equally common ones the longer), take no part. Rows of the anchor's own id are not "other" rows; an
anchor that is repeated in id, label and vector is one anchor; other repeated rows count each. Equal scores go by the smaller
id. An anchor without positives, or a window without rows, gives nothing; an empty table gives an empty result; labels
are whole numbers; other columns are ignored. Scores beyond a long raise an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import checkpointed
from .vectors import extent, slices, tree_sum, usable

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Anchors:
    """A block of anchors; scores are doubles where these hold them exactly."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    scale: float
    exact: bool

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, labels and scores (anchors x rows) of the usable rows, some at a time."""
        dims = self.vectors.shape[1]
        step = max(1, 2_000_000 // len(self.ids))
        for part, m, at in slices(batches, "vector", dims):
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False)[at] for c in ("id", "label"))
            q = np.floor(self.scale * m)
            for i in range(0, len(q), step):
                if self.exact:
                    score = (self.vectors @ q[i : i + step].T).astype(np.int64)
                else:
                    score = np.array([[sum(map(int.__mul__, a, b)) for b in map(whole, q[i : i + step])] for a in map(whole, self.vectors)], np.int64)
                yield ids[i : i + step], labels[i : i + step], score


def whole(vector: np.ndarray) -> list[int]:
    return [int(x) for x in vector]


@dataclass
class Windows:
    """Scores from lo to hi, at most one window an anchor in each layer (layers x anchors); empty where lo > hi."""

    lo: np.ndarray
    hi: np.ndarray
    same_label: bool

    def rows(self, anchors: Anchors, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Which rows an anchor may choose from (anchors x rows)."""
        same = anchors.labels[:, None] == labels[None, :]
        return same & (anchors.ids[:, None] != ids[None, :]) if self.same_label else ~same


def floors(rows: DataFrame, anchors: Anchors, windows: Windows, k: int, buckets: int) -> np.ndarray:
    """For each window the k-th best score in it, or its lower end where it holds fewer rows."""
    lo, hi = windows.lo.copy(), windows.hi.copy()
    need = np.full(lo.shape, k, np.int64)
    open_ = lo < hi
    few = np.zeros(lo.shape, bool)
    while open_.any():
        width = np.maximum(-((lo - hi - 1) // buckets), 1)
        looked, shape = open_.copy(), (*lo.shape, buckets)

        def count(batches: Iterator[pa.RecordBatch], lo: np.ndarray = lo, hi: np.ndarray = hi, width: np.ndarray = width, looked: np.ndarray = looked) -> np.ndarray:
            total = np.zeros((len(lo), lo.shape[1] * buckets), np.int64)
            for ids, labels, score in anchors.scores(batches):
                may = windows.rows(anchors, ids, labels)
                for j in range(len(lo)):
                    a, c = np.nonzero(may & (score >= lo[j][:, None]) & (score <= hi[j][:, None]) & looked[j][:, None])
                    bucket = (score[a, c] - lo[j][a]) // width[j][a]
                    total[j] += np.bincount(a * buckets + bucket, minlength=total.shape[1])
            return total

        counts = tree_sum(rows, count)
        if counts is None:
            break
        from_top = counts.reshape(shape)[..., ::-1].cumsum(axis=-1)
        reached = from_top >= need[..., None]
        found, place = reached.any(axis=-1) & open_, reached.argmax(axis=-1)
        before = np.where(place > 0, np.take_along_axis(from_top, np.maximum(place - 1, 0)[..., None], -1)[..., 0], 0)
        few |= open_ & ~found
        low = lo + (buckets - 1 - place) * width
        hi = np.where(found, np.minimum(hi, low + width - 1), hi)
        lo, need = np.where(found, low, lo), np.where(found, need - before, need)
        open_ = found & (hi > lo)
    return np.where(few, windows.lo, lo)


def gather(rows: DataFrame, anchors: Anchors, windows: Windows, least: np.ndarray, k: int) -> DataFrame:
    """Rows (layer, anchor, id, score) from the score `least` up, of each task at most the k best of a window and batch."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, score in anchors.scores(batches):
            may = windows.rows(anchors, ids, labels)
            for j in range(len(least)):
                a, c = np.nonzero(may & (score >= least[j][:, None]) & (score <= windows.hi[j][:, None]))
                s, i = score[a, c], ids[c]
                order = np.lexsort((i, -s, a))
                a, s, i = a[order], s[order], i[order]
                best = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, s, i = a[best], s[best], i[best]
                yield pa.RecordBatch.from_pydict({"layer": pa.array(np.full(len(a), j, np.int32)), "anchor": pa.array(a.astype(np.int32)), "id": pa.array(i.astype(np.int64)), "score": pa.array(s)})

    found = rows.mapInArrow(chosen, "layer int, anchor int, id long, score long")
    best = Window.partitionBy("layer", "anchor").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine_block(rows: DataFrame, anchors: Anchors, bound: int, positives: int, negatives: int, low: int, high: int, buckets: int) -> DataFrame:
    n = len(anchors.ids)
    all_ = Windows(np.full((1, n), -bound, np.int64), np.full((1, n), bound, np.int64), same_label=True)
    best = gather(rows, anchors, all_, floors(rows, anchors, all_, positives, buckets), positives).collect()  # positives x anchors at most
    chosen, scores = np.zeros((positives, n), np.int64), np.zeros((positives, n), np.int64)
    known = np.zeros((positives, n), bool)
    for r in best:
        at = r["rank"] - 1, r["anchor"]
        chosen[at], scores[at], known[at] = r["id"], r["score"], True
    # floor and ceiling in whole numbers; scores times a hundred may be beyond a long only where scores aren't exact doubles
    wide = scores if anchors.exact else scores.astype(object)
    lo, hi = np.where(known, -((-low * wide) // 100), 1).astype(np.int64), np.where(known, high * wide // 100, 0).astype(np.int64)
    windows = Windows(lo, hi, same_label=False)
    found = gather(rows, anchors, windows, floors(rows, anchors, windows, negatives, buckets), negatives)
    pairs = [(j, a, int(anchors.ids[a]), int(chosen[j, a]), int(scores[j, a])) for j, a in zip(*map(np.ndarray.tolist, np.nonzero(known)), strict=True)]
    of = rows.sparkSession.createDataFrame(pairs, "layer int, anchor int, anchor_id long, positive_id long, positive_score long")
    named = found.join(F.broadcast(of), ["layer", "anchor"])  # positives x anchor_rows rows at most
    return checkpointed(named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def mine(
    rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_rows: int = 4096, buckets: int = 64,
) -> DataFrame:
    """The hard negatives of all rows that `is_anchor` (a condition on the columns of `rows`) holds for."""
    parts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), is_anchor.alias("is_anchor")).where("id is not null and label is not null and vector is not null")
    all_ = parts.select("id", "label", "vector")
    spark = rows.sparkSession
    dims, most = extent(all_, "vector")
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    bound = int((scale * most + dims**0.5) ** 2) + 2  # of two vectors' inner product, by their norms
    queries = parts.where(F.col("is_anchor") & usable(F.col("vector")) & (F.size("vector") == dims)).select("id", "label", "vector").distinct()
    queries = checkpointed(queries.withColumn("deal", F.xxhash64("id", "label", "vector")))
    blocks = -(-queries.count() * 10 // (9 * anchor_rows))
    made = []
    for block in range(blocks):
        got = queries.where(F.pmod("deal", F.lit(blocks)) == block).collect()  # about nine tenths of anchor_rows
        for i in range(0, len(got), anchor_rows):
            now = got[i : i + anchor_rows]
            vectors = np.floor(scale * np.array([r["vector"] for r in now], np.float64))
            anchors = Anchors(np.array([r["id"] for r in now], np.int64), np.array([r["label"] for r in now], np.int64), vectors, scale, exact=bound < 2**52)
            made.append(mine_block(all_, anchors, min(bound, 2**61), positives, negatives, low, high, buckets))
    return reduce(DataFrame.unionAll, made) if made else spark.createDataFrame([], SCHEMA)
