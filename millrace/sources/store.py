"""Rows stored by key in hash buckets, into which new ones are merged without touching the others.

A store is a Parquet folder, partitioned by the number of its buckets and by the bucket, a hash of the key. A merge reads
the buckets that its keys fall into, finds those in which anything changes, and replaces these, each as a whole, by Spark's
dynamic partition overwrite; the files of all others stay as they are, and a merge that comes again writes nothing. What a
merge costs follows the buckets it changes, so `buckets` is best set for partitions of some hundred megabytes.

Each bucket that was ever written holds one row without a key, so that one from which all rows are deleted can be replaced
too. Rows whose key has a null aren't stored. Between the removal of a bucket's old files and the arrival of its new ones,
which wait beside it, readers may miss it: a store has one writer, and readers between its merges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS, BUCKET, KIND = "_buckets", "_bucket", "_kind"
#: Of a key's rows the one of the last kind counts.
STORED, DELETED, PUT = range(3)


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _bucketed(rows: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    return rows.where(_all([F.col(k).isNotNull() for k in key])).withColumns({BUCKETS: F.lit(buckets), BUCKET: F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")})


def read(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame | None:
    """The stored rows; None where nothing was ever stored."""
    found = _stored(spark, path)
    return None if found is None else found.where(_all([F.col(k).isNotNull() for k in key])).drop(BUCKETS, BUCKET)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return _all([left[c].eqNullSafe(right[c]) for c in columns])


def merge(spark: SparkSession, path: str, incoming: DataFrame, key: Sequence[str], *, newest: Sequence[str] | None = None, deleted: DataFrame | None = None, buckets: int = 64) -> list[int]:
    """Deletes the rows with the keys of `deleted`, puts those of `incoming` over what is left, and returns the buckets that
    were replaced. Of several incoming rows of one key the one with the largest `newest` (all other columns, where none
    are named) stays. Columns are those of the first merge."""
    key, others = list(key), [c for c in incoming.columns if c not in key]
    kinds = dict(incoming.dtypes)
    last, held = _bucketed(incoming, key, buckets), incoming.is_cached
    if not others:
        last, held = _bucketed(incoming.select(*key).distinct(), key, buckets), False
    elif not last.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        best = F.max_by(F.struct(*others), F.struct(*(newest or others))).alias("_last")
        last, held = _bucketed(incoming.groupBy(*key).agg(best).select(*key, "_last.*"), key, buckets), False
    if not held:
        last = last.persist()
    gone = _bucketed((deleted if deleted is not None else incoming.limit(0)).select(*key).distinct(), key, buckets).persist()
    # rows are compared by digests, so that texts travel when they are written and not before
    light = [F.sha2(F.col(c).cast("binary"), 256).alias(c) if kinds[c] in ("string", "binary") else F.col(c) for c in others]
    try:
        # at most `buckets` numbers, here and below
        touched = [r[0] for r in last.select(BUCKET).union(gone.select(BUCKET)).distinct().collect()]
        stored = _stored(spark, path)
        if stored is None:
            changed, parts = touched, []
        else:
            known = {r[0] for r in stored.select(BUCKETS).distinct().collect()}
            if known - {buckets}:
                raise ValueError(f"{path} was written with {known} buckets")
            old = stored.where(F.col(BUCKET).isin(touched) & _all([F.col(k).isNotNull() for k in key])).select(*key, *light)
            new, removed = last.select(*key, BUCKET, *light).alias("new"), gone.join(last.select(*key), key, "left_anti")
            fresh = new.join(old, [new[k] == old[k] for k in key] + [_same(new, old, others)] if others else [new[k] == old[k] for k in key], "left_anti")
            changed = [r[0] for r in fresh.select(BUCKET).union(removed.join(old.select(*key), key, "left_semi").select(BUCKET)).distinct().collect()]
            kept = stored.where(F.col(BUCKET).isin(changed) & _all([F.col(k).isNotNull() for k in key]))
            dropped = gone.where(F.col(BUCKET).isin(changed)).withColumns({c: F.lit(None).cast(kinds[c]) for c in others})
            parts = [(kept, STORED), (dropped, DELETED)]
        if changed:
            put = last.where(F.col(BUCKET).isin(changed))
            blank = spark.createDataFrame([(b,) for b in changed], f"{BUCKET} int").withColumns({c: F.lit(None).cast(t) for c, t in incoming.dtypes} | {BUCKETS: F.lit(buckets)})
            parts += [(put, PUT), (blank, PUT)]
            rows = reduce(DataFrame.unionByName, [f.select(*incoming.columns, BUCKETS, BUCKET, F.lit(kind).alias(KIND)) for f, kind in parts])
            # dealt by bucket once: the last of a key's rows is found, and written, where the bucket is
            by_key = Window.partitionBy(BUCKETS, BUCKET, *key).orderBy(F.desc(KIND))
            left = rows.repartition(BUCKET).withColumn("_place", F.row_number().over(by_key)).where((F.col("_place") == 1) & (F.col(KIND) != DELETED)).drop("_place", KIND)
            left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKETS, BUCKET).parquet(path)
            spark.catalog.refreshByPath(path)
        return sorted(changed)
    finally:
        if not held:
            last.unpersist()
        gone.unpersist()
