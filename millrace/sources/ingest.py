"""Incremental ingest: only what is new or changed is cut into chunks and stored, what is gone or expired is removed.

A ledger, a store by path, says of each source which content its chunks are from: a SHA-256, and how many chunks there are.
A run compares the sources that are there with the ledger, cuts the changed ones, merges their chunks into the points (a
store by point id), deletes the chunks that a shorter text no longer has and those of sources that are gone, and only
then writes the ledger: a run that was broken off is made good by the next one. Sources past their `expires_at` count as gone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import files, store, tables

LEDGER = "path string, stamp string, sha256 string, n_chunks long, expires_at timestamp"
#: Sources that one read names at most.
PATHS = 10_000


@dataclass
class Run:
    added: int
    changed: int
    removed: int
    points_put: int
    points_deleted: int
    buckets: list[int]  # of the points, replaced


def point_id(path: Column, index: Column) -> Column:
    return text.uuid5(F.concat_ws(":", path, F.lit("chunk"), index.cast("string")))


def cut(sources: DataFrame, *, size: int = 1800, overlap: int = 200) -> DataFrame:
    """Rows path, chunk_index, content, with their point ids, of sources with path and content."""
    chunks = sources.select("path", F.explode(text.chunks(F.col("content"), size, overlap)).alias("c"))
    return chunks.select(point_id(F.col("path"), F.col("c.chunk_index")).alias("point_id"), "path", "c.chunk_index", F.col("c.chunk").alias("content"))


def known(spark: SparkSession, ledger: str) -> DataFrame:
    found = store.read(spark, ledger, ["path"])
    return spark.createDataFrame([], LEDGER) if found is None else found


def apply(spark: SparkSession, seen: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], *, ledger: str, points: str, now: Column, whole: bool = True, buckets: int = 64) -> Run:
    """One run. `seen` has path, stamp, sha256 and expires_at of the sources that are there, one row each; `chunks_of` takes
    the paths to cut and gives their chunks with point_id, path and chunk_index. Unless `whole`, what isn't seen stays."""
    before = known(spark, ledger).persist()
    there = seen.select("path", "stamp", "sha256", F.col("expires_at").cast("timestamp").alias("expires_at")).persist()
    good = there.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    old = before.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha"), F.col("n_chunks").alias("_n"))
    fresh = good.join(old, F.col("path") == F.col("_path"), "left").where(~F.col("sha256").eqNullSafe(F.col("_sha"))).persist()
    expired = before.where(F.col("expires_at") <= now).select("path").union(there.where(F.col("expires_at") <= now).select("path"))
    missing = before.join(there, "path", "left_anti").select("path") if whole else before.limit(0).select("path")
    # what was seen and is good isn't gone, even if it had expired before
    gone = before.join(expired.union(missing).distinct(), "path", "left_semi").join(good, "path", "left_anti").select("path", F.col("n_chunks").alias("_n")).persist()
    # where nothing is new no source is read again
    made = chunks_of(fresh.select("path") if not fresh.isEmpty() else fresh.select("path").limit(0)).persist()
    try:
        counts = made.groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"))
        rows = fresh.join(counts, "path", "left").select("path", "stamp", "sha256", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), "expires_at", "_path", "_n").persist()
        # chunks that a shorter text no longer has, and all those of what is gone
        surplus = rows.where(F.col("_n") > F.col("n_chunks")).select("path", F.col("n_chunks").alias("first"), "_n").union(gone.where("_n > 0").select("path", F.lit(0).cast("long"), "_n"))
        dropped = surplus.select("path", F.explode(F.sequence("first", F.col("_n") - 1)).alias("i")).select(point_id(F.col("path"), F.col("i")).alias("point_id"))
        added, all_, removed, put, deleted = rows.where("_path is null").count(), rows.count(), gone.count(), made.count(), dropped.count()
        replaced = store.merge(spark, points, made, ["point_id"], deleted=dropped, buckets=buckets) if put or deleted else []
        # a new stamp or date on the same content is only written down
        noted = good.join(rows.select("path"), "path", "left_anti").join(before.select("path", "sha256", "n_chunks"), ["path", "sha256"]).select("path", "stamp", "sha256", "n_chunks", "expires_at")
        store.merge(spark, ledger, rows.select(*noted.columns).union(noted), ["path"], deleted=gone.select("path"), buckets=buckets)
        rows.unpersist()
        return Run(added, all_ - added, removed, put, deleted, replaced)
    finally:
        for frame in (before, there, fresh, gone, made):
            frame.unpersist()


def ingest_rows(spark: SparkSession, sources: DataFrame, *, ledger: str, points: str, now: Column, size: int = 1800, overlap: int = 200, buckets: int = 64) -> Run:
    """A run over rows path, content and expires_at; paths are unique, null content counts as empty."""
    rows = sources.select("path", F.coalesce("content", F.lit("")).alias("content"), "expires_at")
    seen = rows.select("path", F.lit(None).cast("string").alias("stamp"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "expires_at")
    return apply(spark, seen, lambda paths: cut(rows.join(paths, "path", "left_semi"), size=size, overlap=overlap), ledger=ledger, points=points, now=now, buckets=buckets)


def _by_paths(paths: DataFrame, read: Callable[[list[str]], DataFrame], schema: str) -> DataFrame:
    """`read` of all the paths, some thousands at a time; the driver holds these anyhow, as it lists the files."""
    listed = [r["path"] for r in paths.select("path").toLocalIterator()]
    out = paths.sparkSession.createDataFrame([], schema)
    for at in range(0, len(listed), PATHS):
        out = out.unionByName(read(listed[at : at + PATHS]))
    return out


def ingest_folder(
    spark: SparkSession, folder: str, *, ledger: str, points: str, now: Column, readers: Mapping[str, Callable[..., DataFrame]] | None = None,
    expiry: DataFrame | None = None, size: int = 1800, overlap: int = 200, buckets: int = 64,
) -> Run:
    """A run over the files of a folder. A file whose length and time are those of the ledger isn't opened; of the others the
    digest decides. `expiry` has path and expires_at of staged files."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    names = "path string, stamp string, sha256 string"
    stamped = listing.load(folder).select(tables.uri(F.col("path")).alias("path"), F.concat_ws("/", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("stamp"))
    before = known(spark, ledger).select("path", F.col("stamp").alias("_stamp"), F.col("sha256").alias("_sha"))
    listed = stamped.join(before, "path", "left").persist()
    same = F.col("stamp").eqNullSafe(F.col("_stamp"))
    digested = _by_paths(listed.where(~same), lambda paths: listing.load(paths).select(tables.uri(F.col("path")).alias("path"), F.lit(None).cast("string").alias("stamp"), F.sha2("content", 256).alias("sha256")), names)
    seen = listed.where(same).select("path", "stamp", F.col("_sha").alias("sha256")).unionByName(digested.drop("stamp").join(listed.select("path", "stamp"), "path").select("path", "stamp", "sha256"))
    none = spark.createDataFrame([], "path string, expires_at timestamp")
    seen = seen.join((none if expiry is None else expiry).select("path", "expires_at"), "path", "left")

    def chunks_of(paths: DataFrame) -> DataFrame:
        docs = _by_paths(paths, lambda some: files.documents(spark, some, readers), files.DOCUMENT_SCHEMA)
        # documents of one file, such as rows of a table, are numbered one after another
        whole = docs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("source_type", "title", "content"))).alias("d"))
        parts = F.flatten(F.transform("d", lambda d: F.transform(text.chunks(d["content"], size, overlap), lambda c: F.struct(d["source_type"].alias("source_type"), d["title"].alias("title"), c["chunk"].alias("content")))))
        rows = whole.select("path", F.posexplode(parts).alias("chunk_index", "c"))
        return rows.select(point_id(F.col("path"), F.col("chunk_index")).alias("point_id"), "path", "chunk_index", "c.source_type", "c.title", "c.content")

    run = apply(spark, seen, chunks_of, ledger=ledger, points=points, now=now, buckets=buckets)
    listed.unpersist()
    return run


def sweep(spark: SparkSession, *, ledger: str, points: str, now: Column, buckets: int = 64) -> Run:
    """Removes what has expired and leaves everything else alone."""
    nothing = spark.createDataFrame([], LEDGER)
    return apply(spark, nothing, lambda paths: cut(paths.withColumn("content", F.lit(""))).limit(0), ledger=ledger, points=points, now=now, whole=False, buckets=buckets)
