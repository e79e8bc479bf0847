"""Event streams: consumers that run at least once, job states, counters and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOB_EVENT = "event_type string, event_id string, job_ids array<string>, tenant_id string, request_id string, emitted_at timestamp"
#: Stages in which a job may fail (fixed values).
FAILED_STAGES = ["load_asset", "acl_check", "load_object", "parse", "embed", "upsert", "index"]


def parsed(stream: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """One row for each job of the events of a kind; malformed and foreign events go."""
    event = F.from_json(F.col(value).cast("string"), JOB_EVENT, {"mode": "PERMISSIVE"})
    rows = stream.select(event.alias("e")).where(F.col("e.event_type") == kind)
    return rows.select("e.event_id", F.explode("e.job_ids").alias("job_id"), "e.tenant_id", "e.request_id", "e.emitted_at")


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, batch by batch; a batch is committed once `handle` is through, so it may come again."""
    return stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def startable(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs to run for a batch, each once: completed ones are skipped, and those of another or of no tenant."""
    asked = wanted.select("job_id", F.trim("tenant_id").alias("_tenant")).where(F.col("_tenant") != "").distinct()
    left = jobs.where(F.col("status") != "completed")
    return left.join(asked, (left["job_id"] == asked["job_id"]) & (F.trim(left["tenant_id"]) == asked["_tenant"]), "left_semi")


def started(jobs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The batch's startable jobs, running; pending and failed ones alike, and running ones whose worker was lost."""
    return startable(jobs, wanted).withColumns({"status": F.lit("running"), "started_at": now, "failed_stage": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})


def finished(jobs: DataFrame, error: Column, stage: Column) -> DataFrame:
    """Completed, or failed with a known stage (`index` where it isn't one) and the message."""
    failed = error.isNotNull()
    known = F.when(stage.isin(*FAILED_STAGES), stage).otherwise("index")
    return jobs.withColumns({"status": F.when(failed, "failed").otherwise("completed"), "failed_stage": F.when(failed, known), "error": F.when(failed, error)})


def retried(jobs: DataFrame, new_id: Column) -> DataFrame:
    """New pending jobs for the failed ones."""
    return jobs.where(F.col("status") == "failed").withColumns({"job_id": new_id, "status": F.lit("pending"), "failed_stage": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})


def reopened(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents of the failed jobs, back to indexing; the others as they are."""
    again = jobs.where(F.col("status") == "failed").select("document_id").distinct().withColumn("_again", F.lit(True))
    marked = documents.join(again, "document_id", "left")
    return marked.withColumn("status", F.when(F.col("_again"), "indexing").otherwise(F.col("status"))).select(*documents.columns)


def expiring_counts(rows: DataFrame, key: str, ts: str, seconds: int, late: str) -> DataFrame:
    """Counts per key and window with the moment at which the counter expires: a second after its window."""
    return window_counts(rows, key, ts, seconds, late).withColumn("expires_at", F.col("window_start") + seconds + 1)


def window_counts(rows: DataFrame, key: str, ts: str, seconds: int, late: str) -> DataFrame:
    """Rows per key and fixed window. In update mode each change comes out and a window's state goes once the watermark has
    passed it; rows later than that are dropped."""
    timed = rows.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", f"{seconds} seconds").alias("_w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.unix_seconds("_w.start").alias("window_start"), "n")


def sessions(rows: DataFrame, key: str, ts: str, idle_seconds: int, late: str) -> DataFrame:
    """Rows per key and session; a session ends where nothing comes for the idle time. In append mode it comes out, and its
    state goes, once the watermark has passed its end."""
    timed = rows.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.session_window("_at", f"{idle_seconds} seconds").alias("_w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.unix_seconds("_w.start").alias("session_start"), "n")


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    """Staged uploads that are still good; one without a date doesn't expire."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
