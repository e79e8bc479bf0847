"""Keyed state in streams: jobs that move from state to state, and admission of requests by fixed windows.

Both are stateful processors: state lives with its key in the state store, a batch that comes again finds the state that it
found before, and event-time timers end what waits too long. What comes out doesn't depend on how the stream is cut into
batches, as long as a key's events come in the order of their times: an event that lies behind a job's deadline first
finds the job timed out, whether the timer has fired yet or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import FAILED_STAGES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITION = "job_id string, seq long, at_us long, status string, attempts long, failed_stage string, error string, event_id string"
JOB = "seq long, status string, attempts long, failed_stage string, error string, started_us long, last_us long, last_id string"
TIMED_OUT = "timed out"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that such processors need; running ones are left alone."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def as_text(value: Any) -> str | None:
    return None if value is None or value != value else str(value)


class JobStates(StatefulProcessor):
    """pending, running, completed or failed, by the rules of `job_transitions`."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", JOB)

    def deadline_ms(self, started_us: int) -> int:
        return -(-started_us // 1000) + self.timeout_ms

    def load(self) -> dict[str, Any]:
        names = [f.split()[0] for f in JOB.split(", ")]
        found = self.state.get()
        return dict(zip(names, found if found is not None else (0, None, 0, None, None, None, None, None), strict=True))

    def timer(self, job: dict[str, Any]) -> int | None:
        """When the job must be looked at again: only a running one has a deadline."""
        return self.deadline_ms(job["started_us"]) if job["status"] == "running" else None

    def keep(self, job: dict[str, Any], timer: int | None) -> None:
        """Stores the job, and puts its timer in the place of the one that it had before the batch."""
        if timer != self.timer(job):
            if timer is not None:
                self.handle.deleteTimer(timer)
            if self.timer(job) is not None:
                self.handle.registerTimer(self.timer(job))
        self.state.update(tuple(job.values()))

    def moved(self, job: dict[str, Any], status: str, at_us: int, event_id: str | None, stage: str | None = None, error: str | None = None) -> tuple:
        """The job in its next state."""
        job |= {"seq": job["seq"] + 1, "status": status, "failed_stage": stage, "error": error}
        if status == "running":
            job |= {"attempts": job["attempts"] + 1, "started_us": at_us}
        return job["seq"], at_us, status, job["attempts"], stage, error, event_id

    def out(self, key: Any, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            names = [f.split()[0] for f in TRANSITION.split(", ")]
            yield pd.DataFrame([(str(key[0]), *r) for r in rows], columns=names).astype({"failed_stage": object, "error": object, "event_id": object})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        job, made = self.load(), []
        timer = self.timer(job)
        # a job's events of one batch, of which there are few
        events = pd.concat(list(rows)).sort_values(["at_us", "event_id"], kind="stable")
        for at, event, kind, ours, stage, error in events[["at_us", "event_id", "kind", "ours", "stage", "error"]].itertuples(index=False):
            at, event = int(at), str(event)
            if job["last_id"] is not None and (at, event) <= (job["last_us"], job["last_id"]):
                continue  # delivered again
            if job["status"] == "running" and at > self.deadline_ms(job["started_us"]) * 1000:
                made.append(self.moved(job, "failed", self.deadline_ms(job["started_us"]) * 1000, None, "index", TIMED_OUT))
            if kind == "requested" and ours and job["status"] != "completed":
                made.append(self.moved(job, "running", at, event))
            elif kind == "completed" and job["status"] == "running":
                made.append(self.moved(job, "completed", at, event))
            elif kind == "failed" and job["status"] == "running":
                known = as_text(stage)
                made.append(self.moved(job, "failed", at, event, known if known in FAILED_STAGES else "index", as_text(error)))
            elif kind == "retried" and job["status"] == "failed":
                made.append(self.moved(job, "pending", at, event))
            job |= {"last_us": at, "last_id": event}
        self.keep(job, timer)
        yield from self.out(key, made)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        job = self.load()
        timer = self.timer(job)
        if job["status"] == "running" and self.deadline_ms(job["started_us"]) <= expiredTimerInfo.getExpiryTimeInMs():
            made = [self.moved(job, "failed", self.deadline_ms(job["started_us"]) * 1000, None, "index", TIMED_OUT)]
            self.keep(job, timer)
            yield from self.out(key, made)

    def close(self) -> None:
        pass


def job_transitions(events: DataFrame, *, timeout_seconds: int, late: str) -> DataFrame:
    """Each change of a job's state, once, from a stream of job_id, event_id, kind, tenant_id, job_tenant_id, stage, error, at.

    requested: a job that isn't completed runs (again), if the message's tenant is the job's own and not blank; completed and
    failed end a running job, with a known stage of failure (index where it isn't one); retried makes a failed job pending.
    A running job fails in stage index once nothing has ended it for `timeout_seconds`. Anything else changes nothing, nor
    does an event that isn't newer, by time and id, than the last that the job has seen.
    """
    ours = F.coalesce((F.trim("tenant_id") != "") & (F.trim("tenant_id") == F.trim("job_tenant_id")), F.lit(False))
    timed = events.where("job_id is not null and event_id is not null and at is not null").withWatermark("at", late)
    rows = timed.select(F.col("job_id").cast("string").alias("job_id"), F.col("event_id").cast("string").alias("event_id"), "kind", ours.alias("ours"), "stage", "error", F.unix_micros("at").alias("at_us"), "at")
    return rows.groupBy("job_id").transformWithStateInPandas(JobStates(timeout_seconds * 1000), outputStructType=TRANSITION, outputMode="Update", timeMode="EventTime")


class Admission(StatefulProcessor):
    """Counts the requests of the scopes and windows of one shard; a counter goes a second after its window and its late comers.

    Requests come and go in tables of some thousand rows; of a batch a shard holds what may still be allowed and no more."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "scope array<string>, window_no array<long>, n array<long>")

    def load(self, watermark_ms: int) -> pd.DataFrame:
        """The counters that haven't expired."""
        found = self.open.get()
        columns = found if found is not None else ([], [], [])
        counts = pd.DataFrame(dict(zip(("scope", "window_no", "_n"), columns, strict=True))).astype({"window_no": "int64", "_n": "int64"})
        return counts[(counts["window_no"] + 1) * self.seconds * 1000 + 1000 > watermark_ms]

    def save(self, counts: pd.DataFrame) -> None:
        if len(counts):
            self.open.update(tuple(counts[c].tolist() for c in ("scope", "window_no", "_n")))
        else:
            self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        by = ["scope", "window_no"]
        before = self.load(timerValues.getCurrentWatermarkInMs())
        counts, first = before, None  # the batch's earliest; a scope's other requests are never held
        for part in rows:
            part = part[[*by, "at_us", "request_id"]]
            counts = pd.concat([counts, part.groupby(by, as_index=False).size().rename(columns={"size": "_n"})]).groupby(by, as_index=False).sum()
            both = (part if first is None else pd.concat([first, part])).sort_values([*by, "at_us", "request_id"], kind="stable")
            left = self.limit - both.merge(before, on=by, how="left")["_n"].fillna(0).to_numpy()
            allowed = both.groupby(by).cumcount().to_numpy() < left
            yield self.out(both[~allowed], False)
            first = both[allowed]
        if first is not None:
            yield self.out(first, True)
        # a shard is cleared of its old windows whenever rows come, and by this timer if none come any more
        last = counts["window_no"].max()
        if last > before["window_no"].max() or before.empty:
            self.handle.registerTimer((int(last) + 1) * self.seconds * 1000 + 1000)
        self.save(counts)

    def out(self, requests: pd.DataFrame, allowed: bool) -> pd.DataFrame:
        return requests[["scope", "window_no", "request_id"]].assign(allowed=allowed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.save(self.load(expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, *, scope: str, request_id: str, ts: str, seconds: int, limit: int, late: str, shards: int = 256) -> DataFrame:
    """A decision for each request of a stream: allowed while its number in its scope's window, by time and id, is at most
    `limit`. `request_id` is a whole number.

    State and calls go by shards, hashes of scope and window, as most windows have a request or two. `shards` stays the same
    for the life of a checkpoint."""
    timed = requests.where(F.col(scope).isNotNull() & F.col(request_id).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp")).where("_at is not null").withWatermark("_at", late)
    at = F.unix_micros("_at")
    rows = timed.select(F.col(scope).cast("string").alias("scope"), F.floor(at / F.lit(1_000_000 * seconds)).cast("long").alias("window_no"), F.col(request_id).cast("long").alias("request_id"), at.alias("at_us"), "_at")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("scope", "window_no"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").transformWithStateInPandas(Admission(limit, seconds), outputStructType="scope string, window_no long, request_id long, allowed boolean", outputMode="Append", timeMode="EventTime")
