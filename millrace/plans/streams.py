"""Queries that read the events as a stream, in batches of files, and hold against the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import access
from ..operators.lineage import shared_folder
from ..streaming import events, keyed


def _run(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame], mode: str, key: list[str]) -> DataFrame:
    """What the stream has written of all that is there: each batch's rows in a folder of their own, the last of a key."""
    out = shared_folder(spark, "stream")
    # a pattern, as a stream takes a plain path for a folder; times without a zone are taken as UTC
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    stream = plan(rows.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))
    # a batch that comes again overwrites what it wrote
    with keyed.keyed_state(spark):
        query = events.consume(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}"), f"{out}/checkpoint", mode)
    query.awaitTermination()
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    return access.latest_per_key(written, key, ["batch"]).drop("batch").select(*stream.columns)


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as they change (update mode), of each window the last."""
    return _run(spark, sf_dir, lambda s: events.window_counts(s, "user_id", "ts", 3600, "1 day"), "update", ["user_id", "window_start"])


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are over (append mode): those that end before the watermark, seven days behind the newest event."""
    return _run(spark, sf_dir, lambda s: events.sessions(s, "user_id", "ts", 86400, "7 days"), "append", ["user_id", "session_start"])


def job_events(rows: DataFrame) -> DataFrame:
    """The event table as messages about jobs, a user's events being a job's; sign-ups come without a tenant."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in (("view", "requested"), ("signup", "requested"), ("click", "completed"), ("error", "failed"), ("purchase", "retried")) for x in pair)), F.col("event_type"))
    tenant = F.when(F.col("event_type") == "signup", " ").otherwise("t1 ")
    stage = F.element_at(F.array(F.lit("embed"), F.lit("unheard of"), F.lit(None).cast("string")), (F.col("event_id") % 3 + 1).cast("int"))
    return rows.select(F.col("user_id").alias("job_id"), "event_id", kind.alias("kind"), tenant.alias("tenant_id"), F.lit("t1").alias("job_tenant_id"), stage.alias("stage"), F.col("event_type").alias("error"), F.col("ts").alias("at"))


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each job: what nothing has ended for three days has failed, once the watermark has passed that."""
    made = _run(spark, sf_dir, lambda s: keyed.job_transitions(job_events(s), timeout_seconds=3 * 86400, late="1 day"), "update", ["job_id", "seq"])
    last = access.latest_per_key(made, ["job_id"], ["seq"])
    return last.select(F.col("job_id").cast("long").alias("job_id"), "seq", F.floor(F.col("at_us") / 1000).alias("at_ms"), "status", "attempts", "failed_stage", "error")


def stream_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a user and hour."""
    made = _run(spark, sf_dir, lambda s: keyed.admissions(s, scope="user_id", request_id="event_id", ts="ts", seconds=3600, limit=3, late="1 day"), "append", ["request_id"])
    return made.select(F.col("request_id").alias("event_id"), F.col("scope").cast("long").alias("user_id"), "window_no", "allowed")


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_sessions, stream_job_states, stream_admissions)}
ORACLE_SQL = {
    "stream_window_counts": "select user_id, (floor(epoch(ts) / 3600) * 3600)::bigint as window_start, count(*) as n from events group by all",
    "stream_admissions": "select event_id, user_id, floor(epoch(ts) / 3600)::bigint as window_no, row_number() over (partition by user_id, floor(epoch(ts) / 3600) order by ts, event_id) <= 3 as allowed from events",
    "stream_job_states": """
        with recursive event as (
            select user_id as job_id, event_id, epoch_us(ts) as us, event_type as kind, case when event_id % 3 = 0 then 'embed' else 'index' end as stage,
                row_number() over (partition by user_id order by ts, event_id::varchar) as n from events),
        state(job_id, n, seq, us, status, attempts, stage, error, deadline) as (
            select distinct job_id, 0::bigint, 0::bigint, 0::bigint, 'none', 0::bigint, null::varchar, null::varchar, null::bigint from event
            union all
            select job_id, n, seq + (case when moves then 1 else 0 end), case when moves then now_us else us end, case when moves then next else status end,
                attempts + (case when moves and next = 'running' then 1 else 0 end),
                case when not moves then stage when next = 'failed' then new_stage end, case when not moves then error when next = 'failed' then 'error' end,
                case when moves and next = 'running' then (now_us + 999) // 1000 + 259200000 else deadline end
            from (
                select *, (kind = 'view' and status <> 'completed') or (kind in ('click', 'error') and status = 'running') or (kind = 'purchase' and status = 'failed') as moves,
                    case kind when 'view' then 'running' when 'click' then 'completed' when 'error' then 'failed' else 'pending' end as next
                from (
                    select s.job_id, e.n, e.us as now_us, e.kind, e.stage as new_stage, late, seq + (case when late then 1 else 0 end) as seq, case when late then deadline * 1000 else s.us end as us,
                        case when late then 'failed' else status end as status, attempts, case when late then 'index' else s.stage end as stage, case when late then 'timed out' else error end as error, deadline
                    from (select s.*, e.us as now, coalesce(status = 'running' and e.us > deadline * 1000, false) as late from state s join event e on e.job_id = s.job_id and e.n = s.n + 1) s
                    join event e on e.job_id = s.job_id and e.n = s.n + 1))),
        last as (select * from state qualify row_number() over (partition by job_id order by n desc) = 1),
        ended as (select *, status = 'running' and deadline <= (select max(us) // 1000 - 86400000 from event) as over from last)
        select job_id, seq + (case when over then 1 else 0 end) as seq, case when over then deadline else us // 1000 end as at_ms, case when over then 'failed' else status end as status, attempts,
            case when over then 'index' else stage end as failed_stage, case when over then 'timed out' else error end as error
        from ended where seq > 0""",
    "stream_sessions": """
        with gaps as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval 1 day, true) as opens from events window w as (partition by user_id order by ts, event_id)),
        numbered as (select user_id, ts, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) as s from gaps)
        select user_id, floor(epoch(min(ts)))::bigint as session_start, count(*) as n from numbered group by user_id, s having max(ts) + interval 1 day <= (select max(ts) - interval 7 day from events)""",
}
