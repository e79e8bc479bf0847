"""Jobs and admissions as keyed streams: any cut into batches, events delivered again, and restarts after a failure."""

import datetime as dt
import heapq

import pytest
from pyspark.sql import functions as F

from millrace.streaming import events, keyed

EVENT = "job_id string, event_id string, kind string, tenant_id string, job_tenant_id string, stage string, error string, at timestamp"
START = dt.datetime(2024, 1, 1)
MINUTE = 60


def event(job, no, kind, minute, tenant="t1", stage=None, error=None):
    return (job, f"e{no:03}", kind, tenant, "t1", stage, error, START + dt.timedelta(minutes=minute))


JOBS = [
    event("a", 1, "requested", 0), event("a", 2, "completed", 5), event("a", 3, "requested", 6), event("a", 4, "failed", 7),
    event("b", 5, "requested", 1), event("b", 6, "failed", 2, stage="embed", error="no model"), event("b", 7, "retried", 3), event("b", 8, "requested", 4), event("b", 9, "failed", 9, stage="what", error="x"),
    event("c", 10, "requested", 2, tenant="t2"), event("c", 11, "requested", 3, tenant=" "), event("c", 12, "requested", 4, tenant=None), event("c", 13, "completed", 5),
    event("d", 14, "requested", 3), event("d", 15, "completed", 50), event("d", 16, "retried", 51), event("d", 17, "requested", 52, tenant=" t1 "),
    event("e", 18, "requested", 5), event("f", 19, "requested", 6), event("f", 20, "requested", 7), event("f", 21, "completed", 8),
    event("z", 99, "completed", 1000), (None, "e100", "requested", "t1", "t1", None, None, START), event("g", 22, None, 8),
]
#: job: states with the minute, attempts and stage of each; a job times out after 30 minutes
STATES = {
    "a": [("running", 0, 1, None), ("completed", 5, 1, None)],
    "b": [("running", 1, 1, None), ("failed", 2, 1, "embed"), ("pending", 3, 1, None), ("running", 4, 2, None), ("failed", 9, 2, "index")],
    "d": [("running", 3, 1, None), ("failed", 33, 1, "index"), ("pending", 51, 1, None), ("running", 52, 2, None), ("failed", 82, 2, "index")],
    "e": [("running", 5, 1, None), ("failed", 35, 1, "index")],
    "f": [("running", 6, 1, None), ("running", 7, 2, None), ("completed", 8, 2, None)],
}


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, out, checkpoint, plan, schema=EVENT, fail_in=None, mode="update"):
    """The stream one file a batch; a batch whose number is `fail_in` raises after it has written."""

    def handle(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if batch == fail_in:
            raise RuntimeError("lost")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    with keyed.keyed_state(spark):
        query = events.consume(plan(rows), handle, checkpoint, mode)
    try:
        query.awaitTermination()
    except Exception:
        assert fail_in is not None
    return query


def jobs_plan(rows):
    return keyed.job_transitions(rows, timeout_seconds=30 * MINUTE, late="10 minutes")


def states(spark, out):
    found = {}
    for r in spark.read.parquet(out).orderBy("job_id", "seq").collect():
        found.setdefault(r["job_id"], []).append((r["status"], r["at_us"], r["attempts"], r["failed_stage"], r["seq"]))
    return found


def expected():
    at = lambda minute: int((START - dt.datetime(1970, 1, 1)).total_seconds() + minute * 60) * 1_000_000
    return {job: [(s, at(m), n, stage, i + 1) for i, (s, m, n, stage) in enumerate(rows)] for job, rows in STATES.items()}


@pytest.mark.parametrize("cut", [1, 4, 40])
def test_states_whatever_the_batches(spark, tmp_path, cut):
    rows = sorted(JOBS, key=lambda r: r[-1])
    for i in range(0, len(rows), cut if cut > 1 else 7):
        write(spark, tmp_path / "in", f"{i:03}", rows[i : i + (cut if cut > 1 else 7)])
        if cut == 4:  # delivered again in the next batch
            write(spark, tmp_path / "in", f"{i:03}b", rows[i : i + cut])
    run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), jobs_plan)
    assert states(spark, str(tmp_path / "out")) == expected()
    errors = {r["error"] for r in spark.read.parquet(str(tmp_path / "out")).where("status = 'failed'").collect()}
    assert errors == {"no model", "x", keyed.TIMED_OUT}


@pytest.mark.parametrize("fail_in", [0, 2])
def test_states_after_a_restart(spark, tmp_path, fail_in):
    rows = sorted(JOBS, key=lambda r: r[-1])
    for i in range(0, len(rows), 6):
        write(spark, tmp_path / "in", f"{i:03}", rows[i : i + 6])
    where = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), jobs_plan
    run(spark, *where, fail_in=fail_in)
    assert states(spark, where[1]) != expected()
    run(spark, *where)
    assert states(spark, where[1]) == expected()
    run(spark, *where)  # nothing new
    assert states(spark, where[1]) == expected()


REQUEST = "user string, request long, at timestamp"


def requests(n=600):
    made = [("hot" if i % 3 else f"u{i % 7}", i, START + dt.timedelta(seconds=17 * (i - i % 5))) for i in range(n)]
    return made + [(None, 10_000, START), ("hot", None, START), ("hot", 10_001, None)]


def decisions(rows, seconds, limit):
    first = {}
    for user, request, at in rows:
        if None not in (user, request, at):
            first.setdefault((user, int(at.replace(tzinfo=dt.UTC).timestamp()) // seconds), []).append((at, request))
    allowed = {r for group in first.values() for _, r in heapq.nsmallest(limit, group)}
    return {r: r in allowed for group in first.values() for _, r in group}


@pytest.mark.parametrize(("cut", "fail_in"), [(1000, None), (90, None), (90, 1), (90, 3)])
def test_admission_inside_the_stream(spark, tmp_path, cut, fail_in):
    rows = requests()
    schema = REQUEST
    for i in range(0, len(rows), cut):
        spark.createDataFrame(rows[i : i + cut], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:05}"))
    plan = lambda s: keyed.admissions(s, scope="user", request_id="request", ts="at", seconds=600, limit=4, late="1 minute")
    where = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), plan, schema
    if fail_in is not None:
        run(spark, *where, fail_in=fail_in, mode="append")
    query = run(spark, *where, mode="append")
    made = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(made) == 600 and {r["request_id"]: r["allowed"] for r in made} == decisions(rows, 600, 4)
    # of 17 windows and 8 scopes only the last windows' counters are left
    if cut == 90:
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert left <= 2 * 8 * 2, left


def test_the_setting_of_other_streams_stays(spark):
    before = spark.conf.get(keyed.PROVIDER)
    with keyed.keyed_state(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKSDB
    assert spark.conf.get(keyed.PROVIDER) == before
    assert spark.range(1).select(F.lit(1)).count() == 1
