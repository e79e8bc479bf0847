"""Stored rows: merges touch the buckets that change and no others; ingest cuts what changed; CSV files have headers of their own."""

import hashlib
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, ingest, store, tables

ROW = "id long, name string, version long"


def contents(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in Path(path).rglob("*.parquet")}


def rows(spark, path):
    return sorted((tuple(r) for r in store.read(spark, path, ["id"]).select("id", "name", "version").collect()), key=str)


def test_a_merge_replaces_changed_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.read(spark, path, ["id"]) is None
    first = spark.createDataFrame([(i, f"n{i}", 1) for i in range(200)] + [(5, "older", 0), (None, "no id", 1)], ROW)
    assert store.merge(spark, path, first, ["id"], newest=["version"], buckets=8) == list(range(8))
    want = {i: (i, f"n{i}", 1) for i in range(200)}
    assert rows(spark, path) == sorted(want.values(), key=str)
    before = contents(path)
    assert store.merge(spark, path, first, ["id"], newest=["version"], buckets=8) == [] and contents(path) == before
    one = spark.createDataFrame([(7, "seven", 2), (7, "six", 1), (8, "n8", 1)], ROW)
    (bucket,) = store.merge(spark, path, one, ["id"], newest=["version"], buckets=8)
    want[7] = (7, "seven", 2)
    after = contents(path)
    own = f"{store.BUCKET}={bucket}/"
    assert {k: v for k, v in after.items() if own not in k} == {k: v for k, v in before.items() if own not in k}
    assert rows(spark, path) == sorted(want.values(), key=str)
    with pytest.raises(ValueError, match="buckets"):
        store.merge(spark, path, one, ["id"], buckets=9)


def test_deletions_empty_a_bucket(spark, tmp_path):
    path = str(tmp_path / "s")
    none = spark.createDataFrame([], ROW)
    assert store.merge(spark, path, none, ["id"], buckets=4) == [] and store.read(spark, path, ["id"]) is None
    store.merge(spark, path, spark.createDataFrame([(i, None, None) for i in range(40)], ROW), ["id"], buckets=4)
    odd = spark.createDataFrame([(i,) for i in range(60) if i != 3], "id long")
    assert store.merge(spark, path, spark.createDataFrame([(4, "back", 1)], ROW), ["id"], deleted=odd, buckets=4)
    assert rows(spark, path) == [(3, None, None), (4, "back", 1)]
    store.merge(spark, path, none, ["id"], deleted=spark.range(100), buckets=4)
    assert rows(spark, path) == [] and store.merge(spark, path, none, ["id"], deleted=spark.range(100), buckets=4) == []


def test_keys_of_several_columns_and_none_besides(spark, tmp_path):
    path = str(tmp_path / "s")
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None)], "x long, y string")
    store.merge(spark, path, pairs, ["x", "y"], buckets=2)
    assert store.merge(spark, path, pairs, ["x", "y"], buckets=2) == []
    assert sorted(map(tuple, store.read(spark, path, ["x", "y"]).collect())) == [(1, "a"), (1, "b")]


NOW = "2024-06-01 00:00:00"


def stored(spark, where):
    points = store.read(spark, where["points"], ["point_id"])
    return {} if points is None else {(r["path"].rsplit("/", 1)[-1], r["chunk_index"]): r["content"] for r in points.collect()}


def test_three_runs_over_a_changing_folder(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    long = "".join(f"word{i} " for i in range(1200))  # several chunks
    (folder / "a.md").write_text("# A\nfirst")
    (folder / "deep" / "b.txt").write_text(long)
    (folder / "c.csv").write_text("x,y\n1,2\n3,4\n")
    (folder / "d.csv").write_text("other\nheader\n")
    where = {"ledger": str(tmp_path / "ledger"), "points": str(tmp_path / "points"), "buckets": 32}
    go = lambda **more: ingest.ingest_folder(spark, str(folder), now=F.lit(NOW).cast("timestamp"), **where, **more)
    first = go()
    pieces = len(stored(spark, where)) - 4
    assert (first.added, first.changed, first.removed, first.points_put) == (4, 0, 0, pieces + 4) and pieces > 3
    assert stored(spark, where)["c.csv", 1] == "x: 3\ny: 4" and stored(spark, where)["d.csv", 0] == "other: header"
    before = contents(where["points"])
    again = go()
    assert (again.added, again.changed, again.removed, again.points_put, again.buckets) == (0, 0, 0, 0, []) and contents(where["points"]) == before
    # touched but not changed: opened, compared, not cut
    os.utime(folder / "a.md", (time.time() + 100, time.time() + 100))
    assert (go().points_put, contents(where["points"])) == (0, before)
    assert {r["stamp"].split("/")[0] for r in ingest.known(spark, where["ledger"]).where("path like '%a.md'").collect()} == {"9"}
    # one new, one shorter, one gone
    (folder / "new.md").write_text("new")
    (folder / "deep" / "b.txt").write_text("short")
    (folder / "c.csv").unlink()
    third = go()
    assert (third.added, third.changed, third.removed, third.points_put, third.points_deleted) == (1, 1, 1, 2, pieces - 1 + 2)
    assert stored(spark, where) == {("a.md", 0): "# A\nfirst", ("b.txt", 0): "short", ("d.csv", 0): "other: header", ("new.md", 0): "new"}
    replaced = {int(k.split(f"{store.BUCKET}=")[1].split("/")[0]) for k, v in contents(where["points"]).items() if before.get(k) != v}
    assert replaced == set(third.buckets) and len(replaced) < 32
    # staged files expire, by a run or by the sweeper
    expiry = spark.createDataFrame([(f"file://{folder}/new.md", "2024-05-31"), (f"file://{folder}/a.md", "2024-06-02")], "path string, at string").select("path", F.col("at").cast("timestamp").alias("expires_at"))
    assert go(expiry=expiry).removed == 1 and ("new.md", 0) not in stored(spark, where)
    swept = ingest.sweep(spark, now=F.lit("2024-06-03").cast("timestamp"), **where)
    assert (swept.removed, swept.points_deleted, swept.points_put) == (1, 1, 0) and set(stored(spark, where)) == {("b.txt", 0), ("d.csv", 0)}


def test_a_run_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    where = {"ledger": str(tmp_path / "ledger"), "points": str(tmp_path / "points"), "buckets": 4}
    source = lambda texts: spark.createDataFrame([(k, t, None) for k, t in texts.items()], "path string, content string, expires_at timestamp")
    merge, calls = store.merge, []

    def breaks(spark, path, *args, **more):
        calls.append(path)
        if path == where["ledger"]:
            raise RuntimeError("lost")
        return merge(spark, path, *args, **more)

    monkeypatch.setattr(store, "merge", breaks)
    with pytest.raises(RuntimeError):
        ingest.ingest_rows(spark, source({"a": "one", "b": None}), now=F.lit(NOW).cast("timestamp"), **where)
    monkeypatch.undo()
    assert calls == [where["points"], where["ledger"]]
    run = ingest.ingest_rows(spark, source({"a": "one", "b": None}), now=F.lit(NOW).cast("timestamp"), **where)
    assert (run.added, run.points_put, run.buckets) == (2, 2, []) and stored(spark, where) == {("a", 0): "one", ("b", 0): ""}
    (sha,) = (r["sha256"] for r in ingest.known(spark, where["ledger"]).where("path = 'a'").collect())
    assert sha == hashlib.sha256(b"one").hexdigest()
    assert ingest.ingest_rows(spark, source({}), now=F.lit(NOW).cast("timestamp"), **where).removed == 2 and stored(spark, where) == {}


# --- CSV


@pytest.fixture(scope="module")
def csvs(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")
    (root / "x").mkdir()
    (root / "a.csv").write_text('id,feature,body\n1,"x, y","two\nlines"\n2,,\n\n3,z\n')
    (root / "x" / "b.csv").write_text("﻿name,n\nann,1\nbob,2,9\n")
    (root / "empty.csv").write_text("")
    (root / "bare.csv").write_text("h1,h2")
    (root / "no.txt").write_text("x,y\n1,2\n")
    (root / "big.csv").write_text("a,b\n" + "".join(f"{i},v{i}\n" for i in range(3000)))
    return str(root)


def test_each_file_has_its_header(spark, csvs):
    got = [(r.path.rsplit("/", 1)[-1], r.names, r.cells) for r in tables.read_csv(spark, [f"{csvs}/a.csv", f"file:{csvs}/x", f"{csvs}/empty.csv", f"{csvs}/bare.csv"]).orderBy("path", "at").collect()]
    assert got == [
        ("a.csv", ["id", "feature", "body"], ["1", "x, y", "two\nlines"]), ("a.csv", ["id", "feature", "body"], ["2", "", ""]), ("a.csv", ["id", "feature", "body"], ["3", "z", ""]),
        ("b.csv", ["name", "n"], ["ann", "1"]), ("b.csv", ["name", "n"], ["bob", "2", "9"]),
    ]
    docs = {r.title: r for r in files.csv_rows(spark, [f"{csvs}/a.csv", f"{csvs}/x/b.csv"]).collect()}
    assert docs["bob"].content == "name: bob\nn: 2" and docs["1"].features == ["x", "y"] and docs["2"].metadata == {"id": "2", "feature": "", "body": ""}
    with pytest.raises(Exception, match="FileNotFoundError|not.*there"):
        tables.read_csv(spark, f"{csvs}/not there").collect()


@pytest.mark.parametrize("split", [997, 4096, 1 << 20])
def test_ranges_of_bytes_hold_each_record_once(spark, csvs, split):
    read = tables.read_csv(spark, f"{csvs}/big.csv", multiline=False, split_bytes=split)
    got = sorted((int(r.cells[0]), r.cells[1], r.at) for r in read.collect())
    lines, at = Path(f"{csvs}/big.csv").read_text().splitlines(keepends=True), 4
    for (i, v, place), line in zip(got, lines[1:], strict=True):
        assert (f"{i},{v}\n", place) == (line, at)
        at += len(line)
    assert read.rdd.getNumPartitions() == max(1, -(-at // split))


def test_conditions_on_paths_are_pushed_down(spark, csvs):
    path = f"file://{csvs}/x/b.csv"
    for condition in (F.col("path") == path, F.col("path").isin(path, "y"), F.col("path").endswith("/b.csv"), F.col("path").startswith(f"file://{csvs}/x"), F.col("path").contains("/x/")):
        read = tables.read_csv(spark, csvs).where(condition)
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert " Filter " not in plan and read.rdd.getNumPartitions() == 1 and read.count() == 2, plan
    kept = tables.read_csv(spark, csvs).where(F.col("path").contains("/x/") & (F.col("at") > 10))
    assert kept._jdf.queryExecution().executedPlan().toString().count("contains") == 0 and kept.count() == 1
