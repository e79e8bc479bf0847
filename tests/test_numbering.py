"""Names found by automata and numbers counted by ranges, against plain Python."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import dictionary, named, numbering
from millrace.sources import files

NAMES = ["report", "port", "re", "отчёт", "a b", "aa", "aaa", "x", "reports 2024", "", None, "re"]
TEXTS = ["the report", "reports 2024 re", "aaaa", "ОТЧЁТ отчёт", None, "", "nothing", "a b a b", "xyz" * 5, "the report"]


@pytest.mark.parametrize("limits", [{}, {"block_names": 2}, {"block_chars": 5}])
def test_occurrences(spark, limits):
    texts = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "id int, body string, place_ string")
    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = Counter(tuple(r) for r in dictionary.occurrences(texts, names, text="body", name="n", **limits).select("id", "n", "place").collect())
    want = Counter((i, n, t.find(n)) for i, t in enumerate(TEXTS) if t for n in {n for n in NAMES if n} if n in t)
    assert got == want
    longest = {(r["id"], r["n"]) for r in dictionary.occurrences(texts, names, text="body", name="n", longest_only=True).collect()}
    assert longest == {(i, n) for i, n, _ in want if len(n) == max(len(m) for j, m, _ in want if j == i)}
    assert dictionary.occurrences(texts, names.limit(0), text="body", name="n").count() == 0
    assert dictionary.occurrences(texts.limit(0), names, text="body", name="n").columns == ["id", "place_", "n", "place"]


def test_rows_follow_messages_and_matches(spark):
    """A name of a thousand characters and a message of a hundred thousand give one row and no pieces."""
    long = "n" + "a" * 999
    docs = spark.createDataFrame([(1, f"{long}.pdf"), (2, "b.c.txt"), (3, "ab")], "document_id int, file_name string")
    messages = spark.createDataFrame([(1, "aaa " * 25_000 + long.upper()), (2, "see B C!"), (3, None)], "message_id int, message string")
    plan = named.documents_named(messages, docs, shortest=2)
    assert {tuple(r) for r in plan.collect()} == {(1, 1, 75_000), (2, 2, 3)}
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_deals_tie_only_at_the_greatest_length(spark):
    deals = spark.createDataFrame([("b1", "D-1", "Alpha plant", ["Alpha"]), ("b1", "D-2", "Alpha", None), ("b2", "D-1", "Gamma rays", ["alpha plant b"]), ("b3", "D-9", "", [])], "bucket_id string, deal_code string, title string, aliases array<string>")
    said = {1: "on ALPHA", 2: "alpha_plant now", 3: "alpha plant b", 4: "d-1?", 5: "gamma rays and d-2", 6: None, 7: " "}
    messages = spark.createDataFrame(list(said.items()), "message_id int, message string")
    for limits in ({}, {"block_names": 1}):
        got = {r["message_id"]: (r["bucket_id"], r["deal_code"]) for r in named.resolved_deal(messages, deals, **limits).collect()}
        assert got == {2: ("b1", "D-1"), 3: ("b2", "D-1"), 5: ("b2", "D-1")}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_numbers_without_gaps(spark, parts):
    rows = [("hot" if i % 3 else f"g{i % 5}" if i % 5 else None, 7 if i % 2 else (i * 37) % 101, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(9)
    got = numbering.numbered(df, ["o"], "n", group=["g"], parts=parts)
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["n"], r["o"], r["id"]))
    assert sum(map(len, by.values())) == 2000
    for group in by.values():
        group.sort()
        assert [n for n, _, _ in group] == list(range(len(group))) and [o for _, o, _ in group] == sorted(o for _, o, _ in group)
    assert sorted(r["n"] for r in numbering.numbered(df, ["id"], "n", parts=parts).collect()) == list(range(2000))
    assert [r["n"] for r in numbering.numbered(df, ["id"], "n", parts=parts).orderBy("id").collect()] == list(range(2000))
    assert numbering.numbered(df.limit(0), ["id"], "n", parts=parts).count() == 0


def test_no_range_holds_a_hot_group(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.lit(1).alias("o"), "id")
    got = numbering.numbered(df, ["o"], "n", group=["g"], parts=20)
    assert got.agg(F.count_distinct("n")).first()[0] == 20_000
    tagged = df.withColumn("_tag", F.monotonically_increasing_id()).repartitionByRange(20, "g", "o", "_tag")
    assert tagged.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 3000


def test_lines_are_numbered_across_splits(spark, tmp_path):
    blank = {5, 17}
    for name, n in (("a", 400), ("b", 30)):
        (tmp_path / f"{name}.jsonl").write_text("".join("  \n" if i in blank else json.dumps({"v": f"{name}{i}", "pad": "é" * 40}) + "\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.numbered_lines(spark, str(tmp_path), "v string")
        got = sorted((r["path"][-7], r["line"], r["v"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((n, i + 1, f"{n}{i}") for n, k in (("a", 400), ("b", 30)) for i in range(k) if i not in blank)
