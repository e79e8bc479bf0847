"""Scores, slices and lexicons on rows written by hand, errors included."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import resumes, rules, text
from millrace.operators import evaluation, memory, metrics
from millrace.sources import sinks
from millrace.streaming import events


def test_confusion_with_unparsed_predictions(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), ("b", "b"), ("b", "zz")], "gold string, said string")
    got = {(r["gold"], r["predicted"]): r["n"] for r in metrics.confusion(rows, "gold", "said", ["a", "b", "c"]).collect()}
    assert len(got) == 12 and {k: n for k, n in got.items() if n} == {("a", "a"): 1, ("a", "b"): 1, ("a", "unparsed"): 1, ("b", "b"): 1}
    score = metrics.split_score(rows, "gold", "said", ["a", "b", "c"]).first()
    assert (score["rows"], score["unparsed"], score["accuracy"]) == (5, 1, 0.4)
    assert metrics.split_score(rows.limit(0), "gold", "said", ["a", "b"]).first()["accuracy"] == 0.0
    with pytest.raises(Exception, match="outside of the classes: b"):
        metrics.confusion(rows, "gold", "said", ["a", "c"]).collect()


def test_means_of_nothing_raise(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    assert metrics.mean(rows, "x").first()[0] == 1.5
    for empty in (rows.limit(0), rows.where("x is null")):
        with pytest.raises(Exception, match="no values of x"):
            metrics.mean(empty, "x").collect()


def test_churn_beats_noise(spark):
    lists = [spark.createDataFrame([(p,) for p in phrases], "phrase string") for phrases in (["Too  LOUD", "meh", "meh"], ["too loud", "bye", None])]
    rows = spark.createDataFrame([(1, " too loud ", "bug"), (2, "MEH", "bug"), (3, "bye", "feature"), (4, "else", "bug"), (5, None, "noise")], "id int, t string, c string")
    got = {r["id"]: (r["rule_class"], r["rule_reason"]) for r in evaluation.lexicon_classes(rows, *lists, content="t", fallback="c").collect()}
    assert got == {1: ("churn_signal", "lexicon_churn"), 2: ("noise", "lexicon_noise"), 3: ("churn_signal", "lexicon_churn"), 4: ("bug", "keep_generator"), 5: ("noise", "keep_generator")}
    with pytest.raises(Exception, match="outside of the classes: other"):
        evaluation.lexicon_classes(rows.withColumn("c", F.lit("other")), *lists, content="t", fallback="c").where("id = 4").collect()


def test_slices_with_shortfall_and_holdout(spark):
    rows = [(i, f"text {i % 7}", "bug") for i in range(20)] + [(100, "Held", "feature"), (101, "own", "feature"), (102, "OWN ", "feature"), (103, "x", "other"), (104, None, "noise")]
    df, held = spark.createDataFrame(rows, "id long, t string, c string"), spark.createDataFrame([("held",), ("text 3",), (None,)], "text string")
    picked, short = evaluation.stratified(df, held, id_col="id", content="t", label="c", per_class=4, seed="s")
    got = {}
    for r in picked.orderBy("class", "rank").collect():
        got.setdefault(r["class"], []).append(r["id"])
    import hashlib

    assert got == {"bug": sorted({0, 1, 2, 4, 5, 6}, key=lambda i: hashlib.sha256(f"s\n{i}".encode()).hexdigest())[:4], "feature": [101]}
    assert {r["class"]: r["shortfall"] for r in short.collect()} == {"noise": 4, "churn_signal": 4, "feature": 3}


def test_costs_and_small_rules(spark):
    calls = spark.createDataFrame([("p", "m", 1_000_000, 500_000), ("p", "m", None, None), ("p", "x", 1, 1), (None, "m", 1, 1)], "provider string, model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("p", "m", 0.5, 2.0)], "provider string, model string, input double, output double")
    assert [r["cost"] for r in evaluation.with_cost(calls, prices).collect()] == [1.5, 0.0, None, None]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(rules.asks_inventory(F.lit(m))) for m in ("Какие файлы есть?", "что доступно", "файл")] == [True, True, False]
    assert one(text.id_list(F.array(*map(F.lit, (" b ", "a", "", "b", " ", *map(str, range(20))))))) == ["b", "a", *map(str, range(20))]
    token = "0123abcd-" * 4
    assert [one(text.display_name(F.lit(n))) for n in (f"{token}_x.pdf", f"d/{token}_x.pdf", f"{token}_", f"{token}-x", "plain_x.pdf")] == ["x.pdf", "x.pdf", f"{token}_", f"{token}-x", "plain_x.pdf"]
    assert [one(text.is_russian(F.lit(t))) for t in ("Ж" * 21, "ж" * 20, "ж" * 21 + "a" * 22, "ж" * 21 + "漢" * 21)] == [True, False, False, True]
    assert one(rules.chunk_content(F.lit(" +7 912 345 67 89 a "), F.lit(None).cast("string"))) == "[PHONE] a"
    assert [one(F.length(resumes.excerpt(F.repeat(F.lit("x"), 9000), F.lit(k), 50))) for k in ("skills", "other", "page")] == [8000, 8000, 50]
    assert one(memory.feature_places("a", {"x": F.array(F.lit("b")), "y": F.array(F.lit("a"))})) and not one(memory.feature_places("c", {"x": F.array(F.lit("b")), "y": F.lit(None).cast("array<string>")}))


def test_events_and_results_that_go_out(spark):
    import json

    row = spark.createDataFrame([("j", "d", "b", "t", 3)], "job_id string, document_id string, bucket_id string, tenant_id string, chunks_indexed int")
    sent = sinks.indexed_events(row).first()
    assert sent["key"] == "d" and json.loads(sent["value"]) == {"event_type": "document.indexed", "job_id": "j", "document_id": "d", "bucket_id": "b", "tenant_id": "t", "chunks_indexed": 3}
    answers = spark.createDataFrame([("r", "s", "m", 1, ["a"]), ("r", "s", "m", 2, ["a", "b"]), ("r", "s", "n", 1, [])], "run_id string, scenario_id string, model string, created_at int, sources array<string>")
    got = {r["model"]: (r["source_count"], json.loads(r["quality_flags"])) for r in sinks.result_rows(answers, F.create_map(F.lit("ok"), F.size("sources") > 0)).collect()}
    assert got == {"m": (2, {"ok": True}), "n": (0, {"ok": False})}
    ticks = spark.createDataFrame([("k", 0), ("k", 59), ("k", 60)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r["window_start"], r["n"], r["expires_at"]) for r in events.expiring_counts(ticks, "k", "ts", 60, "1 minute").collect()) == [(0, 2, 61), (60, 1, 121)]
