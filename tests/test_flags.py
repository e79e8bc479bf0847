"""Every kind of check, from rows, on answers written by hand."""

import pytest

from millrace.operators import flags

SOURCES = [
    ("pdf", "a/b.PDF", "b1", "t1", ["sync"], {"page_number": "3", "linked_text": "В Пятницу: 3500"}),
    ("image_digest", "c.png", None, "t1", None, {"parent_source_type": "docx", "embedded_path": "legacy-binary/1"}),
    ("deal_card", None, "b2", None, None, None),
]
FACTS = {"hints.metric": "true", "retrieval.final": "2", "memory.tokens": "80", "memory.budget": "100", "query": "about Permissions", "blank": " "}
LISTS = {"memory.included": ["summary", "recent"], "retrieval.buckets": ["b1", "b2", None], "current": ["billing"]}
ANSWER = ("s", "Growth of 1 250,50 Euro on Monday, and 7", SOURCES, FACTS, LISTS)

CASES = [  # kind, field, args, holds, holds for an empty answer
    ("response_filled", None, [], True, False),
    ("response_has", None, [["euro", "usd"], ["monday"]], True, False),
    ("response_has", None, [["euro"], ["friday"]], False, False),
    ("response_has_any", None, [["Friday"], ["MONDAY"]], True, False),
    ("response_lacks", None, [["%"], ["dollar"]], True, True),
    ("response_lacks", None, [["growth"]], False, True),
    ("response_numbers", None, [["1250.5"], ["7", "8"]], True, False),
    ("response_numbers", None, [["50"]], False, False),
    ("response_value", None, [["2024", "1,250.50"]], True, False),
    ("response_value", None, [["on monday"]], True, False),
    ("response_value", None, [["x"]], False, False),
    ("fact_filled", "query", [], True, False),
    ("fact_filled", "blank", [], False, False),
    ("fact_is", "hints.metric", [["true"]], True, False),
    ("fact_is", "none", [["true"]], False, False),
    ("fact_is_not", "none", [["true"]], True, True),
    ("fact_is_not", "hints.metric", [["true"]], False, True),
    ("fact_above", "retrieval.final", [["0"]], True, False),
    ("fact_within", "memory.tokens", [["memory.budget"]], True, True),
    ("fact_within", "memory.budget", [["memory.tokens"]], False, True),
    ("list_has", "memory.included", [["summary"], ["recent", "x"]], True, False),
    ("list_has", "memory.included", [["goals"]], False, False),
    ("list_lacks", "retrieval.buckets", [["b9"]], True, True),
    ("list_lacks", "retrieval.buckets", [["b9", "b2"]], False, True),
    ("list_is", "retrieval.buckets", [["b2", "b1"]], True, False),
    ("list_is", "retrieval.buckets", [["b2"]], False, False),
    ("feature", "query", [["permissions"]], True, False),
    ("feature", "query", [["sync"]], True, False),
    ("feature", None, [["billing"]], True, False),
    ("feature", "query", [["search"]], False, False),
    ("sources_any", None, [], True, False),
    ("source_types", None, [["pdf", "docx"], ["image_digest"]], True, False),
    ("source_types", None, [["docx"]], False, False),
    ("source_path_ends", None, [["pdf"], [".pdf", ".PDF"]], True, False),
    ("source_buckets_known", None, [["image_digest"]], False, False),
    ("source_buckets_known", None, [["pdf"]], True, False),
    ("source_meta_filled", "page_number", [["pdf"]], True, False),
    ("source_meta_filled", "page_number", [["image_digest", "deal_card"]], False, False),
    ("source_meta_is", "parent_source_type", [["image_digest"], ["docx", "xlsx"]], True, False),
    ("source_meta_is", "parent_source_type", [["image_digest"], ["xls"]], False, False),
    ("source_meta_starts", "embedded_path", [["image_digest"], ["legacy-binary/"]], True, False),
    ("source_meta_has", "linked_text", [["pdf"], ["пятниц"], ["3500", "3 500"]], True, False),
    ("source_meta_has", "linked_text", [["pdf"], ["четверг"]], False, False),
    ("buckets_known", None, [], True, False),
    ("buckets_within", None, [["b1", "b2", "b3"]], True, False),
    ("buckets_within", None, [["b1"]], False, False),
    ("buckets_without", None, [["b3"]], True, True),
    ("buckets_without", "deal_card", [["b1"]], True, True),
    ("buckets_without", "deal_card", [["b2"]], False, True),
    ("tenants_are", None, [["t1"]], True, False),
    ("tenants_are", None, [["t1", "t2"]], False, False),
]


def test_every_kind(spark):
    assert {c[0] for c in CASES} | {"all_of"} == set(flags.KINDS) == set(flags._checks()) | {"all_of"}
    rules = [("s", f"f{i:02}", kind, field, args) for i, (kind, field, args, _, _) in enumerate(CASES)]
    answers = [(1, *ANSWER), (2, "s", None, None, None, None)]
    df = spark.createDataFrame(answers, f"id int, {flags.ANSWER}")
    got = {r["id"]: r["flags"] for r in flags.flagged(df, spark.createDataFrame(rules, flags.RULE)).collect()}
    for i, (kind, field, args, full, empty) in enumerate(CASES):
        assert (got[1][f"f{i:02}"], got[2][f"f{i:02}"]) == (full, empty), (kind, field, args)


def test_rules_of_other_scenarios_and_of_all(spark):
    rules = [("s", "a", "sources_any", None, None), ("s", "b", "response_has", None, [["growth"]]), ("s", "b", "response_has", None, [["friday"]]), ("s", "both", "all_of", None, [["a", "any"]]), ("s", "not both", "all_of", None, [["a", "b"]]), ("s", "unknown", "all_of", None, [["a", "zz"]]), ("other", "c", "sources_any", None, []), (flags.EVERY, "any", "response_filled", None, [])]
    answers = [(1, *ANSWER), (2, "other", "", None, None, None), (3, "none", "x", None, None, None), (4, None, "x", None, None, None)]
    df = spark.createDataFrame(answers, f"id int, {flags.ANSWER}")
    got = {r["id"]: r["flags"] for r in flags.flagged(df, spark.createDataFrame(rules, flags.RULE)).collect()}
    assert got == {1: {"a": True, "b": False, "any": True, "both": True, "not both": False, "unknown": False}, 2: {"c": False, "any": False}, 3: {"any": True}, 4: {"any": True}}
    assert {r["id"]: r["flags"] for r in flags.flagged(df, spark.createDataFrame([], flags.RULE)).collect()} == {i: {} for i in (1, 2, 3, 4)}
    with pytest.raises(Exception, match="unknown kind of check: guess"):
        flags.flagged(df, spark.createDataFrame([("s", "a", "guess", None, [])], flags.RULE)).collect()
