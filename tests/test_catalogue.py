"""Every query of the main library against its SQL in DuckDB, whole results compared."""

import math

import duckdb
import pytest

from millrace.plans import catalogue, intents, questions, reports, scoring, services, stores, streams  # noqa: F401
from millrace.plans.views import BASE

SF = "/root/testdata/sf0.001"
PLANS = (catalogue, intents, streams, stores, scoring, services)
QUERIES = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) and not math.isnan(value) else repr(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, duck, name):
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted(tuple(map(plain, r)) for r in found)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_joint_caps_takes_rows_wherever_they_stand(spark, tmp_path):
    langs = ["en"] * 30 + ["de", None, "", None, "de", "fr", None, "en"]
    docs = [(i, "ab"[i % 2], lang, 3000 if i % 3 else 10) for i, lang in enumerate(langs * 2)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for source in "ab":
        kept = []
        for i, s, lang, n in docs:
            size = "long" if n > 2000 else "short"
            if s == source and not (lang and sum(k[2] == lang for k in kept) >= 2) and sum(k[3] == size for k in kept) < 3:
                kept.append((source, i, lang, size))
        want.update(kept)
    got = [tuple(r) for r in QUERIES["joint_caps"](spark, str(tmp_path)).select("source", "doc_id", "lang", "size_class").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
