"""Every query of the subpackage on empty tables, and on tables with nulls in all columns, repeated rows and foreign columns."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
#: The table whose rows a query returns one for one.
ROWS = {n: "pages" if n.startswith(("op4_", "op5_")) else "documents" for n in queries.QUERIES if n.split("_")[0] in ("op1", "op2", "op4", "op5", "op7", "op8", "op9", "op10", "op12")}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
        nulls = df.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
        clash = {"extra": F.lit(1), "id": F.lit("x"), "t": F.lit(2), "rank": F.lit(3), "fp": F.lit(4), "deviation": F.lit(5)}
        df.orderBy(df.columns[0]).limit(40).union(df.orderBy(df.columns[0]).limit(5)).union(nulls).withColumns(clash).write.parquet(f"{root}/nulls/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    whole = queries.QUERIES[name](spark, "/root/testdata/sf0.001").schema if name.startswith(("op5", "op9", "op11", "op12")) else None
    got = queries.QUERIES[name](spark, f"{folders}/empty")
    assert got.count() == 0 and (whole is None or [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in whole])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nulls_and_repeated_rows(spark, folders, name):
    got = queries.QUERIES[name](spark, f"{folders}/nulls").collect()
    if name in ROWS:
        assert len(got) == spark.read.parquet(f"{folders}/nulls/{ROWS[name]}.parquet").count() == 48
    elif name.startswith("op11"):
        assert len(got) == 45 * max(r["component"] for r in got) and got[0]["n"] == 45  # of the repeated rows, without the null ones
    elif name.startswith("op13"):
        assert {r["anchor_id"] for r in got} <= {0}
    else:
        assert got or name.startswith("op6")
