"""Queries that store rows, merge others into them and read the outcome, with the same in SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, evaluation, retrieval
from ..operators.lineage import shared_folder
from ..sources import archives, files, ingest, sinks, store, tables
from . import catalogue, reports


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the orders, then a merge with new prices and later versions for half of them, deletions included."""
    path = shared_folder(spark, "orders")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").withColumn("version", F.lit(1).cast("long"))
    store.merge(spark, path, orders.where("o_orderkey % 4 <> 3"), ["o_orderkey"], newest=["version"], buckets=16)
    odd = orders.where("o_orderkey % 2 = 1")
    later = odd.withColumns({"version": F.lit(2).cast("long"), "o_totalprice": F.col("o_totalprice") + 1}).union(odd.where("o_orderkey % 3 = 0").withColumns({"version": F.lit(3).cast("long"), "o_orderstatus": F.lit("X")}))
    gone = orders.where("o_orderkey % 10 = 0").select("o_orderkey")
    for _ in range(2):  # the second time changes nothing
        store.merge(spark, path, later, ["o_orderkey"], newest=["version"], deleted=gone, buckets=16)
    return store.read(spark, path, ["o_orderkey"])


def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over changing documents: two thirds of them; all, some with other texts; then some gone and some expired."""
    where = {"ledger": shared_folder(spark, "ledger"), "points": shared_folder(spark, "points"), "buckets": 16}
    docs = _read(spark, sf_dir, "documents")
    sources = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.when(F.col("doc_id") % 11 == 0, F.lit("2024-01-03").cast("timestamp")).alias("expires_at"), "doc_id")
    now = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    ingest.ingest_rows(spark, sources.where("doc_id % 3 <> 0"), now=now(1), **where)
    shorter = sources.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.substring("content", 1, 1000)).otherwise(F.col("content")))
    ingest.ingest_rows(spark, shorter, now=now(2), **where)
    ingest.ingest_rows(spark, shorter.where("doc_id % 7 <> 0"), now=now(3), **where)
    # digests travel to the ledger, not the chunks
    points = store.read(spark, where["points"], ["point_id"]).select("path", "chunk_index", F.md5("content").alias("chunk_md5"))
    ledger = ingest.known(spark, where["ledger"]).select("path", "n_chunks")
    return points.join(ledger, "path").select(F.col("path").cast("long").alias("doc_id"), "chunk_index", "chunk_md5", "n_chunks")


def summaries_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations after their first half and after all of their turns: where a summary is due it is made and stored."""
    path = shared_folder(spark, "summaries")
    said = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    for share in (0.5, 1.0):
        turns = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
        now = said.join(turns, "conv_id").where(F.col("turn") < F.ceil(F.col("turns") * share))
        sinks.summarised(spark, path, now, key="conv_id", order="turn", buckets=16)
    return store.read(spark, path, ["conv_id"])


def csv_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as CSV files, each with a header of its own, of which the paths in the condition are opened only."""
    folder = shared_folder(spark, "csv")
    for name in ("nation", "supplier", "customer"):
        frame = _read(spark, sf_dir, name)
        frame = frame.select(*(c for c in frame.columns if not c.endswith("acctbal")))
        frame.select(*(F.col(c).cast("string") for c, _ in frame.dtypes)).write.option("header", True).csv(f"{folder}/{name}")
    rows = reduce(DataFrame.unionByName, (tables.read_csv(spark, folder).where(F.col("path").contains(f"/{name}/")) for name in ("nation", "supplier")))
    cells = rows.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("source"), F.explode(F.arrays_zip("names", "cells")).alias("c"))
    return cells.groupBy("source", F.col("c.names").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c.cells").alias("n_distinct"), F.min("c.cells").alias("least"), F.max("c.cells").alias("most"))


def vector_topk_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ten rows as of a search through all vectors, from cells read in the order of their bounds."""
    path = shared_folder(spark, "cells")
    cells.build(_read(spark, sf_dir, "embeddings"), path, id_col="vec_id", cells=16)
    found = cells.search(spark, path, catalogue.QUERY_VECTOR, 10, id_col="vec_id", where=F.col("label") != 4)
    return found.rows.select("vec_id", "label", F.round("score", 4).alias("score"))


def scroll_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 40 rows with certain labels, by id."""
    rows, where = _read(spark, sf_dir, "embeddings"), retrieval.payload_filter(among={"label": [1, 3, 5]})
    first = retrieval.scroll(rows, 40, id_col="vec_id", where=where)
    return retrieval.scroll(rows, 40, id_col="vec_id", where=where, after=first.agg(F.max("vec_id")).first()[0]).select("vec_id", "label", "score")


def archived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as members of archives, with names that repeat, and read back from these."""
    folder = shared_folder(spark, "archives")
    docs = _read(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("/"), (F.col("doc_id") % 20).cast("string"), F.lit(".md"))
    archives.write_archives(docs.select(F.col("doc_id").alias("path"), name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), folder)
    members = archives.read_archives(spark, folder)
    return members.select("name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus written as files, and its manifest, report and cleaned rows read back from these."""
    folder = shared_folder(spark, "corpus")
    rows = reports.corpus(spark, sf_dir)
    named = {"content": "text", "generated": "generated", "ruled": "ruled", "is_copy": "is_copy", "scenario": "scenario", "flag": "flag"}
    sinks.write_corpus(rows.select("doc_id", "generated", "text"), rows, f"{folder}/out", f"{folder}/holdout", id_col="doc_id", **named)
    manifest = files.jsonl(spark, f"{folder}/out/manifest", "name string, label string, n long")
    report = files.jsonl(spark, f"{folder}/out/report", "kind string").groupBy(F.lit("report").alias("name"), F.col("kind").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    cleaned = files.jsonl(spark, f"{folder}/out/cleaned", "doc_id long, text string").agg(F.lit("cleaned").alias("name"), F.lit("characters").alias("label"), F.sum(F.length("text")).cast("long").alias("n"))
    return manifest.unionByName(report).unionByName(cleaned)


QUERIES = {f.__name__: f for f in (stored_upsert, ingested_documents, summaries_upserted, csv_by_header, vector_topk_by_cells, scroll_filtered, archived_documents, corpus_files)}
_CSV = " union all ".join(
    f"select '{table}' as source, '{name}' as name, count(*) as n, count(distinct {name}) as n_distinct, min({name}::varchar) as least, max({name}::varchar) as most from {table}"
    for table, names in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("supplier", ("s_suppkey", "s_name", "s_nationkey")))
    for name in names
)
ORACLE_SQL = {
    "stored_upsert": """
        select o_orderkey, o_custkey, case when o_orderkey % 2 = 1 and o_orderkey % 3 = 0 then 'X' else o_orderstatus end as o_orderstatus,
            case when o_orderkey % 2 = 1 and o_orderkey % 3 <> 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
            (case when o_orderkey % 2 = 0 then 1 when o_orderkey % 3 = 0 then 3 else 2 end)::bigint as version
        from orders where (o_orderkey % 4 <> 3 or o_orderkey % 2 = 1) and o_orderkey % 10 <> 0""",
    "ingested_documents": r"""
        with d as (select doc_id, regexp_replace(case when doc_id % 5 = 0 then substr(coalesce(text, ''), 1, 1000) else coalesce(text, '') end, '^\s+|\s+$', '', 'g') as t from documents where doc_id % 7 <> 0 and doc_id % 11 <> 0),
        c as (select doc_id, unnest(case when length(t) <= 1800 then [0] else range(0, greatest(length(t) - 200, 1), 1600) end) as s, t from d),
        k as (select doc_id, s, regexp_replace(substr(t, (s + 1)::bigint, 1800), '^\s+|\s+$', '', 'g') as chunk, length(t) <= 1800 as whole from c)
        select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_index, md5(chunk) as chunk_md5, count(*) over (partition by doc_id) as n_chunks from k where whole or chunk <> ''""",
    "summaries_upserted": """
        with turns as (select conv_id, count(*) as turns from conversations group by 1),
        said as (select share, c.conv_id, turn, role, coalesce(text, '') as t from conversations c join turns using (conv_id), (values (0.5), (1.0)) s(share) where turn < ceil(turns * share)),
        counted as (
            select share, conv_id, count(*) as n, sum(case when t = '' then 0 else greatest(1, floor(length(t) / 4)) end) as tokens,
                coalesce(string_agg(substr(t, 1, 40), ' / ' order by turn) filter (role = 'user' and place <= 2), '') as summary
            from (select *, row_number() over (partition by share, conv_id, role order by turn desc) as place from said) group by 1, 2),
        half as (select *, case when n >= 8 then 'message_count' when tokens >= 600 then 'token_estimate' end as due from counted where share = 0.5),
        whole as (
            select c.*, case when h.due is null then case when c.n >= 8 then 'message_count' when c.tokens >= 600 then 'token_estimate' end when c.n - h.n >= 4 then 'stale' end as due
            from counted c left join half h on c.conv_id = h.conv_id where c.share = 1.0)
        select conv_id, n as messages, tokens::bigint as tokens, summary, due as reason from whole where due is not null
        union all select conv_id, n, tokens::bigint, summary, due from half where due is not null and conv_id not in (select conv_id from whole where due is not null)""",
    "csv_by_header": _CSV,
    "vector_topk_by_cells": catalogue.ORACLE_SQL["vector_topk"].replace("from embeddings", "from embeddings where label <> 4"),
    "corpus_files": f"""
        with c as ({reports._CORPUS}), k as (select unnest({list(evaluation.CLASSES)}) as label),
        t as (select len(regexp_extract_all(text, '\\+7[\\s(-]*\\d{{3}}[\\s)-]*\\d{{3}}[\\s-]*\\d{{2}}[\\s-]*\\d{{2}}')) as phones, len(regexp_extract_all(text, '\\b\\d{{4}}[ -]?\\d{{4}}[ -]?\\d{{4}}[ -]?\\d{{4}}\\b')) as cards from c),
        m as (
            select 'total' as name, 'before' as label, (select count(*) from c where not is_copy) as n union all select 'total', 'after', (select count(*) from c)
            union all select 'before', label, (select count(*) from c where generated = label and not is_copy) from k union all select 'after', label, (select count(*) from c where ruled = label) from k
            union all select 'shortest', label, (select min(length(text)) from c where ruled = label) from k union all select 'longest', label, (select max(length(text)) from c where ruled = label) from k
            union all select 'indexed', label, (select count(*) from c where ruled = label and flag) from k where label in ('bug', 'feature') union all select 'scenarios', label, (select count(distinct scenario) from c where ruled = label) from k where label in ('bug', 'feature')
            union all select 'missing_scenario', 'product', (select count(*) from c where ruled in ('bug', 'feature') and scenario is null) union all select 'pii', 'phone', (select sum(phones) from t) union all select 'pii', 'card', (select sum(cards) from t)
            union all select 'report', 'mismatch', (select count(*) from c where generated <> ruled) union all select 'report', 'suppressed', (select count(*) from c where reason = 'exact_duplicate')
            union all select 'cleaned', 'characters', (select sum(length(text)) from c))
        select name, label, n::bigint as n from m where n is not null""",
    "scroll_filtered": "select vec_id, label, null::double as score from embeddings where label in (1, 3, 5) order by vec_id limit 40 offset 40",
    "archived_documents": """
        with d as (select doc_id, case when doc_id % 2 = 0 then upper(lang) else lang end || '/' || (doc_id % 20) as stem, coalesce(text, '') as text from documents),
        n as (select *, row_number() over (partition by lower(stem) order by doc_id) as n from d)
        select stem || case when n > 1 then '-' || n else '' end || '.md' as name, strlen(text)::bigint as size, sha256(text) as sha256 from n""",
}
