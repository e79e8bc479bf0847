"""Queries on what services write, read and may do: access, jobs, logs, events, files and résumés, fed by the tables' columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, resumes, rules, text
from ..operators import access, memory, metrics, scope
from ..operators.lineage import shared_folder
from ..sources import files, sinks
from ..streaming import events
from .catalogue import Query
from .questions import literal

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- access and rules


@query("""
    with d as (select o_orderkey as k, case when o_orderkey % 9 = 0 then 't2' else 't1' end as tenant, 'u' || o_custkey % 7 as owner, ['tenant', 'private'][o_orderkey % 2 + 1] as visibility, case when o_orderkey % 5 = 0 then ['analyst'] else [] end as roles from orders),
    e as (select o_orderkey as k, case when o_orderkey % 6 = 1 then 'user' else 'role' end as kind, case when o_orderkey % 6 = 1 then 'u3' else 'analyst' end as subject, ['read', 'write', 'admin'][o_orderkey % 3 + 1] as permission from orders where o_orderkey % 6 in (1, 4)),
    may as (select k, permission from e where (kind = 'user' and subject = 'u3') or (kind = 'role' and subject = 'analyst'))
    select k as o_orderkey, owner = 'u3' or k in (select k from may where permission in ('write', 'admin')) as manages from d
    where tenant = 't1' and (owner = 'u3' or visibility = 'tenant' or list_contains(roles, 'analyst') or k in (select k from may))""")
def access_of_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user with a role may read, and which of it manage."""
    k = F.col("o_orderkey")
    orders = _read(spark, sf_dir, "orders")
    docs = orders.select(k.alias("document_id"), F.when(k % 9 == 0, "t2").otherwise("t1").alias("tenant_id"), F.concat(F.lit("u"), _text(F.col("o_custkey") % 7)).alias("owner_id"), F.when(k % 2 == 0, "tenant").otherwise("private").alias("visibility"), F.when(k % 5 == 0, F.array(F.lit("analyst"))).otherwise(F.array().cast("array<string>")).alias("allowed_roles"))
    permission = F.element_at(F.array(F.lit("read"), F.lit("write"), F.lit("admin")), (k % 3 + 1).cast("int"))
    entries = orders.where("o_orderkey % 6 in (1, 4)").select(k.alias("document_id"), F.when(k % 6 == 1, "user").otherwise("role").alias("subject_type"), F.when(k % 6 == 1, "u3").otherwise("analyst").alias("subject_id"), permission.alias("permission"))
    who = {"tenant": "t1", "user": "u3", "roles": ["analyst"]}
    managed = access.manageable(docs, entries, **who).select("document_id", F.lit(True).alias("manages"))
    return access.readable(docs, entries, **who).join(managed, "document_id", "left").select(F.col("document_id").alias("o_orderkey"), F.coalesce("manages", F.lit(False)).alias("manages"))


_WORDS = ["цвет", "форма", "формат", "посмотри ещё раз на фото", "подробнее", "картинка", "WEBHOOK", ""]
_AGAIN = [True, True, False, True, False, False, False, False]


@query(f"""
    with d as (select doc_id, lower(coalesce(text, '')) as low, string_split(lower(coalesce(text, '')), 'que') as parts from documents)
    select doc_id, {_AGAIN!r}[doc_id % {len(_WORDS)} + 1] as again, doc_id % 3 = 0 and doc_id % 4 in (0, 2) as image, doc_id % 5 in (0, 1) as tenant, len(parts) - 1 as n_mentions,
        case when len(parts) > 1 then sha256(substr(low, greatest(length(parts[1]) - 100, 0) + 1, least(length(parts[1]), 100) + 103)) end as first_mention, doc_id % 7 in (1, 2) as left_out
    from d""")
def rules_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about pictures, indexed images, tenants, mentions of a word with what stands around them, and set differences."""
    k = F.col("doc_id")
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (k % len(_WORDS) + 1).cast("int"))
    status = F.when(k % 3 == 0, "indexed").otherwise("failed")
    kind = F.element_at(F.array(*map(F.lit, ("PNG", "pdf", "image_ocr", "docx"))), (k % 4 + 1).cast("int"))
    asked = F.element_at(F.array(F.lit(" a "), F.lit("a"), F.lit(""), F.lit("b"), F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    said = rules.contexts(F.coalesce("text", F.lit("")), "que")
    known = F.when(k % 7 == 1, F.array(F.lit("x"), F.lit("y"))).when(k % 7 == 2, F.array(F.lit("z"))).otherwise(F.array(F.lit("y")))
    left = arrays.left_out(known, F.array(F.lit("y")), F.array(F.lit("w")))
    rows = _read(spark, sf_dir, "documents").select("doc_id", resumes.asks_picture_again(word).alias("again"), scope.is_indexed_image(status, kind).alias("image"), access.tenant_matches(asked, F.lit("a")).alias("tenant"), said.alias("s"), (F.size(left) > 0).alias("left_out"))
    return rows.select("doc_id", "again", "image", "tenant", F.size("s").cast("long").alias("n_mentions"), F.sha2(F.try_element_at("s", F.lit(1)).cast("binary"), 256).alias("first_mention"), "left_out")


@query("select doc_id, case when doc_id % 2 = 0 and source = 'src1' then 'none' else source end as title, sha256(case when doc_id % 2 = 0 then 'kept' || chr(10) || lang else 'up 5%' || chr(10) || 'kept' || chr(10) || 'nps 7' || chr(10) || lang end) as content from documents")
def policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and contents without lines of metrics where the policy asks for that."""
    title = F.when((F.col("doc_id") % 2 == 0) & (F.col("source") == "src1"), "42%").otherwise(F.col("source"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.concat(F.lit("up 5%\nkept\nnps 7\n"), "lang").alias("content"))
    return scope.under_policy(rows, F.col("doc_id") % 2 == 0, ["nps"], "none").select("doc_id", "title", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


# --- jobs


_STAGE = "case event_id % 4 when 0 then 'embed' when 1 then 'no such' when 2 then 'acl_check' end"


@query(f"""
    with j as (select event_id, case event_type when 'click' then 'completed' when 'error' then 'failed' when 'view' then 'running' else 'pending' end as status, event_id % 6 = 0 as foreign_, {_STAGE} as stage from events),
    s as (select event_id, stage from j where status <> 'completed' and not foreign_ and event_id % 2 = 0)
    select event_id, case when event_id % 3 = 0 then 'failed' else 'completed' end as status, case when event_id % 3 = 0 then coalesce(case when stage = 'no such' then 'index' else stage end, 'index') end as failed_stage, case when event_id % 3 = 0 then 'broken' end as error, 'done' as step from s
    union all select event_id, 'pending', null, null, 'retried' from j where status = 'failed'
    union all select event_id % 10, case when bool_or(status = 'failed') then 'failed' else 'completed' end, null, null, 'run' from j group by event_id % 10""")
def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a batch may start and how they end, retries of the failed ones, and the state of runs."""
    k, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "click", "completed").when(kind == "error", "failed").when(kind == "view", "running").otherwise("pending")
    rows = _read(spark, sf_dir, "events").select(_text(k).alias("job_id"), F.when(k % 6 == 0, "t2").otherwise("t1").alias("tenant_id"), status.alias("status"), F.when(k % 4 == 0, "embed").when(k % 4 == 1, "no such").when(k % 4 == 2, "acl_check").alias("stage"), _text(k % 3).alias("document_id"), k)
    wanted = rows.where("event_id % 2 = 0").select("job_id", F.lit(" t1 ").alias("tenant_id"))
    begun = events.started(rows, wanted, F.current_timestamp())
    ended = events.finished(begun, F.when(k % 3 == 0, "broken"), F.col("stage"))
    again = events.retried(rows.withColumns({"failed_stage": F.lit("index"), "error": F.lit("x")}), F.col("job_id"))
    runs = rows.groupBy((k % 10).alias("event_id")).agg(metrics.run_status(F.col("status") == "failed").alias("status"))
    columns = ["event_id", "status", "failed_stage", "error"]
    empty = [F.lit(None).cast("string").alias(c) for c in ("failed_stage", "error")]
    return ended.select(*columns, F.lit("done").alias("step")).union(again.select(*columns, F.lit("retried"))).union(runs.select("event_id", "status", *empty, F.lit("run")))


# --- logs and events that go out


@query("""
    with o as (select o_orderkey as k, o_custkey as c, o_orderstatus as s, o_totalprice as p from orders)
    select 'requested' as kind, min('j' || k) as key, string_agg('j' || k, ',' order by 'j' || k) as value from o group by c
    union all select 'failed', 'd' || k, repeat('x', least(k, 2000)::int) from o where s = 'F' and k < 3000 and k > 0
    union all select 'audit', 'a' || k, case when s = 'O' then repeat('r', least(k % 900, 500)::int) end from o
    union all select 'source', 'q' || k || '/' || r, repeat('s', case when r = 1 then 1200 else 10 end) from o, (values (1), (2)) v(r) where k % 10 = 0
    union all select distinct 'missing', 'b' || k % 40 || '/p' || k % 25, 'first' from o where k % 25 > 20""")
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of requests and failures, rows of audits and of a request's sources, and assets that no table has yet."""
    k, orders = F.col("o_orderkey"), _read(spark, sf_dir, "orders")
    job = F.concat(F.lit("j"), _text(k))
    asked = orders.select(F.concat(F.lit("q"), _text("o_custkey")).alias("request_id"), F.lit("t").alias("tenant_id"), job.alias("job_id"))
    requested = sinks.requested_events(asked).select(F.lit("requested").alias("kind"), "key", F.array_join(F.from_json("value", "job_ids array<string>")["job_ids"], ",").alias("value"))
    broken = orders.where("o_orderstatus = 'F' and o_orderkey < 3000 and o_orderkey > 0").select(F.concat(F.lit("d"), _text(k)).alias("document_id"), job.alias("job_id"), F.lit("embed").alias("failed_stage"), F.repeat(F.lit("x"), k.cast("int")).alias("error"))
    failed = sinks.failed_events(broken).select(F.lit("failed"), "key", F.get_json_object("value", "$.error"))
    calls = orders.select(F.concat(F.lit("a"), _text(k)).alias("key"), F.when(F.col("o_orderstatus") == "O", "ok").otherwise("refused").alias("status"), F.repeat(F.lit("r"), (k % 900).cast("int")).alias("result"))
    audited = sinks.audit_rows(calls).select(F.lit("audit"), "key", "preview")
    source = lambda n: F.struct(F.lit("d").alias("document_id"), F.repeat(F.lit("s"), n).alias("content"))
    answers = orders.where("o_orderkey % 10 = 0").select(F.concat(F.lit("q"), _text(k)).alias("request_id"), F.array(source(1500), source(10)).alias("sources"))
    logged = sinks.request_log(answers)[1].select(F.lit("source"), F.concat_ws("/", "request_id", _text("rank")), "excerpt")
    payloads = orders.select(F.lit("t").alias("tenant_id"), F.concat(F.lit("b"), _text(k % 40)).alias("bucket_id"), F.concat(F.lit("p"), _text(k % 25)).alias("source_path"), F.lit("csv").alias("source_type"), F.lit("first").alias("title"), k.alias("chunk_index"))
    assets = payloads.where("cast(substring(source_path, 2, 9) as int) <= 20").select("tenant_id", "bucket_id", "source_path")
    missing = sinks.missing_assets(payloads, assets).select(F.lit("missing"), F.concat_ws("/", "bucket_id", "source_path"), "title")
    return requested.union(failed).union(audited).union(logged).union(missing)


@query("""
    with r as (select o_orderkey as k, o_totalprice as p, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('t:orders:' || o_orderkey)) as x from orders where o_orderkey % 2 = 0),
    i as (select k, p, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) as id from r)
    select id, 't' as tenant_id, p as price from i union all select 'own-' || o_orderkey, 't', o_totalprice from orders where o_orderkey % 2 = 1""")
def synced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another table put over ours, twice, by ids made of tenant, kind and key."""
    orders = _read(spark, sf_dir, "orders")
    ours = orders.where("o_orderkey % 2 = 1").select(F.concat(F.lit("own-"), _text("o_orderkey")).alias("id"), F.lit("t").alias("tenant_id"), F.col("o_totalprice").alias("price"))
    remote = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("external_id"), (F.col("o_totalprice") * 0).alias("price"))
    once = sinks.synced(ours, remote, "t", "orders")
    return sinks.synced(once, orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("external_id"), F.col("o_totalprice").alias("price")), "t", "orders").select("id", "tenant_id", "price")


@query("""
    select 'file-' || doc_id || '.txt' as path, case when doc_id % 2 = 0 then 'known' else 'new' end as bucket, sha256(coalesce(nullif(text, ''), '-')) as sha256, timestamp '2024-01-02 00:00:00' as expires_at, 'pending' as status from documents""")
def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files staged in a bucket that is known by name, and in one that is new."""
    docs = _read(spark, sf_dir, "documents")
    buckets = spark.createDataFrame([("b-1", "Docs", "t"), ("b-2", "Docs", "other")], "bucket_id string, name string, tenant_id string")
    out = []
    for even, bucket in ((True, "Docs"), (False, "Other")):
        rows = docs.where((F.col("doc_id") % 2 == 0) == even).select(F.concat(F.lit("file-"), _text("doc_id"), F.lit(".txt")).alias("path"), F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit("-")).cast("binary").alias("content"))
        staged, _ = sinks.staged(rows, buckets, bucket=bucket, tenant_id="t", now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
        out.append(staged.select("path", F.when(F.col("bucket_id") == "b-1", "known").otherwise("new").alias("bucket"), "sha256", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "status"))
    return out[0].union(out[1])


# --- files


@query("""
    select 'jsonl' as kind, row_number() over (order by doc_id) as line, doc_id as number, sha256(coalesce(text, '')) as content from documents
    union all select 'json', null, s_suppkey, sha256('{' || chr(10) || '  "name": "' || s_name || '",' || chr(10) || '  "nation": ' || s_nationkey || chr(10) || '}') from supplier
    union all select 'text', null, s_suppkey, sha256(s_name || chr(10)) from supplier
    union all select 'manifest', null, s_suppkey, sha256(case when s_suppkey % 2 = 0 then 'note/x/b2' else 'text//b1' end) from supplier""")
def files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their numbers, JSON and text files, and the manifest's word over the readers'."""
    folder = shared_folder(spark, "files")
    docs, suppliers = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "supplier")
    docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.json(f"{folder}/lines")
    lines = files.numbered_lines(spark, f"{folder}/lines", "doc_id long, text string", across=True).select(F.lit("jsonl").alias("kind"), F.col("line").cast("long").alias("line"), F.col("doc_id").alias("number"), F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    keyed = suppliers.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    # files of their own take longer to make than to fill, so they are made by all tasks
    keyed = keyed.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")
    keyed.write.partitionBy("k").json(f"{folder}/json")
    keyed.select("k", "name").write.partitionBy("k").text(f"{folder}/text")
    number = F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long")
    read = [(kind, reader(spark, f"{folder}/{kind}")) for kind, reader in (("json", files.json_files), ("text", files.plain))]
    whole = [df.select(F.lit(kind), F.lit(None).cast("long"), number, F.sha2(F.col("content").cast("binary"), 256)) for kind, df in read]
    texts = read[1][1]
    below = F.regexp_extract("path", r"/text/(k=\d+/.*)$", 1)
    manifest = texts.where(number % 2 == 0).select(below.alias("path"), F.lit(None).cast("string").alias("tenant_id"), F.lit("b2").alias("bucket_id"), F.lit("note").alias("source_type"), F.array(F.lit("x")).alias("features"), F.lit(None).cast("map<string,string>").alias("metadata"))
    ruled = files.with_manifest(texts, manifest, f"{folder}/text", tenant_id="t", bucket_id="b1")
    said = ruled.select(F.lit("manifest"), F.lit(None).cast("long"), number, F.sha2(F.concat_ws("/", "source_type", F.array_join("features", ","), "bucket_id").cast("binary"), 256))
    return lines.union(whole[0]).union(whole[1]).union(said)


# --- résumés and prompts

_JOBS = "Май 2020 — Июнь 2022", "Январь 2018 — Апрель 2020"
_BODY = "replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g'), '  ', ' ')"


@query(f"""
    with d as (select doc_id, trim({_BODY}) as t, case when doc_id % 2 = 0 then 'Spark' else 'Java' end as tool, lang from documents),
    j as (
        select doc_id, 'profile' as kind, 1 as page, '' as organization, 'Name ' || doc_id as body from d
        union all select doc_id, 'employment', 2, 'Firm ' || lang, {literal(_JOBS[0])} || chr(10) || 'Firm ' || lang || chr(10) || 'Технологии' || chr(10) || tool || chr(10) || 'x' || t from d
        union all select doc_id, 'employment', 3, 'Other', {literal(_JOBS[1])} || chr(10) || 'Other' || chr(10) || 'work' from d
        union all select doc_id, 'skills', 3, '', 'Навыки' || chr(10) || tool from d),
    h as (select *, 'Организация: ' || organization || chr(10) || 'Технологии' || chr(10) || case when doc_id % 2 = 0 then 'Spark' else 'Java' end as head from j),
    p as (select *, unnest(case when length(body) <= 2200 then [0] else range(0, length(body)::bigint, 2200 - length(head) - 1) end) as s from h),
    c as (select doc_id, kind, page, organization, s, case when length(body) <= 2200 then body else regexp_replace(substr(body, s + 1, 2200 - length(head) - 1), '^\\s+|\\s+$', '', 'g') end as piece, length(body) > 2200 as cut, head from p)
    select doc_id, kind, page, organization, (row_number() over (partition by doc_id, kind, page order by s) - 1)::int as part, sha256(case when cut and not contains(piece, head) then left(head || chr(10) || piece, 2200) else piece end) as content from c where piece <> ''""")
def resume_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the pages of a résumé, cut into sections, and long jobs into parts that repeat employer and technologies."""
    # letters one by one, which Java looks up in a table; ranges are tried one after another for every letter of a text
    body = F.trim(F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{string.ascii_letters} ]+", ""), F.lit("  "), F.lit(" ")))
    tool = F.when(F.col("doc_id") % 2 == 0, "Spark").otherwise("Java")
    second = F.concat(F.lit(f"{_JOBS[0]}\nFirm "), "lang", F.lit("\nТехнологии\n"), tool, F.lit("\nx"), body)
    third = F.concat(F.lit(f"{_JOBS[1]}\nOther\nwork\nНавыки\n"), tool)
    pages = F.array(F.concat(F.lit("Name "), _text("doc_id")), second, third)
    # the pages are a column of their own, so that they are made once however often the sections name them; of explode() Spark
    # makes a filter that computes sections and parts another time, of explode_outer() it doesn't
    rows = _read(spark, sf_dir, "documents").select("doc_id", pages.alias("pages")).select("doc_id", F.explode_outer(resumes.sections(F.col("pages"))).alias("s")).where("s is not null").select("doc_id", "s.*")
    cut = rows.select("doc_id", "kind", "page", "organization", F.posexplode_outer(resumes.parts(F.col("content"), F.col("kind"), F.col("organization"))).alias("part", "content")).where("part is not null")
    return cut.select("doc_id", "kind", "page", "organization", "part", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query("""
    select conv_id, turn, sha256('Rules:' || chr(10) || '- be short' || chr(10) || chr(10) || 'Context:' || chr(10) || chr(10) || '[Source 1: ' || role || ' | title=t' || turn || ' | file= | feature=' || case when turn % 2 = 0 then 'sync' else 'unknown' end || ']' || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')
        || case when turn % 3 = 0 then chr(10) || chr(10) || 'Memory:' || chr(10) || 'm' || turn else '' end || chr(10) || chr(10) || 'Question:' || chr(10) || 'why ' || conv_id || '?') as prompt from conversations""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, a numbered source, memory where there is some, and the question."""
    source = F.struct(F.concat(F.lit("t"), _text("turn")).alias("title"), F.col("role").alias("source_type"), F.lit(None).cast("string").alias("file_name"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("sync"))).otherwise(F.array().cast("array<string>")).alias("features"), F.coalesce("text", F.lit("")).alias("content"))
    memory_ = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("m"), _text("turn"))).otherwise("")
    made = resumes.prompt(F.concat(F.lit("why "), _text("conv_id"), F.lit("?")), F.array(source), ["be short"], memory_)
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(made.cast("binary"), 256).alias("prompt"))


@query("""
    with m as (select conv_id, case when coalesce(text, '') = '' then 0 else greatest(1, floor(length(text) / 4)) end::bigint as cost from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1)
    select conv_id, case when 10 + cost <= 350 then 'summary,message 1' else 'summary' end as labels, case when 10 + cost <= 350 then 10 + cost else 10 end as used from m""")
def prompt_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of ten tokens and the last message, where it fits into the budget."""
    said = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.coalesce("text", F.lit("")).alias("content"))
    last = said.groupBy("session_id").agg(F.max_by("content", "turn").alias("content")).withColumn("place", F.lit(1))
    summaries = last.select("session_id", F.lit("s" * 40).alias("summary"), F.array().cast("array<string>").alias("goals"))
    made = memory.prompt_memory(last, summaries, budget=350)
    return made.select(F.col("session_id").alias("conv_id"), F.array_join("labels", ",").alias("labels"), "used")
