"""Queries on what a question asks for and may see: features, routes, terms, files, deals and scopes, each with its SQL.

Questions are sample messages, one for each row of the conversations by its numbers; what the rules say of each message is
written down by hand in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import named, scope
from .catalogue import _read, query

#: Message, then by hand: features, ingest features, intents, source types, threshold, required types.
MESSAGES = [
    ("Which metrics grew for csv_import?", "csv_import,reports", "csv_import", "metric", "metric_row,incident_note,support_ticket,release_note", 0.6, "metric_row"),
    ("What changed in the changelog for search?", "search", "search", "release_notes", "release_note", 0.7, ""),
    ("Show support feedback on notifications", "notifications", "notifications", "support_feedback", "support_ticket,incident_note,metric_row", 0.7, ""),
    ("Root cause of webhook retry delay", "webhooks", "", "technical_root_cause", "markdown,incident_note,support_ticket", 0.6, ""),
    ("What was the impact, who was affected?", "", "", "incident", "incident_note,support_ticket,metric_row", 0.7, ""),
    ("Draw the diagram of sprints", "sprints", "sprints", "visual_chart", "excel_chart,image_digest", 0.55, "excel_chart"),
    ("What is in the photo?", "", "", "visual_image", "image_targeted_digest,image_digest,image_ocr", 0.55, "image_digest"),
    ("A chart and a picture", "", "", "visual_chart,visual_image", "image_targeted_digest,image_digest,image_ocr", 0.55, "excel_chart,image_digest"),
    ("Какие метрики по root cause?", "reports", "", "metric", "metric_row,incident_note,support_ticket,release_note", 0.6, "metric_row"),
    ("Отчёт без метрик, пожалуйста", "reports", "", "", "", 0.7, ""),
    ("Hello there", "", "", "", "", 0.7, ""),
    ("Who has the admin role in GitHub projects?", "permissions,integrations,projects", "projects", "", "", 0.7, ""),
]
_N = len(MESSAGES)


def literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else "null" if value is None else str(value)


def values(rows: list[tuple], columns: str) -> str:
    return f"(values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


def pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (number % len(options) + 1).cast("int"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("conv_id") * 5 + F.col("turn")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", pick([m[0] for m in MESSAGES], number).alias("message"), (number % 3 == 0).alias("own"))


@query(
    f"""select conv_id, turn, features, ingest, intents, case when own then 'csv' else sources end as sources, threshold::double as threshold, case when own then '' else required end as required
    from (select conv_id, turn, (conv_id * 5 + turn) % {_N} as n, (conv_id * 5 + turn) % 3 = 0 as own from conversations) join {values([(i, *m) for i, m in enumerate(MESSAGES)], 'n, message, features, ingest, intents, sources, threshold, required')} using (n)"""
)
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a question, its intents, and where to search; a third of the questions bring their own source types."""
    given = F.when(F.col("own"), F.array(F.lit("csv"))).otherwise(F.array().cast("array<string>"))
    routed = turns(spark, sf_dir).withColumn("r", rules.route(F.col("message"), given, F.lit(None).cast("double"), default=0.7))
    lists = {"features": rules.question_features(F.col("message")), "ingest": rules.ingest_features(F.col("message")), "intents": F.col("r.intents"), "sources": F.col("r.source_types"), "required": F.col("r.required")}
    return routed.select("conv_id", "turn", *(F.array_join(c, ",").alias(n) for n, c in lists.items()), F.col("r.score_threshold").alias("threshold"))


#: Message, then by hand: spreadsheet terms, document terms, long numbers.
TERM_MESSAGES = [
    ("Which xlsx row has SKU-4471 and 12,5?", "which,sku-4471,12,5", "which,xlsx,row,has,sku-4471,and,12", ""),
    ("excel: price 7 of order 1234567, order 1234567", "price,order,1234567", "excel,price,order,1234567", "1234567,1234567"),
    ("Какая цена у кега 50?", "кега,50", "50", ""),
    ("docx about C#_2 [beta].", "docx,about,c#_2,beta", "about,c#_2,beta", ""),
    ("", "", "", ""),
]


@query(f"select doc_id, excel, docx, numbers from (select doc_id, doc_id % {len(TERM_MESSAGES)} as n from documents) join {values([(i, *m) for i, m in enumerate(TERM_MESSAGES)], 'n, message, excel, docx, numbers')} using (n)")
def exact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _read(spark, sf_dir, "documents").select("doc_id", pick([m[0] for m in TERM_MESSAGES], F.col("doc_id")).alias("message"))
    found = {"excel": rules.excel_terms, "docx": rules.docx_terms, "numbers": rules.long_numbers}
    return said.select("doc_id", *(F.array_join(f(F.col("message")), ",").alias(n) for n, f in found.items()))


@query(
    """with t as (select doc_id, lower(text) as t, ['the', 'que', '1,5', '2.0', 'license'] as w from documents),
    b as (select doc_id, lower(array_to_string(list_filter(string_split('File: the que' || chr(10) || text, chr(10)), lambda x: not starts_with(lower(trim(x)), 'file:')), chr(10))) as b from documents)
    select doc_id, len(list_filter(w, lambda x: contains(t, x) or contains(t, translate(x, ',.', '.,'))))::int as excel_matches, len(list_filter(w, lambda x: contains(b, x)))::int as docx_matches from t join b using (doc_id)"""
)
def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ["the", "que", "1,5", "2.0", "license"]))
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.match_count(F.col("text"), wanted).alias("excel_matches"), rules.docx_match_count(F.concat(F.lit("File: the que\n"), "text"), wanted).alias("docx_matches"))


# --- files and deals


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Scan_of_plan_x"), F.col("s_suppkey").cast("string"), F.lit(".PDF"))).otherwise(F.concat(F.lit("plan_x"), F.col("s_suppkey").cast("string"), F.lit(".docx")))
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), name.alias("file_name"))


_FILES = "select s_suppkey as document_id, case when s_suppkey % 4 = 0 then 'Scan_of_plan_x' || s_suppkey || '.PDF' else 'plan_x' || s_suppkey || '.docx' end as file_name from supplier"
_ASKED = "select conv_id * 100 + turn as message_id, conv_id % 13 as n, turn from conversations"
_SAID = """'Open "Scan_of_plan_x' || n || '.pdf", then x' || n || '.docx, PLAN_X' || n || '.DOCX and n' || turn || '.txt'"""


def _asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("conv_id") % 13).cast("string")
    message = F.concat(F.lit('Open "Scan_of_plan_x'), n, F.lit('.pdf", then x'), n, F.lit(".docx, PLAN_X"), n, F.lit(".DOCX and n"), F.col("turn").cast("string"), F.lit(".txt"))
    return _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), message.alias("message"))


@query(
    f"""with f as ({_FILES}), a as ({_ASKED}),
    r as (select message_id, 0 as o, 'Scan_of_plan_x' || n || '.pdf' as requested from a union all select message_id, 1, 'x' || n || '.docx' from a union all select message_id, 2, 'PLAN_X' || n || '.DOCX' from a union all select message_id, 3, 'n' || turn || '.txt' from a),
    e as (select r.*, min(document_id) as exact from r left join f on lower(f.file_name) = lower(r.requested) group by all),
    s as (select e.message_id, e.o, case when count(distinct document_id) = 1 then min(document_id) end as one from e join f on ends_with(lower(f.file_name), lower(e.requested)) or ends_with(lower(e.requested), lower(f.file_name)) group by all),
    k as (select message_id, o, requested, coalesce(exact, one) as document_id from e left join s using (message_id, o))
    select message_id, requested, document_id from (select *, row_number() over (partition by message_id, document_id order by o) as nth from k) where document_id is null or nth = 1"""
)
def requested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a message names, matched to documents; names without a document stay, with null."""
    return named.requested_files(_asking(spark, sf_dir), _files(spark, sf_dir)).select("message_id", "requested", "document_id")


@query(
    f"""with f as (select document_id, lower(regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), '[^A-Za-z0-9]', '', 'g')) as stem from ({_FILES})),
    m as (select message_id, lower(regexp_replace({_SAID}, '[^A-Za-z0-9]', '', 'g')) as m from ({_ASKED}))
    select message_id, document_id, (strpos(m, stem) - 1)::int as place from m join f on contains(m, stem)"""
)
def documents_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named.documents_named(_asking(spark, sf_dir), _files(spark, sf_dir))


@query(
    """with d as (select 'b' || s_nationkey as bucket_id, 'deal-' || s_suppkey as deal_code, 'old-name-' || (s_suppkey % 7) as alias from supplier),
    m as (select conv_id * 100 + turn as message_id, case when turn % 3 = 0 then 'about-deal-' || (conv_id % 15) || '-please' when turn % 3 = 1 then 'the-old-name-' || (conv_id % 9) else 'hello' end as m from conversations),
    h as (select message_id, bucket_id, deal_code, greatest(case when contains(m, deal_code) then length(deal_code) else 0 end, case when contains(m, alias) then length(alias) else 0 end) as size from m, d),
    t as (select *, rank() over (partition by message_id order by size desc) as r from h where size > 0)
    select message_id, min(bucket_id) as bucket_id, min(deal_code) as deal_code from t where r = 1 group by message_id having count(*) = 1"""
)
def resolved_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one deal whose code or alias is the longest in a message; ties give none."""
    key = F.col("s_suppkey").cast("string")
    deals = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), F.col("s_nationkey").cast("string")).alias("bucket_id"), F.concat(F.lit("deal-"), key).alias("deal_code"), F.concat(F.lit("Deal_"), key).alias("title"), F.array(F.concat(F.lit("Old name "), (F.col("s_suppkey") % 7).cast("string"))).alias("aliases"))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("About Deal "), (F.col("conv_id") % 15).cast("string"), F.lit(" please"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("the old_name "), (F.col("conv_id") % 9).cast("string"))).otherwise("hello")
    messages = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), said.alias("message"))
    return named.resolved_deal(messages, deals)


_MONTHS = "[" + ", ".join(map(literal, rules.MONTHS)) + "]"


@query(
    f"""select 'deal_card:b' || (o_custkey % 3) || ':d-' || o_orderkey as id, 'demo_deals/b' || (o_custkey % 3) || '/d-' || o_orderkey as source_path,
    'code: d-' || o_orderkey || chr(10) || 'title: ' || o_orderpriority || chr(10) || 'amount: ' || o_custkey || ' EUR' || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'close date: ' || day(o_orderdate) || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ')' || chr(10) || 'bucket: b' || (o_custkey % 3) as content from orders"""
)
def deal_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals as evidence, a fact a line; blank facts (the owner) are left out."""
    text_of = lambda c: F.col(c).cast("string")
    deals = _read(spark, sf_dir, "orders").select(F.concat(F.lit("d-"), text_of("o_orderkey")).alias("deal_code"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("amount"), F.lit("EUR").alias("currency"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("close_date"), F.lit("").alias("owner"), F.concat(F.lit("b"), (F.col("o_custkey") % 3).cast("string")).alias("bucket_id"))
    return named.card_rows(deals).select("id", "source_path", "content")


@query("select doc_id, kind from (select doc_id, case doc_id % 4 when 0 then 'sales_contract' when 1 then 'sales_playbook' when 2 then 'sales_email' else 'sales_note' end as kind, doc_id % 5 = 0 as own from documents) where own or doc_id % 2 = 1 order by not own, doc_id limit 25")
def deal_sources_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = pick(["sales_contract", "sales_playbook", "sales_email", "sales_note"], F.col("doc_id"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", kinds.alias("source_type"), F.col("doc_id").alias("pos"))
    return named.deal_first(rows, F.col("doc_id") % 5 == 0, 25, id_col="doc_id").select("doc_id", F.col("source_type").alias("kind"))


@query("select o_orderkey, 'b' || (o_custkey % 3) as bucket_id from orders where o_custkey % 3 in (0, 1, 2) and o_orderkey = 1")
def deal_card_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = _read(spark, sf_dir, "orders").select("o_orderkey", F.lit("t1").alias("tenant_id"), F.concat(F.lit("b"), (F.col("o_custkey") % 3).cast("string")).alias("bucket_id"), F.concat(F.lit("d-"), F.col("o_orderkey").cast("string")).alias("deal_code"))
    return named.deal_card(deals, "t1", ["b0", "b1", "b2"], "d-1").select("o_orderkey", "bucket_id")


# --- scopes


@query(
    """with e as (select event_id, event_id % 5 as a, event_id % 3 as b, user_id % 4 as t, ['local_only', 'external', 'openapi', ' Hybrid ', null, 'other'][event_id % 6 + 1] as asked, event_id % 7 = 0 as seen, event_id % 11 = 0 as got from events),
    k as (select *, case when asked in ('external', 'openapi') then 'external' when asked = 'local_only' then asked else 'hybrid' end as kind, seen or got as persist from e)
    select event_id, a + b between 1 and 3 as narrow, case when a + b between 1 and 3 then 0.45 else 0.6 end::double as threshold, kind, kind = 'external' and not persist as generation, kind = 'hybrid' and b = 0 and not persist as fallback, persist,
    case when got then 'retrieved_non_synthetic' when seen then 'session_memory' end as reason, case when kind = 'external' and persist then 403 else 200 end as status,
    case t when 0 then true when 1 then a in (0, 1) else false end as may from k"""
)
def request_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How narrow a request is, what it may send out, and which tools its roles allow."""
    e = _read(spark, sf_dir, "events")
    lists = [F.sequence(F.lit(0), F.col(c)) for c in ("a", "b")]
    sized = [F.slice(x, 1, F.col(c).cast("int")) for x, c in zip(lists, ("a", "b"), strict=True)]
    asked = F.element_at(F.array(F.lit("local_only"), F.lit("external"), F.lit("openapi"), F.lit(" Hybrid "), F.lit(None).cast("string"), F.lit("other")), (F.col("event_id") % 6 + 1).cast("int"))
    rows = e.select("event_id", (F.col("event_id") % 5).alias("a"), (F.col("event_id") % 3).alias("b"), (F.col("user_id") % 4).alias("t"), asked.alias("asked"))
    narrow = scope.is_narrow(*sized)
    found = scope.external_scope(F.col("asked"), F.when(F.col("b") == 0, "rag").otherwise("chat"), F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0)
    roles = pick(["admin", "analyst", "viewer", "guest", "other"], F.col("a"))
    tool = pick(["rag_search", "text_to_sql", "drop_all", ""], F.col("t"))
    scored = rows.select("*", found.alias("s"))
    return scored.select("event_id", narrow.alias("narrow"), scope.scoped_threshold(F.lit(0.6), narrow).alias("threshold"), rules.approach(F.col("asked")).alias("kind"), F.col("s.allow_generation").alias("generation"), F.col("s.allow_fallback").alias("fallback"), "s.persist", "s.reason", "s.status", scope.may_invoke(tool, F.array(roles)).alias("may"))


@query(
    """with d as (select doc_id from documents where doc_id % 4 <> 1), r as (select doc_id from labels where quality = 1), b as (select doc_id from labels where toxic = 1)
    select 1 as kind, doc_id from d where doc_id in (select doc_id from r) union all select 2, doc_id from d where doc_id in (select doc_id from b) union all select 3, doc_id from d"""
)
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in reach by request, by buckets, and without either."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 4 == 1, "failed").otherwise("indexed").alias("status"))
    labels = _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    asked, boxed = labels.where("quality = 1"), labels.where("toxic = 1")
    cases = [(1, asked, boxed), (2, asked.limit(0), boxed), (3, asked.limit(0), boxed.limit(0))]
    out = [scope.resolved(docs, a, b).select(F.lit(i).alias("kind"), F.col("document_id").alias("doc_id")) for i, a, b in cases]
    return out[0].union(out[1]).union(out[2])


_META = """case doc_id % 4 when 0 then '{"synthetic": true}' when 1 then '{"document_metadata": {"synthetic": true}}' when 2 then '{"synthetic": false, "a": 1}' end"""


@query(f"""select source, bool_or(not coalesce(json_extract_string(m, '$.synthetic') = 'true' or coalesce(json_extract_string(m, '$.document_metadata.synthetic'), '') = 'true', false)) as real, count(*) filter (where coalesce(json_extract_string(m, '$.synthetic'), '') = 'true' or coalesce(json_extract_string(m, '$.document_metadata.synthetic'), '') = 'true') as n from (select source, {_META} as m from documents) group by source""")
def synthetic_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("source", F.expr(_META).alias("m"))
    return rows.groupBy("source").agg(scope.any_non_synthetic(F.col("m")).alias("real"), F.count_if(scope.is_synthetic(F.col("m"))).alias("n"))


@query(
    """select doc_id, lang as title, source as content, 'x=' || n_chars as metadata, lang in ('en', 'de') and doc_id % 2 = 0 as indexed, doc_id % 3 <> 2 as sales, case when length(text) > 3000 then 'message' || case when doc_id % 60 > 50 or doc_id % 60 = 0 then ',top_k' else '' end when doc_id % 60 > 50 or doc_id % 60 = 0 then 'top_k' else '' end as broken from documents"""
)
def payload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload as columns and the rest as metadata, without the synthetic flag; index, sales and limit rules beside it."""
    docs = _read(spark, sf_dir, "documents")
    payload = F.create_map(F.lit("title"), F.col("lang"), F.lit("content"), F.col("source"), F.lit("synthetic"), F.lit("true"), F.lit("x"), F.col("n_chars").cast("string"))
    rows = scope.source_columns(docs.select("doc_id", "lang", "text", payload.alias("payload")))
    kind = F.when(F.col("lang") == "en", "bug").when(F.col("lang") == "de", "feature").otherwise("noise")
    buckets = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("sales_aurora"), F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(" sales_northwind"))).otherwise(F.array(F.lit("sales_aurora"), F.lit("hr")))
    left = scope.without_synthetic(F.col("metadata"))
    broken = scope.broken_limits(F.col("text"), F.col("doc_id") % 60, {}, chars=3000, most_k=50, items=10, item_chars=100)
    shown = F.array_join(F.transform(F.map_entries(left), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("doc_id", "title", "content", shown.alias("metadata"), scope.enters_index(kind, F.col("doc_id") % 2 == 0).alias("indexed"), scope.is_sales_scope(buckets).alias("sales"), F.array_join(broken, ",").alias("broken"))


@query("select 1 as kind, s_suppkey from supplier where s_suppkey in (3, 5) union all select 2, s_suppkey from supplier")
def prefer_named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose name the question holds; all where it holds none."""
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Firm no"), F.col("s_suppkey").cast("string"), F.lit(".")).alias("organization"))
    some = scope.prefer_named(rows, "What did firm NO3. and Firm no5. write?").select(F.lit(1).alias("kind"), "s_suppkey")
    return some.union(scope.prefer_named(rows, "And the others?").select(F.lit(2), "s_suppkey"))


# --- names, paths and dates

PATHS = [
    ("a/business_metrics/x.csv", "metric_row", "business_metrics"),
    ("a/user_feedback/x.csv", "support_ticket", "user_feedback"),
    ("release_notes/incident-1.md", "incident_note", "release_notes"),
    ("release_notes/v1.csv", "release_note", "release_notes"),
    ("tech_knowledge/a.md", "markdown", "tech_knowledge"),
    ("x/y.pdf", "pdf", "documents"),
    ("x/README", "text", "documents"),
    ("x/.env", "text", "documents"),
]
REASONS = [(" STOP ", "stop"), ("max_tokens", "length"), ("length", "length"), ("tool_use", "tool_use"), ("", None), (None, None)]


@query(
    f"select d.doc_id, kind, domain, reason, 'fb-v1-' || format('{{:04d}}', d.doc_id) as corpus_id, left(text, 120) as sliced, length(text) > 120 as truncated from documents d join {values([(i, *p) for i, p in enumerate(PATHS)], 'n, path, kind, domain')} on n = d.doc_id % {len(PATHS)} join {values([(i, r[1]) for i, r in enumerate(REASONS)], 'k, reason').replace(' v(', ' w(')} on k = d.doc_id % {len(REASONS)}"
)
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file is by its path, finish reasons, corpus ids (of four digits and more) and slices."""
    docs = _read(spark, sf_dir, "documents")
    path, reason = pick([p[0] for p in PATHS], F.col("doc_id")), F.element_at(F.array(*(F.lit(r[0]).cast("string") for r in REASONS)), (F.col("doc_id") % len(REASONS) + 1).cast("int"))
    cut = rules.slice_flag(F.col("text"), 120)
    rows = docs.select("doc_id", path.alias("path"), reason.alias("r"), cut.alias("c"))
    return rows.select("doc_id", rules.source_type_of(F.col("path")).alias("kind"), rules.domain_of(F.col("path")).alias("domain"), rules.finish_reason(F.col("r")).alias("reason"), rules.corpus_id(F.col("doc_id")).alias("corpus_id"), F.col("c.text").alias("sliced"), "c.truncated")
