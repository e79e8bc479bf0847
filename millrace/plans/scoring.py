"""Queries that score and judge by whole rule tables, price lists and lexicons, fed by columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resumes, rules, text
from ..operators import evaluation, flags, metrics, retrieval
from ..sources import sinks
from .catalogue import Query
from .questions import MESSAGES, literal
from .reports import _CORPUS, corpus

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: scenario, flag, kind, field, args, and the same as a condition in SQL
_RULES = [
    (flags.EVERY, "filled", "response_filled", None, [], "length(trim(t, ' ' || chr(9) || chr(10) || chr(13))) > 0"),
    (flags.EVERY, "has_sources", "sources_any", None, [], "doc_id % 7 <> 0"),
    ("s0", "marked", "response_has", None, [["THE ", "que "], ["e"]], "(contains(t, 'the ') or contains(t, 'que ')) and contains(t, 'e')"),
    ("s0", "no_percent", "response_lacks", None, [["%"], ["$$$"]], "not contains(t, '%') and not contains(t, '$$$')"),
    ("s0", "typed", "source_types", None, [["en", "de"], ["src1", "src2", "src3"]], "doc_id % 7 <> 0 and lang in ('en', 'de') and source in ('src1', 'src2', 'src3')"),
    ("s0", "marked_and_typed", "all_of", None, [["marked", "typed"]], None),
    ("s1", "metric_intent", "fact_is", "hints.metric", [["true"]], "doc_id % 2 = 0"),
    ("s1", "not_carried", "fact_is_not", "context.used", [["true"]], "doc_id % 5 <> 0"),
    ("s1", "in_budget", "fact_within", "memory.tokens", [["memory.budget"]], "n_chars <= 1500"),
    ("s1", "has_final", "fact_above", "retrieval.final", [["2"]], "doc_id % 4 > 2"),
    ("s1", "about_sync", "feature", "context.query", [["sync"]], "doc_id % 3 = 0 or doc_id % 8 = 1 or (doc_id % 7 <> 0 and lang = 'fr')"),
    ("s2", "page_known", "source_meta_filled", "page", [["en", "fr"]], "doc_id % 7 <> 0 and lang in ('en', 'fr') and doc_id % 2 = 1"),
    ("s2", "page_is", "source_meta_is", "page", [["en"], ["p1", "p3"]], "doc_id % 7 <> 0 and lang = 'en' and doc_id % 10 in (1, 3)"),
    ("s2", "own_buckets", "buckets_within", None, [["b0", "b1"]], "doc_id % 7 <> 0 and doc_id % 3 in (0, 1)"),
    ("s2", "no_foreign", "buckets_without", "en", [["b2"]], "not (doc_id % 7 <> 0 and lang = 'en' and doc_id % 3 = 2)"),
    ("s2", "tenant", "tenants_are", None, [["t1"]], "doc_id % 7 <> 0"),
    ("s2", "scope", "list_is", "retrieval.buckets", [["b0", "b1"]], "doc_id % 6 = 1"),
    ("s2", "listed", "list_has", "retrieval.buckets", [["b0"]], "doc_id % 6 in (0, 1)"),
]
_JUDGED = " union all ".join(
    f"select doc_id, '{flag}' as flag, coalesce({sql}, false) as ok from a" + (f" where doc_id % 3 = {scenario[1:]}" if scenario != flags.EVERY else "") for scenario, flag, _, _, _, sql in _RULES if sql
)
_BOTH = "select doc_id, 'marked_and_typed' as flag, bool_and(ok) as ok from j where flag in ('marked', 'typed') group by doc_id"


@query(f"with a as (select *, lower(coalesce(text, '')) as t from documents), j as ({_JUDGED}) select * from j union all {_BOTH}")
def flags_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a rule table on each document as an answer, as rows."""
    k = F.col("doc_id")
    word = lambda c: F.when(c, F.lit("true")).otherwise("false")
    metadata = F.when(k % 2 == 1, F.create_map(F.lit("page"), F.concat(F.lit("p"), (k % 10).cast("string"))))
    source = lambda kind, own: F.struct(kind.alias("type"), F.lit("x.md").alias("path"), F.concat(F.lit("b"), (k % 3 if own else F.lit(0)).cast("string")).alias("bucket"), F.lit("t1").alias("tenant"), F.array(F.when(F.col("lang") == "fr", "sync").otherwise("other")).alias("features"), metadata.alias("metadata"))
    found = F.when(k % 7 != 0, F.array(source(F.col("lang"), True), source(F.col("source"), False)))
    facts = {"hints.metric": word(k % 2 == 0), "context.used": word(k % 5 == 0), "context.query": F.when(k % 3 == 0, "how to SYNC"), "memory.tokens": F.col("n_chars").cast("string"), "memory.budget": F.lit("1500"), "retrieval.final": (k % 4).cast("string")}
    scoped = F.when(k % 6 == 1, F.array(F.lit("b1"), F.lit("b0"), F.lit("b1"))).when(k % 6 == 0, F.array(F.lit("b0"))).otherwise(F.array(F.lit("b9")))
    lists = F.create_map(F.lit("retrieval.buckets"), scoped, F.lit("current"), F.when(k % 8 == 1, F.array(F.lit("sync"))).otherwise(F.array(F.lit("none"))))
    answers = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), (k % 3).cast("string")).alias("scenario"), F.col("text").alias("response"), found.alias("sources"), F.create_map(*(x for n, c in facts.items() for x in (F.lit(n), c))).alias("facts"), lists.alias("lists"))
    table = spark.createDataFrame([r[:5] for r in _RULES], flags.RULE)
    return flags.flagged(answers, table).select("doc_id", F.explode("flags").alias("flag", "ok"))


_CLASSES = evaluation.CLASSES
_PREDICTED = "case when doc_id % 6 = 1 then 'noise' when doc_id % 11 = 0 then null when doc_id % 13 = 0 then 'unheard of' else generated end"


@query(f"with r as (select generated as gold, {_PREDICTED} as predicted from ({_CORPUS})), k as (select unnest({_CLASSES}) as gold), p as (select unnest({_CLASSES} || ['unparsed']) as predicted) select k.gold, p.predicted, (select count(*) from r where r.gold = k.gold and (r.predicted = p.predicted or (r.predicted is null and p.predicted = 'unparsed'))) as n from k, p")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir), "generated", "predicted", _CLASSES)


@query(f"""
    with r as (select generated as gold, {_PREDICTED} as predicted from ({_CORPUS})),
    c as (select k, count(*) filter (gold = k and predicted = k) as tp, count(*) filter (gold <> k and predicted = k) as fp, count(*) filter (gold = k and predicted is distinct from k) as fn from r, (select unnest({_CLASSES}) as k) group by k)
    select (select count(*) from r) as rows, (select count(*) from r where predicted is null) as unparsed, round((select count(*) filter (gold = predicted) / count(*) from r), 6) as accuracy, round(avg(case when tp = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end), 6) as macro_f1 from c""")
def split_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = metrics.split_score(_predictions(spark, sf_dir), "generated", "predicted", _CLASSES)
    return scored.select("rows", "unparsed", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    said = F.when(k % 6 == 1, "noise").when(k % 11 == 0, None).when(k % 13 == 0, "unheard of").otherwise(F.col("generated"))
    return corpus(spark, sf_dir).withColumn("predicted", said)


_KEY = r"lower(regexp_replace(regexp_replace(nfc_normalize(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
_STRATA = f"""
    with c as (select doc_id, generated as class, {_KEY} as key from ({_CORPUS}) where text is not null),
    held as (select distinct key from c where doc_id % 5 = 0),
    one as (select class, key, min(doc_id) as id from c where doc_id % 5 <> 0 and key not in (select key from held) and (class <> 'bug' or doc_id < 100) group by all),
    ranked as (select class, id, row_number() over (partition by class order by sha256('seed-1' || chr(10) || id), id)::int as rank from one)"""


@query(f"{_STRATA} select class, id, rank from ranked where rank <= 30")
def stratified_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir)[0]


@query(f"{_STRATA} select class, (30 - count(id))::int as shortfall from (select unnest({_CLASSES}) as class) left join (select * from ranked where rank <= 30) using (class) group by class having count(id) < 30")
def stratified_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir)[1]


def _strata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bugs are few, so that there is a shortfall; a fifth of the documents is the holdout."""
    rows = corpus(spark, sf_dir)
    left = rows.where("doc_id % 5 <> 0 and (generated <> 'bug' or doc_id < 100)")
    return evaluation.stratified(left, rows.where("doc_id % 5 = 0"), id_col="doc_id", content="text", label="generated", per_class=30, seed="seed-1")


@query(f"""
    with n as (select distinct {_KEY} as key from documents where doc_id % 6 in (1, 2)), h as (select distinct {_KEY} as key from documents where doc_id % 6 in (2, 3)),
    c as (select doc_id, generated, {_KEY} as key from ({_CORPUS})),
    f as (select doc_id, generated, key in (select key from n where key is not null) as noise, key in (select key from h where key is not null) as churn from c)
    select doc_id, case when churn then 'churn_signal' when noise then 'noise' else generated end as rule_class, case when churn then 'lexicon_churn' when noise then 'lexicon_noise' else 'keep_generator' end as rule_reason from f""")
def lexicon_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexicons that share phrases: churn beats noise."""
    rows = corpus(spark, sf_dir)
    phrases = lambda *rest: _read(spark, sf_dir, "documents").where((F.col("doc_id") % 6).isin(*rest)).select(F.col("text").alias("phrase"))
    return evaluation.lexicon_classes(rows, phrases(1, 2), phrases(2, 3), content="text", fallback="generated").select("doc_id", "rule_class", "rule_reason")


_PII = "case when doc_id % 4 = 0 then '+7 (912) 345-67-' || lpad((doc_id % 100)::varchar, 2, '0') || ' ' else '' end || case when doc_id % 6 = 0 then ' 4000 1234-5678 ' || lpad((doc_id % 10000)::varchar, 4, '0') || ' ' else '' end || coalesce(text, '')"


@query(rf"select sum(len(regexp_extract_all(t, '\+7[\s(-]*\d{{3}}[\s)-]*\d{{3}}[\s-]*\d{{2}}[\s-]*\d{{2}}')))::bigint as phones, sum(len(regexp_extract_all(t, '\b\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}\b')))::bigint as cards from (select {_PII} as t from documents)")
def pii_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones and cards in all texts, some of which have one put before them."""
    k = F.col("doc_id")
    phone = F.when(k % 4 == 0, F.concat(F.lit("+7 (912) 345-67-"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" "))).otherwise("")
    card = F.when(k % 6 == 0, F.concat(F.lit(" 4000 1234-5678 "), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" "))).otherwise("")
    found = text.pii_counts(F.concat(phone, card, F.coalesce("text", F.lit(""))))
    return _read(spark, sf_dir, "documents").select(found.alias("c")).agg(F.sum("c.phones").cast("long").alias("phones"), F.sum("c.cards").cast("long").alias("cards"))


@query("""
    with p(provider, model, i, o) as (values ('local', 'click', 0.1::double, 0.4::double), ('remote', 'view', 0.15, 0.6), ('remote', 'error', 2.5, 10.0)),
    c as (select event_id, case when event_id % 2 = 0 then 'local' else 'remote' end as provider, event_type as model, case when event_id % 5 = 0 then null else event_id % 900 end as a, case when event_id % 7 = 0 then null else event_id % 300 end as b from events)
    select c.provider, c.model, count(*) as n, count(i) as priced, cast(round(sum((coalesce(a, 0) * i + coalesce(b, 0) * o) / 1000000), 8) as double) as cost from c left join p on c.provider = p.provider and c.model = p.model group by all""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and output tokens at prices of their own; a model without prices costs null."""
    prices = spark.createDataFrame([("local", "click", 0.1, 0.4), ("remote", "view", 0.15, 0.6), ("remote", "error", 2.5, 10.0)], "provider string, model string, input double, output double")
    k = F.col("event_id")
    calls = _read(spark, sf_dir, "events").select(F.when(k % 2 == 0, "local").otherwise("remote").alias("provider"), F.col("event_type").alias("model"), F.when(k % 5 != 0, k % 900).alias("prompt_tokens"), F.when(k % 7 != 0, k % 300).alias("completion_tokens"))
    return evaluation.with_cost(calls, prices).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"), F.count("cost").alias("priced"), F.round(F.sum("cost"), 8).alias("cost"))


@query("""
    with r as (select event_type as model, value as latency, case when event_id % 5 = 0 then null else event_id % 6 end as sources, event_id % 9 = 0 as failed, event_id % 8 = 0 as skipped, (event_id % 2 = 0)::int + (event_id % 3 = 0)::int as flags from events)
    select model, count(*) as n, floor(avg(latency))::bigint as avg_latency, round_even(avg(coalesce(sources, 0)), 2) as avg_sources, count(*) filter (failed and not skipped) as errors, count(*) filter (skipped) as skipped, sum(case when skipped then 0 else flags end)::bigint as failed_flags from r group by model""")
def model_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    value = lambda c: F.when(c, F.lit("false")).otherwise("true")
    found = F.create_map(F.lit("a"), value(k % 2 == 0), F.lit("b"), value(k % 3 == 0), F.lit("n"), F.lit("12"))
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("latency_ms"), F.when(k % 5 != 0, k % 6).alias("source_count"), F.when(k % 9 == 0, "timeout").otherwise("").alias("error"), (k % 8 == 0).alias("skipped"), found.alias("flags"))
    return evaluation.model_report(rows)


@query(r"""
    select doc_id, case when doc_id % 3 = 1 then source || '_' else '' end || lang || '.md' as name, left(regexp_replace(regexp_replace(regexp_replace(coalesce(case when doc_id % 4 = 0 then null else lang || ' ' || coalesce(text, '') end, text, ''), '^\s+|\s+$', '', 'g'), '\+7[\s(-]*\d{3}[\s)-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}', '[PHONE]', 'g'), '\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b', '[CARD]', 'g'), 1200) as content,
        left(coalesce(text, ''), case when doc_id % 2 = 0 then 8000 else 300 end) as excerpt, contains(lower(coalesce(text, '')), 'which file') as asks, case when lang = source then lang else lang || ',' || source end as ids,
        len(regexp_extract_all(lower(t), '[а-яё]')) > 20 and len(regexp_extract_all(lower(t), '[а-яё]')) >= len(regexp_extract_all(lower(t), '[a-z一-鿿]')) as russian
    from (select *, left(coalesce(text, ''), 60) || repeat('Ёж ', (doc_id % 40)::int) as t from documents)""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in prompts, contents of chunks, excerpts of sections, inventory questions, lists of ids and the language, over columns of the documents."""
    docs, k = _read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))), F.col("doc_id")
    digest = F.sha2(k.cast("string").cast("binary"), 256)
    token = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    plain = F.concat("lang", F.lit(".md"))
    path = F.when(k % 3 == 0, F.concat(F.lit("store/"), token, F.lit("_"), plain)).when(k % 3 == 1, F.concat("source", F.lit("_"), plain)).otherwise(F.concat(token, F.lit("_"), plain))
    body = rules.chunk_content(F.col("text"), F.when(k % 4 != 0, F.concat_ws(" ", "lang", "text")))
    excerpt = resumes.excerpt(F.col("text"), F.when(k % 2 == 0, "skills").otherwise("page"), 300)
    mixed = F.concat(F.substring("text", 1, 60), F.repeat(F.lit("Ёж "), (k % 40).cast("int")))
    asks = rules.asks_inventory(F.replace(F.lower("text"), F.lit("which file"), F.lit("какие файлы")))
    return docs.select("doc_id", text.display_name(path).alias("name"), body.alias("content"), excerpt.alias("excerpt"), asks.alias("asks"), F.array_join(text.id_list(F.array(F.concat(F.lit(" "), "lang"), F.lit(" "), "source", "lang")), ",").alias("ids"), text.is_russian(mixed).alias("russian"))


@query("""
    select 'document.indexed' as kind, o_orderkey::varchar as key, o_orderkey as number, o_custkey % 9 as chunks from orders where o_orderkey % 3 = 0
    union all select 'result', 'run-' || (o_orderkey % 4) || '/' || o_orderstatus, max(o_orderkey), arg_max(o_custkey % 3, o_orderkey) from orders group by o_orderkey % 4, o_orderstatus""")
def outgoing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of indexed documents, read back from their JSON, and result rows: the last answer of a run and scenario."""
    orders = _read(spark, sf_dir, "orders")
    text_of = lambda c: F.col(c).cast("string")
    indexed = orders.where("o_orderkey % 3 = 0").select(text_of("o_orderkey").alias("job_id"), text_of("o_orderkey").alias("document_id"), F.lit("b").alias("bucket_id"), F.lit("t").alias("tenant_id"), (F.col("o_custkey") % 9).alias("chunks_indexed"))
    body = "event_type string, job_id string, document_id string, bucket_id string, tenant_id string, chunks_indexed long"
    events = sinks.indexed_events(indexed).select("key", F.from_json("value", body).alias("v")).select(F.col("v.event_type").alias("kind"), "key", F.col("v.job_id").cast("long").alias("number"), F.col("v.chunks_indexed").alias("chunks"))
    made = orders.select(F.concat(F.lit("run-"), (F.col("o_orderkey") % 4).cast("string")).alias("run_id"), F.col("o_orderstatus").alias("scenario_id"), F.lit("m").alias("model"), F.col("o_orderkey").alias("created_at"), F.array_repeat(F.lit("s"), (F.col("o_custkey") % 3).cast("int")).alias("sources"))
    results = sinks.result_rows(made, F.create_map(F.lit("ok"), F.size("sources") > 0))
    return events.union(results.select(F.lit("result"), F.concat_ws("/", "run_id", "scenario_id"), "created_at", F.col("source_count").cast("long")))


@query("select round(avg(value), 6) as mean_value from events")
def mean_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean(_read(spark, sf_dir, "events"), "value").select(F.round("mean_value", 6).alias("mean_value"))


# --- questions, terms and scores of whole texts


def _has(words: list[str], of: str = "m") -> str:
    return "(" + " or ".join(f"contains({of}, {literal(w.lower())})" for w in words) + ")"


def _listed(cases: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {condition} then {literal(name)} end" for name, condition in cases) + "], lambda x: x is not null), ',')"


_MARKED = {name: _has(words) for name, words in rules.INTENT_MARKERS.items()}
_MARKED["metric"] = f"({_MARKED['metric']} and not {_has(rules.METRIC_REFUSALS)} and ({_has(rules.METRIC_QUESTIONS)} or not {_has(rules.STRONG_TECHNICAL)}))"
_INTENT = "case " + " ".join(f"when {condition} then {literal(name)}" for name, condition in _MARKED.items()) + " end"
_SAID = f"(select conv_id, turn, lower(coalesce(text, '') || ' ' || {[m[0] for m in MESSAGES]!r}[(conv_id * 5 + turn) % {len(MESSAGES)} + 1]) as m from conversations)".replace('"', "'")


@query(f"""
    select conv_id, turn, {_listed([(name, _has(words)) for name, words in rules.FEATURES.items()])} as features, {_listed([(name, _has([name])) for name in rules.INGEST_FEATURES])} as ingest,
        coalesce(case when intent = 'visual_chart' and {_has(rules.INTENT_MARKERS['visual_image'])} then 'visual_chart,visual_image' else intent end, '') as intents, {_has(rules.INVENTORY_MARKERS)} as inventory
    from (select *, {_INTENT} as intent from {_SAID})""")
def routes_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and intents of what was said in the conversations, whole, with a question behind it."""
    asked = F.element_at(F.array(*(F.lit(m[0]) for m in MESSAGES)), ((F.col("conv_id") * 5 + F.col("turn")) % len(MESSAGES) + 1).cast("int"))
    said = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), asked).alias("m"))
    lists = {"features": rules.question_features(F.col("m")), "ingest": rules.ingest_features(F.col("m")), "intents": rules.visual_intents(F.col("m"))}
    return said.select("conv_id", "turn", *(F.array_join(c, ",").alias(n) for n, c in lists.items()), rules.asks_inventory(F.col("m")).alias("inventory"))


_TRIM = r"'^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$'"
_FOUND = "list_transform(regexp_extract_all(coalesce(text, ''), '{}'), lambda t: lower(regexp_replace(t, {}, '', 'g')))"


@query(rf"""
    with f as (select doc_id, coalesce(text, '') as t, {_FOUND.format(rules.EXCEL_TERM, _TRIM)} as e, {_FOUND.format(rules.DOCX_TERM, _TRIM)} as d from documents),
    k as (
        select doc_id, t, list_filter(e, lambda x: x <> '' and not list_contains({rules.EXCEL_STOP!r}, x) and (case when regexp_full_match(x, '\d+(?:[,.]\d+)?') then length(regexp_replace(x, '\D', '', 'g')) >= 2 else length(x) >= 4 end)) as e,
            list_filter(d, lambda x: not list_contains({rules.DOCX_STOP!r}, x) and regexp_matches(x, '[a-z0-9#]')) as d from f)
    select doc_id, len(list_distinct(e))::int as n_excel, coalesce(array_to_string(list_sort(list_distinct(e)), ','), '') as excel, len(list_distinct(d))::int as n_docx, coalesce(array_to_string(list_sort(list_distinct(d)), ','), '') as docx, array_to_string(regexp_extract_all(t, '\b\d{{6,}}\b'), ',') as numbers from k""")
def terms_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact terms and long numbers of whole documents, sorted."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = docs.select("doc_id", rules.excel_terms(F.col("t")).alias("e"), rules.docx_terms(F.col("t")).alias("d"), rules.long_numbers(F.col("t")).alias("n"))
    return found.select("doc_id", F.size("e").alias("n_excel"), F.array_join(F.sort_array("e"), ",").alias("excel"), F.size("d").alias("n_docx"), F.array_join(F.sort_array("d"), ",").alias("docx"), F.array_join("n", ",").alias("numbers"))


_VOCABULARY = ["the", "and", "que", "les", "der", "und", "los", "con", "Ing"]
_EXPECTED, _NEVER = ["the", "que", "und"], ["eauouon", " ", "THTH"]


@query(f"""
    with a as (select doc_id, lower(coalesce(text, '')) as low, list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: list_contains({_VOCABULARY!r}, x))) as named,
        list_distinct(list_filter([case lang when 'en' then 'the' when 'fr' then 'que' when 'de' then 'und' else '' end, 'and', source], lambda x: x <> '')) as got from documents),
    s as (select *, case when len(named) = 0 then 1.0 else len(list_intersect(named, got)) / len(named) end as support, contains(low, 'eauouon')::int + contains(low, 'thth')::int as hits from a)
    select doc_id, round(len(list_intersect({_EXPECTED!r}, got)) / 3, 6) as retrieval_recall, round(case when hits > 0 then 0.0 else support end, 6) as faithfulness, round(len(list_intersect({_EXPECTED!r}, named)) / 3, 6) as answer_coverage,
        len(list_intersect(named, got))::int as n_supported, (len(named) - len(list_intersect(named, got)))::int as n_unsupported, hits from s""")
def scores_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: which words of a vocabulary they name, and which of these their sources have."""
    own = F.when(F.col("lang") == "en", "the").when(F.col("lang") == "fr", "que").when(F.col("lang") == "de", "und").otherwise("")
    scored = _read(spark, sf_dir, "documents").select("doc_id", rules.marker_scores(F.coalesce("text", F.lit("")), F.array(own, F.lit("and"), F.col("source")), _EXPECTED, _NEVER, _VOCABULARY).alias("s"))
    shares = [F.round(f"s.{c}", 6).alias(c) for c in ("retrieval_recall", "faithfulness", "answer_coverage")]
    return scored.select("doc_id", *shares, F.size("s.supported").alias("n_supported"), F.size("s.unsupported").alias("n_unsupported"), F.size("s.must_not_hits").alias("hits"))


@query("""
    with n as (select o_orderkey, o_orderkey % 8 as k, round(o_totalprice * 100)::bigint as cents from orders),
    p as (select *, (cents // 100)::varchar as whole, lpad((cents % 100)::varchar, 2, '0') as rest from n)
    select o_orderkey, whole || case when k in (3, 7) or cents % 100 = 0 then '' when cents % 10 = 0 then '.' || left(rest, 1) else '.' || rest end as number, true as there from p where cents >= 100000""")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in eight ways have one form, and are found in a sentence."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    plain = whole.cast("string")
    grouped = lambda mark: F.replace(F.format_number(whole, 0), F.lit(","), F.lit(mark))
    forms = [F.concat(plain, F.lit("."), rest), F.concat(grouped(" "), F.lit(","), rest, F.lit(" RUB")), F.concat(F.lit("€ "), grouped("."), F.lit(","), rest), F.concat(grouped(" "), F.lit(" pcs")), F.concat(F.lit("-00"), plain, F.lit(","), rest), F.concat(F.lit("+"), grouped(","), F.lit("."), rest), F.concat(plain, F.lit(","), rest, F.lit("000")), F.concat(F.lit("no "), plain)]
    rows = _read(spark, sf_dir, "orders").where(cents >= 100000).select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("t"))
    said = F.concat(F.lit("in all "), F.regexp_replace("t", "[^0-9.,  ]", ""), F.lit(" was paid"))
    return rows.select("o_orderkey", text.numeric_normal_form(F.col("t")).alias("number"), F.array_contains(rules.numbers_in(said), text.numeric_normal_form(F.col("t"))).alias("there"))


@query("""
    with o as (select o_orderkey, o_custkey % 5 as tenant, o_orderstatus as kind, ['a' || o_custkey % 3, 'b' || o_orderkey % 4] as tags, 'd' || o_orderkey % 50 as document, 'p' || o_orderkey % 60 as path from orders)
    select o_orderkey from o where tenant = 2 and kind in ('O', 'F') and list_has_any(tags, ['a1', 'b3']) and (document in ('d1', 'd2', 'd3', 'd7') or path in ('p5', 'p6', 'p7', 'p9', 'p11'))""")
def payload_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, list, overlap and one group of alternatives at once."""
    key = F.col("o_orderkey")
    named = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("tenant"), F.col("o_orderstatus").alias("kind"), F.array(named("a", F.col("o_custkey") % 3), named("b", key % 4)).alias("tags"), named("d", key % 50).alias("document"), named("p", key % 60).alias("path"))
    where = retrieval.payload_filter(equal={"tenant": 2, "kind": None}, among={"kind": ["O", "F"], "path": []}, overlap={"tags": ["a1", "b3"]}, either={"document": ["d1", "d2", "d3", "d7"], "path": ["p5", "p6", "p7", "p9", "p11"]})
    return rows.where(where).select("o_orderkey")
