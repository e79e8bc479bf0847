"""Queries on corpora, evaluation runs, conversations and exact retrieval, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, rules, text
from ..operators import access, evaluation, memory, metrics, retrieval
from .catalogue import _COS, _VECTOR_SQL, QUERY_VECTOR, _read, query
from .questions import literal, pick, values

_CLASSES = "['noise', 'churn_signal', 'bug', 'feature']"
#: Documents as a feedback corpus: generated and ruled class, whether it is a copy, its scenario and index flag.
_CORPUS = f"select doc_id, lang, source, text, {_CLASSES}[doc_id % 4 + 1] as generated, case when doc_id % 9 = 0 then 'noise' else {_CLASSES}[doc_id % 4 + 1] end as ruled, doc_id % 10 = 3 as is_copy, case when doc_id % 10 = 3 then 'exact_duplicate' when doc_id % 9 = 0 then 'lexicon_noise' end as reason, case when doc_id % 6 <> 5 then 's' || (doc_id % 6) end as scenario, doc_id % 5 < 2 as flag from documents"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    generated = pick(evaluation.CLASSES, k)
    return _read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "text", generated.alias("generated"), F.when(k % 9 == 0, "noise").otherwise(generated).alias("ruled"), (k % 10 == 3).alias("is_copy"),
        F.when(k % 10 == 3, "exact_duplicate").when(k % 9 == 0, "lexicon_noise").alias("reason"), F.when(k % 6 != 5, F.concat(F.lit("s"), (k % 6).cast("string"))).alias("scenario"), (k % 5 < 2).alias("flag"),
    )


def _count_if(condition: str, name: str) -> str:
    return f"count(*) filter (where {condition}) as {name}"


@query(f"with c as ({_CORPUS}) select n_nationkey, {', '.join(_count_if(f'ruled = {literal(c)}', c) for c in evaluation.CLASSES)}, {_count_if('flag', 'indexed')} from nation left join c on source = 'src' || n_nationkey group by n_nationkey")
def bucket_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts by bucket; a bucket without items has zeros."""
    buckets = _read(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"), "n_nationkey")
    counted = evaluation.counts_for(buckets, corpus(spark, sf_dir), "source", "ruled", evaluation.CLASSES, "flag")
    return counted.join(buckets, "source").drop("source")


@query(
    f"""with c as ({_CORPUS}), k as (select unnest({_CLASSES} || ['total']) as label)
    select 'before' as when_, label, count(doc_id) as n from k left join c on not is_copy and (generated = label or label = 'total') group by label
    union all select 'after', label, count(doc_id) from k left join c on ruled = label or label = 'total' group by label"""
)
def corpus_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"generated": "generated", "ruled": "ruled", "is_copy": "is_copy"}
    out = [evaluation.tally(corpus(spark, sf_dir), **kinds, before_copies=b).select(F.lit(name).alias("when_"), "label", "n") for name, b in (("before", True), ("after", False))]
    return out[0].union(out[1])


_TARGETS = {"noise": 0.33, "churn_signal": 0.22, "bug": 0.25, "feature": 0.2}


@query(f"with c as ({_CORPUS}), n as (select count(*) as total from c), t as (select * from {values([(k, v) for k, v in _TARGETS.items()], 'label, target')}) select label, round(count(doc_id) / any_value(total), 6) as share, abs(count(doc_id) / any_value(total) - any_value(target)) * 100 <= 2 as within from t cross join n left join c on ruled = label group by label")
def shares_in_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.shares_within(corpus(spark, sf_dir), "ruled", _TARGETS, 2.0)


@query(f"with c as ({_CORPUS}) select {_count_if(chr(39).join(['ruled in (', 'bug', ', ', 'feature', ') and coalesce(scenario not in (', 's1', ', ', 's2', ', ', 's3', '), true)']), 'missing')}, {_count_if('flag and ruled = ' + literal('bug'), 'bug')}, {_count_if('flag and ruled = ' + literal('feature'), 'feature')} from c")
def corpus_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed rows without a known scenario, and indexed rows by class; one row each."""
    rows = corpus(spark, sf_dir)
    return evaluation.missing_scenarios(rows, "ruled", "scenario", ["s1", "s2", "s3"]).join(evaluation.indexed_by_class(rows, "ruled", "flag"))


@query(f"with c as ({_CORPUS}) select 'mismatch' as kind, doc_id, generated, ruled, reason, left(text, 80) as preview from c where generated <> ruled union all select 'suppressed', doc_id, generated, ruled, reason, left(text, 80) from c where reason = 'exact_duplicate'")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mismatches(corpus(spark, sf_dir), id_col="doc_id", generated="generated", ruled="ruled", reason="reason", content="text")


@query(
    f"""with c as (select doc_id, generated from ({_CORPUS})), p as (select *, {_CLASSES} as k from c),
    s as (select 0 as copy, generated, doc_id, list_position(k, generated) as part from p union all select 1, generated, doc_id, list_position(k, generated) from (select *, row_number() over (partition by generated order by doc_id) as r from p) where (generated = 'bug' and r <= 8) or (generated = 'feature' and r <= 2))
    select row_number() over (order by copy, part, doc_id)::int as number, generated, doc_id, copy = 1 as is_copy from s"""
)
def appended_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts one after another, then the first 8 bugs and 2 features again, numbered without gaps."""
    rows = corpus(spark, sf_dir).select("doc_id", "generated")
    parts = [rows.where(F.col("generated") == c) for c in evaluation.CLASSES]
    return evaluation.with_copies(parts, "doc_id", {2: 8, 3: 2}).select(F.col("number").cast("int").alias("number"), "generated", "doc_id", "is_copy")


@query("with a as (select doc_id, lang, source from documents where doc_id % 50 <> 7), b as (select doc_id, case when doc_id % 20 = 1 then 'xx' else lang end as lang, case when doc_id % 30 = 2 then null else source end as source from documents where doc_id % 50 <> 9) select coalesce(a.doc_id, b.doc_id) as doc_id, unnest(case when a.doc_id is null or b.doc_id is null then ['_row'] else list_filter([case when a.lang is distinct from b.lang then 'lang' end, case when a.source is distinct from b.source then 'source' end], lambda x: x is not null) end) as field from a full join b using (doc_id)")
def frozen_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    frozen = docs.where("doc_id % 50 <> 9").select("doc_id", F.when(F.col("doc_id") % 20 == 1, "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 30 != 2, F.col("source")).alias("source"))
    return evaluation.differences(docs.where("doc_id % 50 <> 7"), frozen, "doc_id")


@query("select * from (select doc_id, 'left' as side from documents where lang = 'en' and doc_id not in (select doc_id from labels)) union all (select doc_id, 'right' from labels where doc_id not in (select doc_id from documents where lang = 'en'))")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.same_sets(_read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id"))


# --- scores of answers

_VOCABULARY = ["login", "export", "billing", "search_1"]
#: Answer, retrieved ids, then by hand: recall, faithfulness, coverage, support, supported, unsupported, hits.
ANSWERS = [
    ("login fails, and export too", ["login", "export", ""], 1.0, 1.0, 1.0, 1.0, "login,export", "", ""),
    ("billing is broken; login, login", ["login"], 0.5, 0.5, 0.5, 0.5, "login", "billing", ""),
    ("nothing is known", [], 0.0, 1.0, 0.0, 1.0, "", "", ""),
    ("login never works, ALL users left", ["login", "login"], 0.5, 0.0, 0.5, 1.0, "login", "", "all users"),
    ("search_1x, (export)", ["billing", "search_1"], 0.0, 0.0, 0.5, 0.0, "", "export", ""),
]


@query(
    f"select doc_id, recall::double as recall, faithful::double as faithful, coverage::double as coverage, support::double as support, supported, unsupported, hits from (select doc_id, doc_id % {len(ANSWERS)} as n from documents) join {values([(i, *a[2:]) for i, a in enumerate(ANSWERS)], 'n, recall, faithful, coverage, support, supported, unsupported, hits')} using (n)"
)
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % len(ANSWERS) + 1).cast("int")
    retrieved = F.element_at(F.array(*(F.array(*map(F.lit, a[1])).cast("array<string>") for a in ANSWERS)), n)
    rows = _read(spark, sf_dir, "documents").select("doc_id", pick([a[0] for a in ANSWERS], F.col("doc_id")).alias("answer"), retrieved.alias("got"))
    scored = rows.select("doc_id", rules.marker_scores(F.col("answer"), F.col("got"), ["login", "export", "login"], ["All users", ""], _VOCABULARY).alias("s"))
    listed = lambda c: F.array_join(f"s.{c}", ",")
    return scored.select("doc_id", F.col("s.retrieval_recall").alias("recall"), F.col("s.faithfulness").alias("faithful"), F.col("s.answer_coverage").alias("coverage"), F.col("s.support_ratio").alias("support"), listed("supported").alias("supported"), listed("unsupported").alias("unsupported"), F.lower(listed("must_not_hits")).alias("hits"))


_RUNS = "select doc_id, ['h0', 'h1'][doc_id % 2 + 1] as arm, 'q' || (doc_id % 3) as question, (doc_id % 7) / 7.0 as faithful, case when doc_id % 4 > 0 then (doc_id % 5) / 5.0 end as recall, case when doc_id % 40 = 6 then ['x'] else [] end as hits from documents"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    hits = F.when(k % 40 == 6, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return _read(spark, sf_dir, "documents").select("doc_id", pick(["h0", "h1"], k).alias("arm"), F.concat(F.lit("q"), (k % 3).cast("string")).alias("question"), ((k % 7) / F.lit(7.0)).alias("faithful"), F.when(k % 4 > 0, (k % 5) / F.lit(5.0)).alias("recall"), hits.alias("hits"))


@query(f"select question, arm, count(*) as n, round(avg(faithful), 6)::double as mean_faithful, round(avg(recall), 6)::double as mean_recall, count(*) filter (where len(hits) > 0) as hit_runs from ({_RUNS}) group by question, arm")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.means(_runs(spark, sf_dir), ["question", "arm"], ["faithful", "recall"], "hits")
    return rows.select("question", "arm", "n", *(F.round(f"mean_{m}", 6).alias(f"mean_{m}") for m in ("faithful", "recall")), "hit_runs")


@query(
    f"""with r as ({_RUNS}), k as (select count(*) filter (where arm = 'h1' and len(hits) > 0) = 0 as cleared, avg(faithful) filter (where arm = 'h1') + 1e-9 >= avg(faithful) filter (where arm = 'h0') as faithful_kept, avg(recall) filter (where arm = 'h1') + 1e-9 >= avg(recall) filter (where arm = 'h0') as recall_kept from r)
    select *, cleared and faithful_kept and recall_kept as accepted from k"""
)
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accepted(_runs(spark, sf_dir).withColumn("hits", F.size("hits")), arm="arm", hits="hits", metrics=["faithful", "recall"])


@query(
    """with s as (select conv_id, count(distinct case when role <> 'system' then role || (turn % 2) end) as n from conversations group by conv_id), f as (select distinct role || (turn % 2) as id from conversations where role <> 'system'),
    w as (select unnest(['user0', 'user1', 'assistant1', 'other']) as id), nf as (select list_sort(list(id)) as never from w where id not in (select id from f))
    select 3 as capacity, round(avg(n), 6) as mean_unique, any_value(array_to_string(never, ',')) as never_found, len(any_value(never)) > 0 and max(n) < 3 as needed from s cross join nf"""
)
def ceiling_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the limit or repeated scenarios hid an expected one; searches are conversations here."""
    named = F.when(F.col("role") != "system", F.concat("role", (F.col("turn") % 2).cast("string"))).otherwise("")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", named.alias("scenario"))
    note = evaluation.ceiling_note(rows, search="conv_id", scenario="scenario", expected=["user0", "user1", "assistant1", "other", "user0"], top_k=3)
    return note.select("capacity", F.round("mean_unique", 6).alias("mean_unique"), F.array_join("never_found", ",").alias("never_found"), "needed")


# --- evaluation runs

_RESULTS = "select event_id, event_type as model, user_id % 10 as scenario, event_id % 4 as source_count, case when event_id % 13 = 0 then 'timeout' end as error, event_id % 17 = 0 as skipped, event_id % 3 = 0 as a, event_id % 5 = 0 as b, value, case when event_id % 6 > 0 then event_id % 2 = 0 end as exact from events"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    flag = lambda n: F.when(k % n == 0, "false").otherwise("true")
    return _read(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("model"), (F.col("user_id") % 10).alias("scenario"), (k % 4).alias("source_count"), F.when(k % 13 == 0, "timeout").alias("error"), (k % 17 == 0).alias("skipped"),
        F.create_map(F.lit("a"), flag(3), F.lit("b"), flag(5), F.lit("note"), F.lit("0")).alias("flags"), "value", F.when(k % 6 > 0, k % 2 == 0).alias("exact"),
    )


@query(f"select scenario, count(*) as n, count(*) filter (where source_count = 0) as zero_source, count(error) as errors, count(*) filter (where skipped) as skipped, sum(case when skipped then 0 else a::int + b::int end)::bigint as failed_flags from ({_RESULTS}) group by scenario")
def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scenario_summary(_results(spark, sf_dir), "scenario")


@query(f"select event_id, array_to_string(list_filter([case when a then 'a' end, case when b then 'b' end], lambda x: x is not null), ',') as failed, error from ({_RESULTS}) where not skipped and (a or b or error is not null)")
def failed_flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.flag_failures(_results(spark, sf_dir), "event_id").select("event_id", F.array_join("failed", ",").alias("failed"), "error")


@query(f"select coalesce(case when scenario > 2 then 'i' || scenario end, 'unknown') as key, count(*) as n, count(*) filter (where exact) as exact, count(exact) as exact_known, round(avg(value), 2) as mean_latency from ({_RESULTS}) group by 1")
def intent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By intent; rows without one are unknown. A mean of exactly half a hundredth would round to the even digit."""
    key = F.when(F.col("scenario") > 2, F.concat(F.lit("i"), F.col("scenario").cast("string")))
    return evaluation.run_summary(_results(spark, sf_dir), key, ["exact"], "value")


@query(f"select model, count(*) as n, count(*) filter (where a) as missing_a, count(*) filter (where error is not null and not skipped) as failed, count(*) filter (where source_count = 0) as blind from ({_RESULTS}) group by model")
def model_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"missing_a": F.array_contains(rules.failed_flags(F.col("flags")), "a"), "failed": F.col("error").isNotNull() & ~F.col("skipped"), "blind": F.col("source_count") == 0}
    return evaluation.guardrails(_results(spark, sf_dir), "model", checks)


@query(f"select model, error, count(*) as value from ({_RESULTS}) group by model, error")
def counter_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.counter(_results(spark, sf_dir), ["model", "error"])


_BOUNDS = [10.0, 100.0]


@query("with l as (select event_type, le, bound from (select distinct event_type from events) cross join (values ('10.0', 10.0::double), ('100.0', 100.0), ('+Inf', 'infinity'::double)) b(le, bound)) select l.event_type, 'bucket' as line, le, count(value)::double as value from l left join events e on e.event_type = l.event_type and e.value <= bound group by l.event_type, le union all select event_type, 'sum', '', round(sum(value), 4) from events group by event_type union all select event_type, 'count', '', count(value) from events group by event_type")
def histogram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events")
    lines = evaluation.exposition(metrics.histogram(rows, ["event_type"], "value", _BOUNDS), rows, ["event_type"], "value")
    return lines.select("event_type", "line", "le", F.round("value", 4).alias("value"))


@query("with p as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as document from conversations group by conv_id), o as (select conv_id, turn, role as ocr from conversations where role = 'assistant') select c.conv_id, c.turn, ocr, md5(document) as document_md5, case when contains(lower(document), 'the') and c.turn % 2 = 0 then 'inconsistent' else 'consistent' end as status from conversations c left join o using (conv_id, turn) left join p on p.conv_id = c.conv_id")
def media_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with their recognised text and their file's text, and whether the two contradict each other."""
    rows = _read(spark, sf_dir, "conversations")
    contents = evaluation.text_by_path(rows.select("conv_id", "turn", F.col("text").alias("content")), "conv_id", "content", "turn")
    ocr = rows.where("role = 'assistant'").select("conv_id", "turn", F.col("role").alias("content"))
    joined = evaluation.evidence(rows.select("conv_id", "turn"), ocr, contents, ["conv_id", "turn"], "conv_id")
    seen = F.when(F.col("turn") % 2 == 0, "even").otherwise("odd")
    return joined.select("conv_id", "turn", "ocr", F.md5("document").alias("document_md5"), rules.consistency(F.col("document"), seen, {"the": "even"}).alias("status"))


# --- conversations

_MESSAGES = ["Show csv import problems", "А что с этим делать?", "why?", "Отчёт", "А теперь про webhooks.", "Please list every open point of the plan now"]
#: By hand for each message: features, follow-up, switch, and the query where it is a switch.
_MODES = [("csv_import", False, True, _MESSAGES[0]), ("", True, False, ""), ("", True, False, ""), ("reports", False, True, _MESSAGES[3]), ("webhooks", False, True, "А теперь про webhooks"), ("", False, False, "")]


@query(
    f"""with m as (select c_custkey as session_id, c_custkey % {len(_MESSAGES)} as n from customer), k as (select * from {values([(i, m, *d) for i, (m, d) in enumerate(zip(_MESSAGES, _MODES, strict=True))], 'n, message, features, follow, switch, own')}),
    h as (select conv_id as session_id, count(*) as messages, list(case when turn % 4 = 0 then 'csv ' || turn else 'word ' || turn end order by turn) filter (where role = 'user') as said from conversations where turn < 6 group by conv_id),
    j as (select session_id, message, features, follow, switch, own, messages, coalesce(said, []) as said, case when session_id % 3 = 0 then 'old talk' end as summary, len(list_filter(coalesce(said, []), lambda x: starts_with(x, 'csv'))) > 0 as carried from m join k using (n) left join h using (session_id)),
    d as (select *, case when messages is null then 'no_history' when switch then 'topic_switch_or_standalone' when not follow then 'standalone_question' when len(said) = 0 then 'no_reusable_history' else 'follow_up_rewrite' end as mode, array_to_string(list_filter([case when carried then 'csv_import' end, case when summary is not null and not carried then 'tasks' end], lambda x: x is not null), ', ') as known from j)
    select session_id, mode, case when mode = 'follow_up_rewrite' then known else features end as features, case when mode = 'topic_switch_or_standalone' then own when mode = 'follow_up_rewrite' then message || ' Предыдущая тема: ' || array_to_string(said[-2:], ' ') || case when summary is not null and not carried then ' Summary предыдущего диалога: old talk' else '' end || case when known <> '' then ' Ключевые features из предыдущего контекста: ' || known || '.' else '' end else message end as query from d"""
)
def rewritten_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question as it is searched with, by what was said before."""
    asked = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), pick(_MESSAGES, F.col("c_custkey")).alias("message"))
    word = F.when(F.col("turn") % 4 == 0, "csv ").otherwise("word ")
    history = _read(spark, sf_dir, "conversations").where("turn < 6").select(F.col("conv_id").alias("session_id"), "role", F.concat(word, F.col("turn").cast("string")).alias("content"), F.col("turn").alias("place"))
    summaries = asked.where("session_id % 3 = 0").select("session_id", F.lit("old talk").alias("summary"), F.array(F.lit("tasks")).alias("features"))
    return memory.rewritten(asked, history, summaries).select("session_id", "mode", F.array_join("features", ", ").alias("features"), "query")


@query("with r as (select *, row_number() over (partition by conv_id order by turn // 3 desc, case role when 'user' then 0 when 'assistant' then 1 else 2 end desc, turn desc) as n from conversations) select conv_id, turn, role, row_number() over (partition by conv_id order by turn // 3, case role when 'user' then 0 when 'assistant' then 1 else 2 end, turn) as place from r where n <= 5")
def recent_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last five messages in the order written; of one moment (three turns here) the user's first."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.floor(F.col("turn") / 3).alias("at"))
    return memory.recent(rows, "conv_id", "at", "role", "turn", 5).select("conv_id", "turn", "role", "place")


@query(
    """with m as (select user_id, count(*) as n, sum(value)::double as tokens, max(ts) as last from events group by user_id), k as (select *, case when user_id % 3 = 0 then null else n - user_id % 6 end as at_update, (epoch(timestamp '2024-12-31 00:00:00') - floor(epoch(last)))::bigint as idle from m)
    select user_id, idle, case when at_update is null then case when n >= 8 then 'message_count' when tokens >= 600 then 'token_estimate' end when n - at_update >= 4 then 'stale' when idle >= 3600 and n > at_update then 'idle' end as due from k"""
)
def summary_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a summary is due; users stand for sessions and values for tokens."""
    m = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("tokens"), F.max("ts").alias("last"))
    idle = memory.idle_seconds(F.col("last").cast("timestamp_ntz").cast("timestamp"), F.lit("2024-12-31 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    at_update = F.when(F.col("user_id") % 3 != 0, F.col("n") - F.col("user_id") % 6)
    return m.select("user_id", idle.alias("idle"), memory.summary_due(F.col("n"), F.col("tokens"), at_update, idle).alias("due"))


# --- retrieval

_NEAR = f"select vec_id, label, {_COS} as score, row_number() over (order by list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) desc, vec_id) as pos from embeddings"


@query(
    f"""with n as (select * from ({_NEAR}) where pos <= 15), x as (select vec_id, label, null::double as score, vec_id as pos, 0 as l from embeddings where vec_id in (1, 2, 3)),
    u as (select *, row_number() over (partition by vec_id order by l, pos) as k from (select * from x union all select vec_id, label, score, pos, 1 from n where score >= 0.1)),
    r as (select vec_id, label, score, row_number() over (order by l, pos) as rank from u where k = 1), c as (select *, row_number() over (partition by label order by rank) as in_label from r)
    select vec_id, label, score from c where in_label <= 2 order by rank limit 5"""
)
def over_fetched_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times as many rows as wanted, then the threshold, rows put first, caps, and the cut."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("kind"), "label", "embedding")
    extra = vectors.where("vec_id in (1, 2, 3)").withColumn("pos", F.col("vec_id").cast("int"))
    found = retrieval.searched(vectors, QUERY_VECTOR, 5, id_col="vec_id", threshold=0.1, caps={"kind": 2}, extra=extra)
    return found.select("vec_id", "label", F.round("score", 4).alias("score"))


@query(
    """with m as (select doc_id, lower(text) as t, len(list_filter(['the-', 'document', 'tion', '12,5'], lambda x: contains(lower(text), x) or (contains(x, ',') and contains(lower(text), '12.5')))) as n from documents where doc_id < 400),
    h as (select doc_id, 0 as l, row_number() over (order by n desc, doc_id) as pos from m where n > 0), e as (select doc_id, 1 as l, row_number() over (order by doc_id) as pos from m where doc_id <= 12)
    select doc_id, l as list_no from (select *, row_number() over (partition by doc_id order by l, pos) as k from (select * from h where pos <= 9 union all select * from e where pos <= 9)) where k = 1"""
)
def exact_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with most of the question's terms (document, tion, 12,5; the- is none that stands in a text), then head rows."""
    rows = _read(spark, sf_dir, "documents").where("doc_id < 400").select(F.col("doc_id").alias("row_number"), F.col("text").alias("content"))
    found = retrieval.exact_rows(rows, "the- document tion 12,5?", 9)
    return found.select(F.col("row_number").alias("doc_id"), "list_no")


@query("select doc_id from (select *, contains(lower(text), 'tion')::int + contains(lower(text), '12,5')::int + contains(lower(text), '12.5')::int as n from documents where doc_id % 3 = 0 and doc_id % 4 <> 1) where n > 0 order by least(n, contains(lower(text), 'tion')::int + 1) desc, doc_id % 50, doc_id limit 7")
def exact_sheet_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures anchored to cells with most of the question's terms, by anchor row."""
    k = F.col("doc_id")
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.when(k % 3 == 0, "image_digest").otherwise("csv").alias("source_type"), F.lit("xlsx").alias("parent_source_type"), F.when(k % 4 == 1, "page").otherwise("xlsx_cell").alias("anchor_type"), (k % 50).alias("anchor_row"), k.alias("image_index"))
    return retrieval.exact_images(rows, "tion or 12,5", 7).select("doc_id")


_PARAGRAPHS = "select conv_id * 100 + turn as id, 'f' || conv_id as source_path, case when turn % 4 > 0 then turn end as paragraph_index, turn as first, turn + case when turn % 4 = 0 then 3 else 0 end as last, text, case when turn % 4 > 0 then 0 else 1 end as w from conversations"


@query(
    f"""with p as (select *, (contains(lower(text), 'tion'))::int as n from ({_PARAGRAPHS})), h as (select id, paragraph_index, row_number() over (order by n desc, source_path, first, w, id) as pos from p where n > 0), t as (select * from h where pos <= 3), s as (select paragraph_index as i from t where paragraph_index is not null union select 40),
    e as (select id, row_number() over (order by source_path, first, w, id) as pos from p where exists (select 1 from s where i between first - 2 and last + 2)), u as (select id, 0 as l, pos from t union all select id, 1, pos from e where pos <= 3)
    select id, l as list_no from (select *, row_number() over (partition by id order by l, pos) as k from u) where k = 1"""
)
def exact_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with the question's terms and those around them, in any file."""
    c, k = _read(spark, sf_dir, "conversations"), F.col("turn")
    window = k % 4 == 0
    rows = c.select((F.col("conv_id") * 100 + k).alias("id"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("source_path"), F.when(~window, k).alias("paragraph_index"), F.when(window, k).alias("paragraph_start_index"), F.when(window, k + 3).alias("paragraph_end_index"), F.col("text").alias("content"), F.when(window, "paragraph_window").otherwise("paragraph").alias("block_type"))
    found = rows.limit(1).select(F.lit(40).cast(dict(rows.dtypes)["paragraph_index"]).alias("paragraph_index"))
    return retrieval.exact_paragraphs(rows, found, "tion", 3).select("id", "list_no")


@query("with s as (select conv_id * 100 + turn as id, turn % 3 = 0 as docx, case when turn % 5 > 0 then (turn % 7) / 10.0 end as score, contains(lower(text), 'tion') as hit, turn % 4 = 0 as w from conversations), r as (select id, round(case when docx then coalesce(score, 0.75) + case when hit then 0.05 else 0 end + case when w then 0.03 else 0 end else coalesce(score, 0) end, 6)::double as rerank from s) select id, rerank, row_number() over (order by rerank desc, id) as rank from r")
def reranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn")
    rows = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + k).alias("id"), F.when(k % 3 == 0, "docx").otherwise("csv").alias("source_type"), F.when(k % 5 > 0, F.round((k % 7) / 10, 1)).alias("score"), F.col("text").alias("content"), F.when(k % 4 == 0, "paragraph_window").otherwise("paragraph").alias("block_type"))
    out = retrieval.reranked(rows, "tion", pos="id").select("id", F.round("rerank", 6).alias("rerank"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank"), "id")))


@query("select o_orderkey, true as truncated from orders order by o_orderkey limit 11")
def truncated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.truncated(_read(spark, sf_dir, "orders").select("o_orderkey"), 11, ["o_orderkey"])


@query("select pos, id as n_nationkey, n_name, n_name is not null as found from (values (0, 5), (1, 3), (2, 999), (3, 7)) v(pos, id) left join nation on n_nationkey = id")
def in_request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return retrieval.in_request_order(rows, [5, 3, 999, 5, 7], "n_nationkey").select("pos", "n_nationkey", "n_name", "found")


@query("select r_regionkey, coalesce(string_agg(n_name, ',' order by n_nationkey), '') as nations from region left join nation on n_regionkey = r_regionkey and n_nationkey % 5 <> 1 group by r_regionkey")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = _read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 1").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name")
    rows = retrieval.with_nested(_read(spark, sf_dir, "region").select("r_regionkey"), children, "r_regionkey", "nations", ["n_nationkey"])
    return rows.select("r_regionkey", F.array_join("nations.n_name", ",").alias("nations"))


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 50")
def sessions_by_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("select s_suppkey, s_name, n_name from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 2 = 0 and n_regionkey in (0, 1, 2)")
def documents_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    return docs.join(_read(spark, sf_dir, "nation").where("n_regionkey in (0, 1, 2)").select("n_nationkey", "n_name"), "n_nationkey").drop("n_nationkey")


# --- functions without a query of their own

_TEXTS = ["  Deal__A  1 ", "1 250 000", "1,250,000.00", "```sql\nselect 1;\n```", "a\n\n growth 5% \n NPS 7 up\nend ", "Ну и что?", "это", "12.50 and 3,0"]
#: By hand for each text: deal code, number, SQL, text without metric lines, follow-up, russian, numbers 12,5 and 3 present, excerpt of 12, title of 9.
_FORMS = [
    ("deal-a-1", "1", "Deal__A  1", "Deal__A  1", False, False, "Deal__A  1", "Deal__A 1"),
    ("1-250-000", "1250000", "1 250 000", "1 250 000", False, False, "1 250 000", "1 250 000"),
    ("1,250,000.00", "1250000", "1,250,000.00", "1,250,000.00", False, False, "1,250,000.00", "1,250,000"),
    ("```sql-select-1;-```", "1", "select 1", "```sql\nselect 1;\n```", False, False, "```sql\nselec...", "```sql se"),
    ("a-growth-5%-nps-7-up-end", "57", "a\n\n growth 5% \n NPS 7 up\nend", "a\n\nend", False, False, "a\ngrowth 5%...", "a growth "),
    ("ну-и-что?", None, "Ну и что?", "Ну и что?", True, False, "Ну и что?", "Ну и что?"),
    ("это", None, "это", "это", True, False, "это", "это"),
    ("12.50-and-3,0", "12503", "12.50 and 3,0", "12.50 and 3,0", False, True, "12.50 and 3,...", "12.50 and"),
]


@query(f"select doc_id, code, number, sql, metrics, follow, numbers, excerpt, title from (select doc_id, doc_id % {len(_TEXTS)} as n from documents) join {values([(i, *f) for i, f in enumerate(_FORMS)], 'n, code, number, sql, metrics, follow, numbers, excerpt, title')} using (n)")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of short texts, each written down by hand in the SQL."""
    t = F.col("t")
    rows = _read(spark, sf_dir, "documents").select("doc_id", pick(_TEXTS, F.col("doc_id")).alias("t"))
    return rows.select(
        "doc_id", text.deal_code(t).alias("code"), text.numeric_normal_form(t).alias("number"), text.sql_in_fence(t).alias("sql"), text.without_metric_lines(t, ["nps"], "none").alias("metrics"), text.is_follow_up(t, rules.FOLLOW_UP_MARKERS).alias("follow"),
        rules.has_numbers(t, ["12,5", "3"]).alias("numbers"), text.excerpt(t, 12).alias("excerpt"), text.title(t, 9).alias("title"),
    )


@query(
    """select doc_id, array_to_string(list_filter([case when lang = 'en' then 'Search' end, case when doc_id % 2 = 0 then 'tasks' end], lambda x: x is not null), ',') as kept, 'other' as discarded, lang || ',' || source as merged, lang || ',' || source as clean,
    case when doc_id % 3 = 0 then 'b' when doc_id % 3 = 1 then 'c' else 'a' end as confined, contains(lower(text), 'the ') or contains(lower(text), 'que ') as groups from documents"""
)
def list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed topics, merged and cleaned lists, confined ids and marker groups."""
    d, k = _read(spark, sf_dir, "documents"), F.col("doc_id")
    topics = F.filter(F.array(F.when(F.col("lang") == "en", F.lit(" SEARCH ")), F.when(k % 2 == 0, F.lit("tasks")), F.lit("other"), F.lit("")), lambda x: x.isNotNull())
    found = rules.allowed_topics(topics, ["Search", "tasks"])
    asked = F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("z"))).otherwise(F.array().cast("array<string>"))
    in_scope = F.when(k % 3 == 1, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    confined = access.confined(asked, in_scope, F.array(F.lit("a"), F.lit("b")))
    rows = d.select("doc_id", "text", "lang", "source", found.alias("f"), confined.alias("c"))
    merged = arrays.ordered_merge(F.array("lang"), F.array("source", "lang"))
    return rows.select("doc_id", F.array_join("f.kept", ",").alias("kept"), F.array_join("f.discarded", ",").alias("discarded"), F.array_join(merged, ",").alias("merged"), F.array_join(text.clean_list(F.array(F.concat(F.lit("  "), "lang"), "source", "lang", F.lit(" "))), ",").alias("clean"), F.element_at("c", 1).alias("confined"), text.groups_present(F.col("text"), [["the ", "que "]]).alias("groups"))


@query(
    """select doc_id, length(trim(text, chr(10) || chr(9) || ' ')) > 0 as filled, contains(lower(text), 'the ') or contains(lower(text), 'que ') as marked, not contains(lower(text), 'zzz') as clean, lang = 'en' as typed, doc_id % 2 = 0 as known, doc_id % 3 = 0 as provided from documents"""
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on an answer, as the columns of their map."""
    docs, k = _read(spark, sf_dir, "documents"), F.col("doc_id")
    known = [F.when(k % 2 == 0, F.array(F.lit("tasks"))), F.array(F.lit("search"))]
    flags = rules.quality_flags(F.col("text"), F.array("lang", F.lit("x")), groups=[["the ", "que "]], forbidden=["ZZZ".lower()], required_types=["en"], features={"tasks": known}, provider=(F.when(k % 3 == 0, "local"), "local"))
    names = {"filled": "response_is_not_empty", "marked": "response_has_required_markers", "clean": "response_has_no_forbidden_markers", "typed": "sources_have_required_types", "known": "context_has_tasks", "provided": "provider_is_expected"}
    return docs.select("doc_id", flags.alias("f")).select("doc_id", *(F.col("f")[v].alias(k) for k, v in names.items()))


@query("select o_orderkey from orders where o_custkey % 10 = 3 and o_orderkey % 4 = 1 order by o_orderstatus = 'O' desc, o_orderdate desc, o_orderkey limit 1")
def best_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_of = lambda c: c.cast("string")
    docs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), text_of(F.col("o_custkey") % 10).alias("owner_id"), F.concat(F.lit('{"content_sha256": "h'), text_of(F.col("o_orderkey") % 4), F.lit('"}')).alias("metadata"), F.when(F.col("o_orderstatus") == "O", "indexed").otherwise("failed").alias("status"), F.col("o_orderdate").alias("created_at"))
    return retrieval.best_upload(docs, owner="3", digest="h1").select(F.col("document_id").alias("o_orderkey"))


@query("""select '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","k":' || case when event_id % 2 = 0 then 'null' else '"' || event_type || '"' end || '}' as row from events""")
def json_safe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("k"))
    return retrieval.json_rows(rows)


@query("select event_type as model, count(*) as n, count(*) filter (where event_id % 5 <> 0) as exact, count(*) filter (where event_id % 3 <> 0) as tables from events group by event_type")
def statement_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a model's statement equals the wanted one as text, and names all wanted tables."""
    k = F.col("event_id")
    said = F.when(k % 5 == 0, "select 2").otherwise("```sql\nSELECT  1 ;\n```")
    tables = F.when(k % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (rules.sql_key(said) == "select 1").alias("exact"), rules.has_all(tables, ["a", "b"]).alias("tables"))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("exact"), F.count_if("tables").alias("tables"))
