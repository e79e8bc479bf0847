"""Queries over the driver's tables, one for each operator of the main library, with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, rules, text
from ..operators import access, metrics, retrieval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY_VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_VECTOR_SQL = f"[{', '.join(map(str, QUERY_VECTOR))}]::double[]"
_COS = f"round(list_cosine_similarity(embedding::double[], {_VECTOR_SQL})::double, 4)"

#: Keyword rules of the feature extractor and of the intent router, over the synthetic vocabulary.
FEATURES = {"import": ["import", "anth", "erth"], "export": ["export", "tion"], "billing": ["invoice", "edth"], "search": ["search", "ou"], "sync": ["sync", "ngre"]}
INTENTS = [("metric", ["metric", "ingly"]), ("document", ["document", "theth"]), ("ticket", ["ticket", "onan"]), ("review", ["review", "re "])]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- retrieval


@query(f"select vec_id, label, {_COS} as score from embeddings order by list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) desc, vec_id limit 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.top_k(_read(spark, sf_dir, "embeddings"), QUERY_VECTOR, 10, id_col="vec_id")
    return rows.select("vec_id", "label", F.round("score", 4).alias("score"))


@query(f"select vec_id, label, {_COS} as score from embeddings where label in (1, 3, 5) order by list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) desc, vec_id limit 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = retrieval.payload_filter(among={"label": [1, 3, 5], "vec_id": []})
    rows = retrieval.top_k(_read(spark, sf_dir, "embeddings"), QUERY_VECTOR, 10, id_col="vec_id", where=where)
    return rows.select("vec_id", "label", F.round("score", 4).alias("score"))


@query(f"select vec_id, {_COS} as score from embeddings where list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) >= 0.1")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _read(spark, sf_dir, "embeddings").withColumn("score", arrays.cosine(F.col("embedding"), QUERY_VECTOR))
    return retrieval.above_threshold(scored, 0.1).select("vec_id", F.round("score", 4).alias("score"))


@query(f"select vec_id, label, score from (select vec_id, label, {_COS} as score, row_number() over (partition by label order by list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) desc, vec_id) as n from embeddings) where n <= 2")
def topk_per_label_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _read(spark, sf_dir, "embeddings").withColumn("score", arrays.cosine(F.col("embedding"), QUERY_VECTOR))
    return retrieval.cap_per_key(scored, "label", 2, [F.desc("score"), F.asc("vec_id")]).select("vec_id", "label", F.round("score", 4).alias("score"))


@query()
def joint_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, its documents in order of id under caps on language and size class together."""
    docs = _read(spark, sf_dir, "documents").withColumn("size_class", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    caps = {"lang": 2, "size_class": 3}
    # of rows with equal keys no more than the smallest cap can be taken, and a blank language has none
    within = F.row_number().over(Window.partitionBy("source", "lang", "size_class").orderBy("doc_id"))
    most = F.when(F.coalesce("lang", F.lit("")) == "", caps["size_class"]).otherwise(min(caps.values()))
    open_ = docs.select("source", "doc_id", "lang", "size_class", within.alias("nth")).where(F.col("nth") <= max(caps.values())).where(F.col("nth") <= most)
    questions = open_.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang", "size_class"))).alias("rows"))
    kept = arrays.joint_caps(F.col("rows"), caps)
    return questions.select("source", F.inline(kept)).select("source", "doc_id", "lang", "size_class")


@query("select vec_id, list_no from (select vec_id, list_no, row_number() over (partition by vec_id order by list_no, pos) as n from (select vec_id, 0 as list_no, row_number() over (order by vec_id) as pos from embeddings where label in (1, 2) union all select vec_id, 1, row_number() over (order by vec_id desc) from embeddings where label in (2, 3))) where n = 1")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    first = rows.where("label in (1, 2)").select("vec_id", F.col("vec_id").alias("pos"))
    second = rows.where("label in (2, 3)").select("vec_id", (-F.col("vec_id")).alias("pos"))
    return retrieval.merge_by_priority([first, second], "vec_id", "pos").select("vec_id", "list_no")


@query("""
    with ranked as (select doc_id, lang, row_number() over (order by n_chars desc, doc_id) - 1 as pos from documents),
    top as (select * from ranked where pos < 5),
    extra as (select *, 0 as list_no from ranked where lang = 'es' and not exists (select 1 from top where lang = 'es') order by pos limit 2),
    both_ as (select * from extra union all select *, 1 from top)
    select doc_id, lang, list_no from (select *, row_number() over (partition by doc_id order by list_no, pos) as n from both_) where n = 1""")
def required_type_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    order = [F.desc("n_chars"), F.asc("doc_id")]
    number = F.row_number().over(Window.orderBy(*order)) - 1
    top = docs.orderBy(*order).limit(5).withColumn("pos", number).drop("n_chars")  # numbers five rows
    wanted = docs.where("lang = 'es'").orderBy(*order).limit(2).withColumn("pos", number).drop("n_chars")
    return retrieval.backfilled(top, wanted, kind="lang", wanted="es", limit=5, id_col="doc_id", pos="pos").select("doc_id", "lang", "list_no")


@query("select a.conv_id, a.turn from conversations a where exists (select 1 from conversations b where b.conv_id = a.conv_id and b.role = 'system' and abs(a.turn - b.turn) <= 1)")
def neighbour_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return retrieval.neighbours(rows, rows.where("role = 'system'"), "conv_id", "turn", 1).select("conv_id", "turn")


@query(f"select vec_id, round(coalesce(case when vec_id % 5 = 0 then null else {_COS} end, 0.75) + least(0.2, 0.05 * (vec_id % 7)) + case when vec_id % 2 = 0 then 0.03 else 0 end, 4) as score from embeddings")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _read(spark, sf_dir, "embeddings").withColumn("score", F.when(F.col("vec_id") % 5 != 0, F.round(arrays.cosine(F.col("embedding"), QUERY_VECTOR), 4)))
    score = retrieval.rerank_score(F.col("score"), F.col("vec_id") % 7, F.col("vec_id") % 2 == 0)
    return scored.select("vec_id", F.round(score, 4).alias("score"))


# --- texts


@query(r"""
    with d as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents),
    c as (select doc_id, unnest(case when length(t) <= 1800 then [0] else range(0, greatest(length(t) - 200, 1), 1600) end) as s, t from d),
    k as (select doc_id, s, regexp_replace(substr(t, (s + 1)::bigint, 1800), '^\s+|\s+$', '', 'g') as chunk, length(t) <= 1800 as whole from c)
    select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_index, length(chunk)::bigint as n, md5(chunk) as chunk_md5 from k where whole or chunk <> ''""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c"))
    return docs.select("doc_id", "c.chunk_index", F.length("c.chunk").cast("long").alias("n"), F.md5("c.chunk").alias("chunk_md5"))


@query("select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as previous, lead(role) over (partition by conv_id order by turn) as following from conversations")
def prev_next_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(order).alias("previous"), F.lead("role").over(order).alias("following"))


@query("with s as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 as p, count(*) over (partition by conv_id) as size from conversations) select conv_id, w as window_no, count(*) as n, md5(string_agg(text, chr(10) order by p)) as text_md5 from (select *, unnest(range(0, p // 6 + 1)) as w from s) where size >= 2 and p < w * 6 + 8 group by conv_id, w")
def paragraph_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of eight turns, a new one every six; none for a single turn."""
    rows = retrieval.windows(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", size=8, step=6)
    joined = F.array_join(F.transform("rows", lambda x: x["text"]), "\n")
    return rows.select("conv_id", "window_no", F.size("rows").cast("long").alias("n"), F.md5(joined).alias("text_md5"))


def _like(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query("select conv_id, turn, array_to_string(list_filter([" + ", ".join(f"case when {_like('text', w)} then '{n}' end" for n, w in FEATURES.items()) + "], lambda x: x is not null), ',') as features from conversations")
def feature_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.features(F.col("text"), FEATURES), ",").alias("features"))


@query("select conv_id, turn, case " + " ".join(f"when {_like('text', w)} then '{n}'" for n, w in INTENTS) + " else 'general' end as intent from conversations")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_intent(F.col("text"), INTENTS, "general").alias("intent"))


@query(rf"select doc_id, md5(regexp_replace(regexp_replace(text, '{text.PHONE}', '[PHONE]', 'g'), '{text.CARD}', '[CARD]', 'g')) as masked_md5 from documents")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.mask_pii(F.col("text"))).alias("masked_md5"))


@query("""select doc_id, '{"api_key": "***", "note": 1} X-Api-Key: ***, Authorization: Bearer *** bearer *** bearer short ' || text as redacted from documents""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with secrets of all four kinds before a text; what should be left is written in the SQL."""
    key = F.col("doc_id").cast("string")
    line = F.concat(F.lit('{"api_key": "'), key, F.lit('\\"x", "note": 1} X-Api-Key: k'), key, F.lit(", Authorization: Bearer t."), key, F.lit(" bearer abcdefgh"), key, F.lit(" bearer short "), F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", text.redact_secrets(line).alias("redacted"))


@query(r"select conv_id, turn, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end::bigint as floor_tokens, greatest(1, (length(text) + 3) // 4)::bigint as ceil_tokens from conversations")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens_floor(F.col("text")).alias("floor_tokens"), text.tokens_ceil(F.col("text")).alias("ceil_tokens"))


@query("select model, sum(n)::bigint as n, cast(round(sum(cost), 6) as double) as cost, bool_or(cost is null) as unknown from (select event_type as model, 1 as n, (price * value) / 1e6 as cost from events left join (values ('click', 1.5), ('view', 0.5)) p(event, price) on event = event_type) group by model")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown model costs null and not 0; the price table is two rows."""
    prices = spark.createDataFrame([("click", 1.5), ("view", 0.5)], "event_type string, price double")
    rows = _read(spark, sf_dir, "events").join(F.broadcast(prices), "event_type", "left").withColumn("cost", F.col("price") * F.col("value") / 1e6)
    return rows.groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"), F.bool_or(F.col("cost").isNull()).alias("unknown"))


@query("with h as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) as x from documents) select doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) as point_id from h")
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.uuid5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as domain, regexp_extract(html, '(?i)<html[^>]*lang=\"([a-z]+)\"', 1) as lang from pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("domain"), F.regexp_extract("html", r'(?i)<html[^>]*lang="([a-z]+)"', 1).alias("lang"))


# --- corpus rules


@query("with k as (select doc_id, lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) as key from documents), b as (select distinct lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) as key from benchmark) select doc_id, case when b.key is not null then 'churn_signal' when length(k.key) < 20 then 'noise' else 'feature' end as rule_class from k left join b using (key)")
def lexicon_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = _read(spark, sf_dir, "benchmark").select(text.plain_key(F.col("text")).alias("key")).distinct().withColumn("known", F.lit(True))
    rows = _read(spark, sf_dir, "documents").select("doc_id", text.plain_key(F.col("text")).alias("key")).join(phrases, "key", "left")
    return rows.select("doc_id", F.when(F.col("known"), "churn_signal").when(F.length("key") < 20, "noise").otherwise("feature").alias("rule_class"))


@query("with t as (select doc_id, coalesce(nfc_normalize(case when doc_id % 40 = 3 then null when doc_id % 40 = 5 then 'e' || chr(769) when doc_id % 40 = 7 then chr(233) else text end), '') as key from documents) select doc_id, case when n > 1 then 'exact_duplicate' end as rule_reason, case when n > 1 then first end as duplicate_of from (select doc_id, row_number() over (partition by key order by doc_id) as n, min(doc_id) over (partition by key) as first from t)")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a text (in NFC, null as empty) stays. The first id per text is combined before the exchange; hashes travel.

    Texts here have nulls and both forms of an accented letter among them.
    """
    k = F.col("doc_id") % 40
    mixed = F.when(k == 3, None).when(k == 5, "e\u0301").when(k == 7, "\u00e9").otherwise(F.col("text"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(mixed, F.lit("")).alias("t"))
    return retrieval.first_wins(docs, "doc_id", rules.nfc("t"))


@query("select lang, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic, count(*) filter (where l.doc_id is null) as unlabelled from documents d left join labels l using (doc_id) group by lang")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query("select quality, count(*) as n, round(count(*) / (select count(*) from labels), 6) as share from labels group by quality")
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _read(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a class


@query("select lang, min(length(text))::bigint as shortest, max(length(text))::bigint as longest, array_to_string(list_sort(list(distinct source)), ',') as sources from documents group by lang")
def length_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").groupBy("lang").agg(F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query(r"select sum(len(regexp_extract_all(text, '\d{3,}')))::bigint as numbers, sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')))::bigint as mails from documents")
def regex_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").agg(F.sum(F.regexp_count("text", F.lit(r"\d{3,}"))).alias("numbers"), F.sum(F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))).alias("mails"))


@query("with h as (select text from documents where doc_id % 50 = 0) select doc_id from documents where doc_id % 3 = 0 and text in (select text from h)")
def holdout_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text is in the holdout; `evaluation.refuse` raises at the first. The holdout is a part of the same table, so some are."""
    docs = _read(spark, sf_dir, "documents")
    return docs.where("doc_id % 3 = 0").join(docs.where("doc_id % 50 = 0").select("text"), "text", "left_semi").select("doc_id")


@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by sha256('seed' || chr(10) || doc_id::varchar)) as n from (select lang, text, min(doc_id) as doc_id from documents group by lang, text)) where n <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").groupBy("lang", F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.min("doc_id").alias("doc_id"))
    rank = F.sha2(F.concat(F.lit("seed\n"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return retrieval.cap_per_key(rows, "lang", 5, [rank]).select("lang", "doc_id")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by case lang when 'en' then 3 when 'de' then 2 when 'fr' then 1 else 0 end desc, n_chars desc, doc_id) as n from documents) where n = 1")
def best_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each key the best row by a tuple of ranks; max_by combines before the exchange."""
    rank = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 1).otherwise(0)
    return _read(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(rank, F.col("n_chars"), -F.col("doc_id"))).alias("doc_id"))


# --- scores


@query("""
    with r as (select quality as gold, case when doc_id % 6 = 0 then 1 - quality when doc_id % 11 = 0 then null else quality end as pred from labels),
    c as (select class, count(*) filter (where gold = class and pred = class) as tp, count(*) filter (where gold is distinct from class and pred = class) as fp, count(*) filter (where gold = class and pred is distinct from class) as fn from r, (values (0), (1), (2)) v(class) group by class),
    p as (select *, case when tp + fp <= 0 then 0.0 else tp / (tp + fp) end as precision, case when tp + fn <= 0 then 0.0 else tp / (tp + fn) end as recall from c),
    f as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from p)
    select class, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(avg(f1) over (), 6) as macro_f1 from f""")
def confusion_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = F.when(F.col("doc_id") % 6 == 0, 1 - F.col("quality")).when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("quality"))
    scores = metrics.class_scores(_read(spark, sf_dir, "labels").withColumn("pred", pred), "quality", "pred", [0, 1, 2])
    return scores.select("class", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1")))


@query("select count(*) filter (where r and m) as both, count(*) filter (where r and not m) as rules_only, count(*) filter (where not r and m) as model_only, count(*) filter (where not r and not m) as neither from (select toxic = quality as r, (doc_id % 2) = quality as m from labels)")
def agreement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.agreement(_read(spark, sf_dir, "labels").withColumn("model", F.col("doc_id") % 2), "quality", "toxic", "model")


@query("""
    with d as (select doc_id, list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) > 3)) as w, doc_id - doc_id % 2 as pair from documents),
    p as (select a.doc_id, a.w as expected, b.w as found from d a join d b on b.doc_id = a.pair + 1 - a.doc_id % 2)
    select doc_id, round(case when len(expected) = 0 then 0.0 else len(list_intersect(expected, found)) / len(expected) end, 6) as recall from p""")
def recall_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a text's longer words that its neighbour's text has; ids 2n and 2n + 1 are neighbours. Whole texts."""
    words = F.array_distinct(F.filter(F.split("text", " ", -1), lambda w: F.length(w) > 3))
    rows = _read(spark, sf_dir, "documents").select("doc_id", words.alias("expected"))
    other = F.col("doc_id") + 1 - 2 * (F.col("doc_id") % 2)
    pairs = rows.join(rows.select(other.alias("doc_id"), F.col("expected").alias("found")), "doc_id")
    return pairs.select("doc_id", F.round(arrays.recall(F.col("expected"), F.col("found")), 6).alias("recall"))


@query("select model, count(*) as n, floor(avg(latency_ms))::bigint as avg_latency, count(*) filter (where failed) as failed_flags, bool_or(failed) as any_failed from (select event_type as model, value as latency_ms, event_id % 10 = 0 as failed from events) group by model")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("failed", F.col("event_id") % 10 == 0)
    return rows.groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("value")).cast("long").alias("avg_latency"), F.count_if("failed").alias("failed_flags"), F.bool_or("failed").alias("any_failed"))


@query("select event_id, json_extract_string(props, '$.k') as k from events where try_cast(json_extract_string(props, '$.k') as int) % 7 = 0")
def flag_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return _read(spark, sf_dir, "events").select("event_id", k.alias("k")).where(F.col("k").try_cast("int") % 7 == 0)


_BOUNDS = [10.0, 50.0, 100.0, 250.0]
_HISTOGRAM = f"select event_type, le_no, le, count(*) filter (where value <= bound) as n from events, (values {', '.join(f'({i}, {chr(39)}{b}{chr(39)}, {b}::double)' for i, b in enumerate(_BOUNDS))}, (4, '+Inf', 'infinity'::double)) b(le_no, le, bound) where value is not null group by event_type, le_no, le"


@query(_HISTOGRAM)
def histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_read(spark, sf_dir, "events"), ["event_type"], "value", _BOUNDS)


@query(f"""
    with h as ({_HISTOGRAM}), r as (select *, coalesce(lag(n) over w, 0) as before, coalesce(lag(try_cast(le as double)) over w, 0) as lower, 0.95 * max(n) over (partition by event_type) as rank from h window w as (partition by event_type order by le_no))
    select event_type, round(case when le = '+Inf' then lower else lower + (le::double - lower) * (rank - before) / (n - before) end, 6) as p95 from r where n >= rank and before < rank""")
def histogram_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = metrics.histogram(_read(spark, sf_dir, "events"), ["event_type"], "value", _BOUNDS)
    return metrics.histogram_quantile(buckets, ["event_type"], 0.95).select("event_type", F.round("quantile", 6).alias("p95"))


# --- windows over time


@query("select event_id, in_window, in_window <= 3 as allowed from (select event_id, row_number() over (partition by user_id, floor(epoch(ts) / 3600) order by ts, event_id) as in_window from events)")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.fixed_window_admission(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600, 3, "event_id")
    return rows.select("event_id", F.col("in_window").cast("long").alias("in_window"), "allowed")


@query("select user_id, session_no, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session_no from (select user_id, ts, event_id, case when coalesce(floor(epoch(ts)) - lag(floor(epoch(ts))) over (partition by user_id order by ts, event_id) > 3600, true) then 1 else 0 end as new from events)) group by all")
def sessions_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.session_numbers(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600, "event_id")
    return rows.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 4")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cap_per_key(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", 4, [F.desc("turn")])


@query("select conv_id, count(*) as n, sum(case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end)::bigint as tokens, count(*) >= 8 or sum(case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end) >= 600 as due from conversations group by conv_id")
def summary_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(text.tokens_floor(F.col("text"))).alias("tokens"))
    return rows.withColumn("due", (F.col("n") >= 8) | (F.col("tokens") >= 600))


@query("with l as (select conv_id, list(case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end order by turn) as costs from conversations group by conv_id), r as (select conv_id, list_reduce(costs, lambda s, x: case when s // 100000 + x <= 350 then s + x * 100000 + 1 else s end, 0) as s from l) select conv_id, (s % 100000)::bigint as n_kept, (s // 100000)::bigint as used from r")
def prompt_memory_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", text.tokens_floor(F.col("text")).alias("cost"))))
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("parts"))
    kept = arrays.budgeted(F.col("parts"), 350)
    return rows.select("conv_id", F.size(kept).cast("long").alias("n_kept"), F.aggregate(kept, F.lit(0).cast("long"), lambda s, p: s + p["cost"]).alias("used"))


@query("select conv_id, count(*) as n, max(turn) as last_turn from conversations group by conv_id having count(*) >= 4 order by last_turn desc, conv_id limit 20")
def session_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))
    return rows.where("n >= 4").orderBy(F.desc("last_turn"), "conv_id").limit(20)


@query("select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as transcript_md5 from conversations group by conv_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))), lambda x: x["line"])
    return _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(lines, "\n")).alias("transcript_md5"))


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def latest_by_key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return access.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


# --- access and registries


@query("select doc_id from documents d where source in ('src0', 'src1', 'src2', 'src3') and (doc_id % 7 = 3 or doc_id % 3 = 0 or doc_id % 5 = 1 or exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1))")
def acl_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src1", "src2", "src3")).select(
        F.col("doc_id").alias("document_id"),
        F.lit("t1").alias("tenant_id"),
        F.when(F.col("doc_id") % 7 == 3, "u1").otherwise("u2").alias("owner_id"),
        F.when(F.col("doc_id") % 3 == 0, "tenant").otherwise("private").alias("visibility"),
        F.when(F.col("doc_id") % 5 == 1, F.array(F.lit("analyst"))).otherwise(F.array(F.lit("other"))).alias("allowed_roles"),
    )
    entries = _read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("user").alias("subject_type"), F.lit("u1").alias("subject_id"), F.lit("read").alias("permission"))
    return access.readable(docs, entries, tenant="t1", user="u1", roles=["analyst"]).select(F.col("document_id").alias("doc_id"))


@query("select n_nationkey, n_name, count(s_suppkey) as n from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey, n_name")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return access.bucket_counts(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), links, "n_nationkey")


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'F' and o_orderkey % 3 = 0)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return _read(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


# --- relational shapes


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("select c_mktsegment, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by all")
def segment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice").join(customers, "o_custkey")
    return rows.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by n_name order by revenue desc, n_name limit 10")
def supplier_nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue is summed per supplier before the joins, which then see a row per supplier."""
    by_supplier = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = by_supplier.join(_read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue")).orderBy(F.desc("revenue"), "n_name").limit(10)


@query("select l_orderkey, round(sum(l_extendedprice), 2) as total from lineitem group by l_orderkey having sum(l_quantity) > 150")
def large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.sum("l_quantity").alias("q"))
    return rows.where("q > 150").drop("q")


@query("select doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 1 except select doc_id from labels where toxic = 1")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels")
    docs = _read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return docs.intersect(labels.where("quality = 1").select("doc_id")).exceptAll(labels.where("toxic = 1").select("doc_id"))
