"""One query for each training-data operator: thin digests of what the operator returns, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, html_extract, line_dedup, negatives, packing, quality, quality_rules, sharding, simhash, substring, url_filter, whitening
from .util import table


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_quality(docs.select("doc_id", "text"), field, out="score")
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    made = whitening.whiten(rows, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.get(F.array(*map(F.lit, model.explained.tolist())).cast("array<double>"), F.col("place"))
    return made.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, forest).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "quality_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_crf, op2_decontamination, op3_best_fit_packing, op4_html_main_text, op5_url_filter, op6_repeated_passages, op7_minimax_shards, op8_line_templates, op9_exact_dedup, op10_simhash_vp_trees, op11_whitening, op12_quality_rules, op13_hard_negatives, pipeline)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _rule_sql(column: int) -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    cases = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(h + p, v)[column]}'" for h, p, v in rules)
    return f"case {cases} end"


_TERMS = ", ".join(f"('{term}', {weight:g})" for term, weight in url_filter.vocabulary().items())


ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
        with item as (select item_id::varchar as item, {_WORDS} as w from benchmark where item_id is not null),
        cut as (select item, w, least(len(w), 10) as n from item where len(w) > 0),
        known as (select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as phrase from (select *, unnest(range(1, len(w) - n + 2)) as i from cut)),
        doc as (select doc_id, {_WORDS} as w from documents),
        sized as (select doc_id, w, n from doc, (select distinct n from known) s where len(w) >= n),
        seen as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as phrase from (select *, unnest(range(1, len(w) - n + 2)) as i from sized)),
        hit as (select doc_id, item, i, s.n from seen s join known k on s.phrase = k.phrase and s.n = k.n),
        words as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by 1),
        items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, item from hit) group by 1)
        select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(list, '')) as items_sha256, n_hit is not null as contaminated
        from doc d left join words using (doc_id) left join items using (doc_id)""",
    "op5_url_filter": f"""
        with split as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
        term as (select * from (values {_TERMS}) v(term, weight)),
        hit as (select page_id, sum(weight) as weight from (select distinct page_id, lower(coalesce(url, '')) as u from split), term where contains(u, term) and regexp_matches(u, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') group by 1)
        select s.page_id, host, path, {_rule_sql(0)} as rule, coalesce({_rule_sql(1)}, case when weight >= 2 then 'block' else 'allow' end) as verdict from split s left join hit h on s.page_id = h.page_id""",
    "op9_exact_dedup": f"""
        with t as (select doc_id, {_LOWER} as t from documents),
        r as (select *, row_number() over (partition by t order by doc_id desc nulls last) as place, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from t)
        select doc_id, keep_id, group_size, place = 1 as kept, sha256(t) as text_sha256 from r""",
    "op8_line_templates": r"""
        with doc as (select doc_id, text, string_split(text, chr(10)) as l from documents),
        line as (select doc_id, text, unnest(l) as raw, unnest(range(0, len(l))) as pos from doc),
        spaced as (select doc_id, text, pos, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' ') as s from line),
        masked as (select *, string_split(case when regexp_matches(s, '^[^ ]*[0-9][^ ]*( [^ ]*[0-9][^ ]*){0,3}$') then s else regexp_replace(s, '[^ ]*[0-9][^ ]*', '<*>', 'g') end, ' ') as tokens from spaced where s <> ''),
        parsed as (select *, (len(tokens), tokens[1:3]) as leaf from masked),
        leaves as (select leaf from parsed group by leaf having count(distinct text) >= 8),
        near as (select p.* from parsed p join leaves using (leaf)),
        lines as (select leaf, tokens, count(distinct text) as n from near group by all),
        placed as (select leaf, tokens, n, unnest(tokens) as token, unnest(range(0, len(tokens))) as place from lines),
        fixed as (select leaf, place, token from placed where place >= 3 group by all having sum(n) >= 8),
        general as (
            select p.leaf, p.tokens, list(case when p.place < 3 or f.token is not null then p.token else '<*>' end order by p.place) as template,
                sum(case when p.place < 3 or f.token is not null then 1 else 0 end) / len(p.tokens) as share
            from placed p left join fixed f on p.leaf = f.leaf and p.place = f.place and p.token = f.token group by p.leaf, p.tokens),
        templated as (select n.doc_id, n.text, n.pos, n.leaf, g.template from near n join general g on n.leaf = g.leaf and n.tokens = g.tokens where g.share >= 0.7),
        recurring as (select leaf, template from templated group by all having count(distinct text) >= 8),
        dropped as (select doc_id, list(distinct pos) as gone from templated join recurring using (leaf, template) group by doc_id),
        cleaned as (select d.doc_id, coalesce(len(x.gone), 0) as n, case when x.gone is null then d.text else array_to_string(list_filter(d.l, lambda e, i: not list_contains(x.gone, i - 1)), chr(10)) end as t from doc d left join dropped x using (doc_id))
        select doc_id, n::bigint as n_dropped, length(t)::bigint as n_chars_left, sha256(t) as text_sha256 from cleaned""",
    "op13_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
            from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        score as (select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same, list_inner_product(a.q, r.q)::bigint as s from v a, v r where a.vec_id % 100 = 0 and r.vec_id <> a.vec_id),
        positive as (select anchor_id, other_id as positive_id, s as positive_score from score where same qualify row_number() over (partition by anchor_id order by s desc, other_id) <= 5),
        negative as (
            select p.*, row_number() over (partition by p.anchor_id, positive_id order by s desc, other_id) as rank, other_id as negative_id, s as negative_score
            from positive p join score n on p.anchor_id = n.anchor_id where not same and 30 * positive_score <= 100 * s and 100 * s <= 90 * positive_score)
        select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negative where rank <= 10""",
}
