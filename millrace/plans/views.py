"""Stand-in views: the chat, log and evaluation tables, derived from the tables that are at hand.

Each is a SELECT that Spark and DuckDB both run; the few words that differ between them come from a Dialect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def minutes(self, n: str) -> str:
        """A fixed epoch and so many minutes."""
        if self.spark:
            return f"timestampadd(MINUTE, cast({n} as int), timestamp_ntz'2024-01-01 00:00:00')"
        return f"(timestamp '2024-01-01 00:00:00' + to_minutes(cast({n} as int)))"

    def stamp(self, t: str) -> str:
        return f"date_format({t}, 'yyyy-MM-dd HH:mm:ss')" if self.spark else f"strftime({t}, '%Y-%m-%d %H:%M:%S')"

    def day(self, t: str) -> str:
        return f"date_format(date_trunc('day', {t}), 'yyyy-MM-dd')" if self.spark else f"strftime(date_trunc('day', {t}), '%Y-%m-%d')"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"list_value({', '.join(items)})"

    def unnest(self, a: str) -> str:
        return f"explode({a})" if self.spark else f"unnest({a})"

    def json(self, column: str, path: str) -> str:
        return f"get_json_object({column}, '$.{path}')" if self.spark else f"json_extract_string({column}, '$.{path}')"

    def mean(self, x: str, digits: int) -> str:
        return f"cast(round(cast(avg({x}) as decimal(38,6)), {digits}) as double)"

    def table(self, name: str) -> str:
        return f"{{{name}}}" if self.spark else name


SPARK, DUCKDB = Dialect(True), Dialect(False)


def views(d: Dialect) -> dict[str, str]:
    t = {n: d.table(n) for n in BASE}
    return {
        "chat_messages": f"select conv_id * 100 + turn as id, conv_id as session_id, role, text as content, turn, case when role = 'assistant' then concat('model-', cast(conv_id % 3 as string)) end as model, case when role = 'assistant' then concat('provider-', cast(conv_id % 2 as string)) end as provider, case when role = 'assistant' then (conv_id * 37 + turn * 101) % 5000 end as latency_ms, {d.minutes('conv_id * 90 + turn')} as created_at from {t['conversations']}",
        "chat_sessions": f"select c_custkey as id, concat('chat ', c_name) as title, {d.minutes('c_custkey * 7')} as created_at from {t['customer']}",
        "conversation_summaries": f"select conv_id as session_id, count(*) as message_count_at_update, {d.array(*(f'concat({chr(39)}topic-{chr(39)}, cast((conv_id + {k}) % 5 as string))' for k in (0, 2)))} as features, {d.minutes('conv_id * 61')} as created_at, {d.minutes('conv_id * 61 + count(*)')} as updated_at from {t['conversations']} group by conv_id",
        "rag_request_logs": f"select event_id as id, ts as created_at, event_type as model, value as latency_ms, concat('question ', cast(event_id as string)) as message, props, user_id, case when event_id % 4 = 0 then null else cast((event_id % 7) as double) / 10 end as score_threshold, event_id * 13 % 4000 as prompt_tokens_estimate, concat('collection-', cast(user_id % 3 as string)) as collection, {d.array(*(f'concat({chr(39)}feature-{chr(39)}, cast((event_id + {k}) % 6 as string))' for k in (0, 1)))} as features, {d.array(chr(39) + 'csv' + chr(39), 'event_type')} as source_types from {t['events']}",
        "rag_source_logs": f"select event_id * 3 + i as id, event_id as request_log_id, i + 1 as source_index, case when i = 0 then 'csv' when i = 1 then 'markdown' else 'docx' end as source_type, case when (event_id + i) % 9 = 0 then null else concat('title-', cast((event_id * 7 + i) % 50 as string)) end as title, concat('path/', cast((event_id + i) % 20 as string)) as source_path, case when (event_id + i) % 5 = 0 then null else cast((event_id * 31 + i * 17) % 1000 as double) / 1000 end as score, {d.array(f'concat({chr(39)}feature-{chr(39)}, cast((event_id + i) % 6 as string))')} as feature from {t['events']} cross join (select 0 as i union all select 1 union all select 2) v where event_id % 10 <> 3",
        "evaluation_runs": f"select n_nationkey as id, n_name as name, case when n_nationkey % 4 = 0 then 'failed' when n_nationkey % 4 = 3 then 'running' else 'completed' end as status, n_regionkey + 5 as scenario_count, {d.array(*(f'concat({chr(39)}model-{chr(39)}, cast((n_nationkey + {k}) % 4 as string))' for k in (0, 1)))} as models, {d.minutes('n_nationkey * 1440')} as started_at, case when n_nationkey % 4 = 3 then null else {d.minutes('n_nationkey * 1440 + 30')} end as completed_at from {t['nation']}",
        "evaluation_results": f"select p_partkey as id, p_partkey % 25 as run_id, p_size as scenario_id, concat('scenario ', cast(p_size as string)) as scenario_name, p_brand as model, case when p_partkey % 13 = 0 then null else p_retailprice end as latency_ms, case when p_partkey % 11 = 0 then 'timeout' when p_partkey % 17 = 0 then 'empty' end as error, case when p_partkey % 3 = 0 then '{{{{\"response_has_required_markers\": false}}}}' when p_partkey % 3 = 1 then '{{{{\"response_has_required_markers\": true}}}}' else '{{{{}}}}' end as quality_flags, {d.minutes('p_partkey * 3')} as created_at from {t['part']}",
    }


def with_views(d: Dialect, body: str) -> str:
    """The statement with those views before it that it names."""
    made = {k: v if d.spark else v.replace("{{", "{").replace("}}", "}") for k, v in views(d).items()}
    used = [k for k in made if k in body]
    if not used:
        return body
    heads = ", ".join(f"{k} as ({made[k]})" for k in used)
    return f"with {heads}, {body[5:]}" if body.startswith("with ") else f"with {heads} {body}"


def run(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    statement = with_views(SPARK, body)
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in BASE if f"{{{n}}}" in statement}
    return spark.sql(statement, **tables)
