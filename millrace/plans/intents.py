"""The statements of the question-to-SQL corpus, over the stand-in views.

Sort keys that tie under a LIMIT have the row's id after them; times are given as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import DUCKDB, SPARK, Dialect, run, with_views


def statements(d: Dialect) -> dict[str, str]:
    s, at = d.stamp, "created_at"
    count = lambda key, table, name, where="": f"select {key}, count(*) as {name} from {table} {where} group by {key} order by {name} desc, {key}"
    unnested = lambda alias, column, table, name: f"select {alias}, count(*) as {name} from (select {d.unnest(column)} as {alias} from {table}) x group by {alias}"
    mean = lambda key, x, table, out, digits, n="", where="", limit="": f"select {key}, {d.mean(x, digits)} as {out}{f', count(*) as {n}' if n else ''} from {table} {where} group by {key} order by {out} desc nulls last, {key} {limit}"
    errors = lambda columns, n: f"select {columns}, error, {s(at)} as created_at from evaluation_results where error is not null order by evaluation_results.created_at desc, id limit {n}"
    by_day = lambda t, table, out, name: f"select {d.day(t)} as {out}, count(*) as {name} from {table} group by {d.day(t)} order by {out} desc"
    full = "run_id, scenario_id, scenario_name, model"
    return {
        "latest_run_results_by_model": "select er.model, count(*) as result_count from evaluation_results er where er.run_id = (select id from evaluation_runs order by started_at desc limit 1) group by er.model order by result_count desc, er.model",
        "slowest_scenarios_avg_latency": mean("scenario_id, scenario_name", "latency_ms", "evaluation_results", "avg_latency_ms", 2, where="where latency_ms is not null", limit="limit 5"),
        "latest_runs_status": f"select id, name, status, scenario_count, {s('started_at')} as started_at, {s('completed_at')} as completed_at from evaluation_runs order by evaluation_runs.started_at desc limit 10",
        "quality_flags_marker_failures": f"select model, count(*) filter (where not coalesce(cast({d.json('quality_flags', 'response_has_required_markers')} as boolean), true)) as marker_failures from evaluation_results group by model order by marker_failures desc, model",
        "chat_messages_recent": f"select session_id, role, model, {s(at)} as created_at, left(content, 120) as content_preview from chat_messages order by chat_messages.created_at desc, id desc limit 20",
        "chat_messages_by_role": count("role", "chat_messages", "message_count"),
        "chat_sessions_activity": f"select session_id, message_count, {s('last_at')} as last_message_at from (select cs.id as session_id, count(cm.id) as message_count, max(cm.created_at) as last_at from chat_sessions cs left join chat_messages cm on cm.session_id = cs.id group by cs.id) x order by last_at desc nulls last, session_id limit 20",
        "conversation_summary_features": unnested("feature", "features", "conversation_summaries", "summary_count"),
        "conversation_summary_staleness": f"select session_id, message_count_at_update, {s('updated_at')} as updated_at from conversation_summaries order by conversation_summaries.updated_at, session_id limit 20",
        "rag_request_latency_by_model": mean("model", "latency_ms", "rag_request_logs", "avg_latency_ms", 2, "request_count"),
        "rag_requests_by_feature": unnested("feature", "features", "rag_request_logs", "request_count"),
        "rag_source_type_counts": count("source_type", "rag_source_logs", "source_count"),
        "rag_sources_by_request": f"select r.id, {s('r.created_at')} as created_at, r.model, coalesce(n, 0) as source_count from (select id, created_at, model from rag_request_logs order by created_at desc, id desc limit 20) r left join (select request_log_id, count(*) as n from rag_source_logs group by request_log_id) s on s.request_log_id = r.id",
        "top_rag_source_titles": "select title, count(*) as usage_count from rag_source_logs where title is not null group by title order by usage_count desc, title limit 10",
        "rag_source_scores": mean("source_type", "score", "rag_source_logs", "avg_score", 4, where="where score is not null"),
        "request_logs_score_thresholds": "select score_threshold, count(*) as request_count from rag_request_logs group by score_threshold order by score_threshold nulls last",
        "evaluation_models_per_run": unnested("model", "models", "evaluation_runs", "run_count"),
        "requests_with_high_prompt_tokens": f"select id, message, model, prompt_tokens_estimate, {s(at)} as created_at from rag_request_logs where prompt_tokens_estimate > 2000 order by rag_request_logs.created_at desc, id desc limit 20",
        "chat_latency_by_model": mean("model", "latency_ms", "chat_messages", "avg_latency_ms", 2, "message_count", "where latency_ms is not null"),
        "rag_sources_missing_title": count("source_type", "rag_source_logs", "missing_title_count", "where title is null"),
        "evaluation_error_rate_by_model": "select model, count(*) as total_results, count(*) filter (where error is not null) as error_count, cast(round(cast(count(*) filter (where error is not null) as double) / nullif(count(*), 0) * 100, 2) as double) as error_rate_percent from evaluation_results group by model",
        "validation_recent_runs": f"select id, name, {s('started_at')} as started_at, {s('completed_at')} as completed_at from evaluation_runs where status = 'completed' order by evaluation_runs.completed_at desc limit 5",
        "validation_rag_source_count_per_request": "select request_log_id, count(*) as source_log_count from rag_source_logs group by request_log_id order by source_log_count desc, request_log_id limit 20",
        "validation_summary_message_counts": f"select session_id, message_count_at_update, {s('updated_at')} as updated_at from conversation_summaries order by message_count_at_update desc, session_id limit 10",
        "validation_rag_collection_counts": count("collection", "rag_request_logs", "request_count"),
        "validation_sources_by_feature": unnested("feature", "feature", "rag_source_logs", "source_count"),
        "validation_sessions_without_messages": f"select cs.id, cs.title, {s('cs.created_at')} as created_at from chat_sessions cs left join chat_messages cm on cm.session_id = cs.id where cm.id is null order by cs.created_at desc, cs.id limit 20",
        "test_evaluation_runs_by_status": count("status", "evaluation_runs", "run_count"),
        "test_chat_provider_counts": count("provider", "chat_messages", "message_count"),
        "test_rag_requests_by_source_type": unnested("source_type", "source_types", "rag_request_logs", "request_count"),
        "test_evaluation_latest_errors": errors(full, 20),
        "test_rag_source_avg_score_by_title": mean("title", "score", "rag_source_logs", "avg_score", 4, "source_count", "where title is not null and score is not null", "limit 20"),
        "test_conversation_summaries_by_day": by_day(at, "conversation_summaries", "created_day", "summary_count"),
        "support_recent_error_results_compact": errors("run_id, scenario_id, scenario_name", 10),
        "support_error_results_by_model_recent": errors(full, 10),
        "support_avg_rag_score_by_source_type_with_count": mean("source_type", "score", "rag_source_logs", "avg_score", 4, "source_count", "where source_type is not null and score is not null"),
        "support_avg_rag_score_by_source_path_with_count": mean("source_path", "score", "rag_source_logs", "avg_score", 4, "source_count", "where source_path is not null and score is not null"),
        "support_chat_messages_by_created_day": by_day(at, "chat_messages", "created_day", "message_count"),
        "support_rag_requests_by_created_day": by_day(at, "rag_request_logs", "created_day", "request_count"),
        "support_summaries_by_updated_day": by_day("updated_at", "conversation_summaries", "updated_day", "summary_count"),
        "support_latest_error_results_full_projection": errors(full, 20),
        "support_latest_error_results_id_projection": errors("id, scenario_id", 20),
        "support_latest_error_results_model_projection_short": errors(full, 15),
        "support_error_count_projection_by_model": count("model", "evaluation_results", "error_count", "where error is not null"),
        # shapes that the model's answers added
        "answer_top_share": f"with per as (select model, {d.mean('latency_ms', 2)} as avg_ms from rag_request_logs group by model), everything as (select count(*) as n from per), ranked as (select per.model, avg_ms, row_number() over (order by avg_ms desc, model) as place, count(*) over () as models, n from per cross join everything) select model, avg_ms, place, models, n from ranked where place <= 5",
        "answer_above_own_mean": "select r.model, count(*) as slow from rag_request_logs r join (select model, avg(latency_ms) as m from rag_request_logs group by model) a on a.model = r.model where r.latency_ms > a.m group by 1",
    }


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, statements(SPARK)[name])


QUERIES = {f"sql_{n}": _query(n) for n in statements(SPARK)}
ORACLE_SQL = {f"sql_{n}": with_views(DUCKDB, s) for n, s in statements(DUCKDB).items()}
