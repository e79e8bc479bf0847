"""What a conversation carries on: recent messages, follow-ups, rewritten questions, summaries and what fits a prompt."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, rules, text


def role_rank(role: Column) -> Column:
    """Of messages of one moment the user's comes first, then the assistant's."""
    return F.when(role == "user", 0).when(role == "assistant", 1).otherwise(2)


def recent(messages: DataFrame, session: str, at: str, role: str, id_col: str, most: int) -> DataFrame:
    """Each session's last messages, with their place from 1 in the order in which they were written."""
    order = [F.col(at), role_rank(F.col(role)), F.col(id_col)]
    last = Window.partitionBy(session).orderBy(*(c.desc() for c in order))
    kept = messages.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most)
    return kept.withColumn("place", F.count(F.lit(1)).over(Window.partitionBy(session)) - F.col("_n") + 1).drop("_n")  # at most `most` rows


def rewritten(messages: DataFrame, history: DataFrame, summaries: DataFrame, *, session: str = "session_id", message: str = "message") -> DataFrame:
    """Adds mode, features and query to each message.

    `history` has a session's recent messages (role, content, place), `summaries` its summary and features. Modes:
    no_history, topic_switch_or_standalone, standalone_question, no_reusable_history, follow_up_rewrite. A follow-up is
    searched with the last two questions, and with the summary where the questions have no feature of their own.
    """
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("place", "content")))), lambda x: x["content"])
    past = history.groupBy(session).agg(F.count(F.lit(1)).alias("_messages"), said.alias("_said"))  # recent messages only
    joined = messages.join(past, session, "left").join(summaries.select(session, F.col("summary").alias("_summary"), F.col("features").alias("_known")), session, "left")
    nothing = F.array().cast("array<string>")
    joined = joined.withColumns({"_current": rules.question_features(F.col(message)), "_follow": text.is_follow_up(F.col(message), rules.FOLLOW_UP_MARKERS), "_said": F.coalesce("_said", nothing)})
    carried = rules.question_features(F.array_join("_said", "\n"))
    joined = joined.withColumns({"_switch": rules.is_topic_switch(F.col(message), F.col("_current"), F.col("_follow")), "_carried": carried})
    mode = (
        F.when(F.col("_messages").isNull(), "no_history")
        .when(F.col("_switch"), "topic_switch_or_standalone")
        .when(~F.col("_follow"), "standalone_question")
        .when(F.size("_said") == 0, "no_reusable_history")
        .otherwise("follow_up_rewrite")
    )
    by_summary = F.col("_summary").isNotNull() & (F.size("_carried") == 0)
    effective = arrays.ordered_merge(F.col("_carried"), F.when(by_summary, F.coalesce("_known", nothing)).otherwise(nothing))
    last_two = F.array_join(F.when(F.size("_said") > 2, F.slice("_said", -2, 2)).otherwise(F.col("_said")), " ")
    joined = joined.withColumns({"mode": mode, "_effective": effective})
    parts = F.concat_ws(
        " ",
        F.col(message),
        text.strip(F.concat(F.lit(rules.TOPIC_BEFORE), last_two)),
        F.when(by_summary & (F.col("_summary") != ""), F.concat(F.lit(rules.SUMMARY_BEFORE), F.col("_summary"))),
        F.when(F.size("_effective") > 0, F.concat(F.lit(rules.FEATURES_BEFORE), F.array_join("_effective", ", "), F.lit("."))),
    )
    rewrite = F.col("mode") == "follow_up_rewrite"
    switched = rules.topic_query(F.col(message))
    own = F.when(F.col("mode") == "topic_switch_or_standalone", F.when(F.size(rules.question_features(switched)) > 0, rules.question_features(switched)).otherwise(F.col("_current"))).otherwise(F.col("_current"))
    query = F.when(rewrite, parts).when(F.col("mode") == "topic_switch_or_standalone", switched).otherwise(F.col(message))
    return joined.select(*messages.columns, "mode", F.when(rewrite, F.col("_effective")).otherwise(own).alias("features"), query.alias("query"))


def prompt_memory(history: DataFrame, summaries: DataFrame, *, session: str = "session_id", budget: int = 350) -> DataFrame:
    """Per session: what fits the budget of a summary, goals, and the recent messages from the latest on; labels and cost."""
    message = F.struct((F.lit(100) - F.col("place")).cast("int").alias("order"), F.concat(F.lit("message "), F.col("place").cast("string")).alias("label"), text.tokens_floor(F.col("content")).alias("cost"))
    said = history.groupBy(session).agg(F.collect_list(message).alias("_m"))  # recent messages only
    part = lambda order, label, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.struct(F.lit(order).alias("order"), F.lit(label).alias("label"), text.tokens_floor(c).alias("cost")))
    head = summaries.select(session, F.filter(F.array(part(0, "summary", F.col("summary")), part(1, "goals", F.array_join(last_of(F.col("goals"), 2), "; "))), lambda p: p.isNotNull()).alias("_h"))
    joined = said.join(head, session, "full").select(session, F.array_sort(F.concat(F.coalesce("_h", F.filter("_m", lambda x: F.lit(False))), F.coalesce("_m", F.filter("_h", lambda x: F.lit(False))))).alias("_p"))
    kept = arrays.budgeted(F.col("_p"), budget)
    return joined.select(session, F.transform(kept, lambda p: p["label"]).alias("labels"), F.aggregate(kept, F.lit(0).cast("long"), lambda s, p: s + p["cost"]).alias("used"))


def last_of(values: Column, n: int) -> Column:
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def summary_due(messages: Column, tokens: Column, at_update: Column, idle_seconds: Column, *, stale: int = 4, idle: int = 3600, most_tokens: int = 600, most: int = 8) -> Column:
    """Why a summary is due, or null: never made and large enough, many messages since, or idle with some since."""
    since = messages - F.coalesce(at_update, F.lit(0))
    large = F.when(messages >= most, "message_count").when(tokens >= most_tokens, "token_estimate")
    return F.when(at_update.isNull(), large).when(since >= stale, "stale").when((idle_seconds >= idle) & (since > 0), "idle")


def idle_seconds(last: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(last)).cast("long")


def feature_places(feature: str, places: Mapping[str, Column]) -> Column:
    """Whether a feature is in any of the lists."""
    out = F.lit(False)
    for values in places.values():
        out = out | F.coalesce(F.array_contains(values, feature), F.lit(False))
    return out
