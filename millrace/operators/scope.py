"""What a request may see and ask for: limits, scopes, roles and the shape of its sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text

#: Tools and the roles that may use them (none: everyone who is signed in), sales buckets, indexed classes.
TOOL_ROLES = {
    "get_user_context": [],
    "list_buckets": [],
    "list_bucket_documents": [],
    "get_document_status": [],
    "analyze_image": [],
    "rag_search": [],
    "text_to_sql": ["analyst", "admin"],
    "execute_readonly_sql": ["analyst", "admin"],
}
SALES_BUCKETS = ["sales_northwind", "sales_aurora"]
INDEXED_CLASSES = ["bug", "feature"]


def is_narrow(*scopes: Column) -> Column:
    """One to three values in all scopes together."""
    total = sum((F.coalesce(F.size(s), F.lit(0)) for s in scopes), F.lit(0))
    return (total >= 1) & (total <= 3)


def scoped_threshold(threshold: Column, narrow: Column, target: float = 0.45) -> Column:
    return F.when(narrow & threshold.isNotNull(), F.least(threshold, F.lit(target))).otherwise(threshold)


def resolved(readable: DataFrame, requested: DataFrame, in_buckets: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Indexed documents that the user may read: of the requested ones if any is asked for, else of the buckets', else all."""
    indexed = readable.where(F.col("status") == "indexed").select(id_col).distinct()
    asked = requested.agg((F.count(F.lit(1)) > 0).alias("_asked")).join(in_buckets.agg((F.count(F.lit(1)) > 0).alias("_boxed")))  # one row each
    marked = indexed.join(requested.select(id_col).distinct().withColumn("_r", F.lit(True)), id_col, "left").join(in_buckets.select(id_col).distinct().withColumn("_b", F.lit(True)), id_col, "left")
    chosen = F.when(F.col("_asked"), F.col("_r")).when(F.col("_boxed"), F.col("_b")).otherwise(True)
    return marked.join(F.broadcast(asked)).where(F.coalesce(chosen, F.lit(False))).select(id_col)


def enters_index(feedback_class: Column, flag: Column) -> Column:
    return F.coalesce(flag & feedback_class.isin(*INDEXED_CLASSES), F.lit(False))


def is_synthetic(metadata: Column) -> Column:
    """The flag at the top or in document_metadata of a JSON text; no metadata is no flag."""
    flag = lambda path: F.coalesce(F.get_json_object(metadata, path) == "true", F.lit(False))
    return flag("$.synthetic") | flag("$.document_metadata.synthetic")


def any_non_synthetic(metadata: Column) -> Column:
    """Over a group of sources; one without metadata isn't synthetic."""
    return F.coalesce(F.bool_or(~is_synthetic(metadata)), F.lit(False))


def without_synthetic(metadata: Column) -> Column:
    """A map without the flag, at the top and under the document's prefix."""
    return F.map_filter(metadata, lambda k, v: ~k.isin("synthetic", "document_metadata.synthetic"))


def external_scope(approach: Column, endpoint: Column, session_seen: Column, retrieved: Column) -> Column:
    """struct(allow_generation, allow_fallback, persist, reason, status): 403 where external generation met other evidence."""
    kind = rules.approach(approach)
    persist = F.coalesce(retrieved, F.lit(False)) | F.coalesce(session_seen, F.lit(False))
    return F.struct(
        ((kind == "external") & ~persist).alias("allow_generation"),
        ((kind == "hybrid") & (endpoint == "rag") & ~persist).alias("allow_fallback"),
        persist.alias("persist"),
        F.when(retrieved, "retrieved_non_synthetic").when(session_seen, "session_memory").alias("reason"),
        F.when((kind == "external") & persist, 403).otherwise(200).alias("status"),
    )


def may_invoke(tool: Column, roles: Column, matrix: Mapping[str, Sequence[str]] = TOOL_ROLES) -> Column:
    """Unknown tools are for nobody; admins may use all known ones."""
    out = F.lit(False)
    for name, needed in matrix.items():
        held = F.lit(True) if not needed else F.arrays_overlap(roles, F.array(*map(F.lit, [*needed, "admin"])))
        out = F.when(tool == name, held).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_sales_scope(buckets: Column) -> Column:
    """At least one bucket, and each a sales bucket; blank ones don't count."""
    named = F.filter(F.transform(buckets, lambda b: F.trim(b)), lambda b: b != "")
    return F.coalesce((F.size(named) > 0) & F.forall(named, lambda b: b.isin(*SALES_BUCKETS)), F.lit(False))


def is_indexed_image(status: Column, source_type: Column) -> Column:
    return (status == "indexed") & F.lower(source_type).isin("png", "jpg", "jpeg", "image", "image_ocr", "image_digest")


def prefer_named(rows: DataFrame, query: str, name: str = "organization") -> DataFrame:
    """Rows whose organisation the query names; all rows where it names none."""
    hit = (text.strip(F.col(name)) != "") & F.contains(F.lit(query.lower()), F.lower(text.strip(F.col(name))))
    marked = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    any_hit = marked.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_any"))  # one row
    return marked.join(F.broadcast(any_hit)).where("_hit or not _any").drop("_hit", "_any")


def broken_limits(message: Column, top_k: Column, lists: Mapping[str, Column], *, chars: int, most_k: int, items: int, item_chars: int) -> Column:
    """Names of the limits that a request breaks, in order."""
    checks = [F.when(F.length(message) > chars, "message"), F.when((top_k < 1) | (top_k > most_k), "top_k")]
    for name, values in lists.items():
        checks.append(F.when((F.size(values) > items) | F.exists(values, lambda v: F.length(v) > item_chars), name))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def source_columns(rows: DataFrame, payload: str = "payload", known: Sequence[str] = ("title", "source_type", "source_path", "content")) -> DataFrame:
    """A payload map as named columns, and the rest of it as metadata."""
    named = [F.try_element_at(payload, F.lit(k)).alias(k) for k in known]
    rest = F.map_filter(payload, lambda k, v: ~k.isin(*known)).alias("metadata")
    return rows.select(*(c for c in rows.columns if c != payload), *named, rest)


def under_policy(rows: DataFrame, without_numbers: Column, markers: Sequence[str], fallback: str) -> DataFrame:
    """Titles and contents without lines of metrics where the policy asks for that."""
    clean = lambda c: F.when(without_numbers, text.without_metric_lines(F.col(c), markers, fallback)).otherwise(F.col(c))
    return rows.withColumns({"title": clean("title"), "content": clean("content")})
