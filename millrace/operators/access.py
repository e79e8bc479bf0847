"""Who may see what: access rules, scopes and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenant_matches(left: Column, right: Column) -> Column:
    """Blank or null never matches."""
    return F.coalesce((F.trim(left) == F.trim(right)) & (F.trim(left) != ""), F.lit(False))


def allowed(docs: DataFrame, entries: DataFrame, *, tenant: str, user: str, roles: Sequence[str], permissions: Sequence[str], by_visibility: bool) -> DataFrame:
    """Documents of the tenant that the user may use: as admin or owner, by visibility or role, or by an entry."""
    subject = ((F.col("subject_type") == "user") & (F.col("subject_id") == user)) | ((F.col("subject_type") == "role") & F.col("subject_id").isin(*roles))
    by_entry = entries.where(subject & F.col("permission").isin(*permissions)).select("document_id").distinct().withColumn("_by_entry", F.lit(True))
    own = (F.lit("admin" in roles)) | (F.col("owner_id") == user)
    if by_visibility:
        own = own | (F.col("visibility") == "tenant") | F.arrays_overlap("allowed_roles", F.array(*map(F.lit, roles)))
    return docs.where(F.col("tenant_id") == tenant).join(by_entry, "document_id", "left").where(F.coalesce(own, F.lit(False)) | F.col("_by_entry")).drop("_by_entry")


def readable(docs: DataFrame, entries: DataFrame, *, tenant: str, user: str, roles: Sequence[str]) -> DataFrame:
    return allowed(docs, entries, tenant=tenant, user=user, roles=roles, permissions=["read", "write", "admin"], by_visibility=True)


def manageable(docs: DataFrame, entries: DataFrame, *, tenant: str, user: str, roles: Sequence[str]) -> DataFrame:
    return allowed(docs, entries, tenant=tenant, user=user, roles=roles, permissions=["write", "admin"], by_visibility=False)


def confined(requested: Column, scope: Column, chat: Column) -> Column:
    """Requested ids inside the scope or chat; else the scope; else the chat's first."""
    within = F.array_intersect(requested, F.array_union(scope, chat))
    return F.when(F.size(within) > 0, within).when(F.size(scope) > 0, scope).otherwise(F.slice(chat, 1, 1))


def bucket_counts(buckets: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Buckets with their number of links, zero included; links are counted before the join."""
    counted = links.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def latest_per_key(rows: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """An upsert's outcome: of each key the row with the largest `newest`; max_by combines before the exchange."""
    others = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct(*newest)).alias("_best")
    return rows.groupBy(*key).agg(best).select(*key, "_best.*")
