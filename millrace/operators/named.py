"""Files and deals that a message names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from . import dictionary


def name_key(name: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\p{L}\p{N}]", "")


def requested_files(messages: DataFrame, documents: DataFrame, *, key: str = "message_id", message: str = "message", id_col: str = "document_id", name: str = "file_name") -> DataFrame:
    """Per message and requested name: pos, requested, id of the document, or null where none is meant.

    A document is meant whose name is the same in any case (of several the smallest id); else, for a name with an
    extension, the only one of which either name ends with the other. Names of one message that mean one document give one
    row. The search for endings joins each suffix of a name on its words, so it is an equi-join and no comparison of all pairs.
    """
    asked = messages.select(key, F.posexplode(rules.file_names(F.col(message))).alias("pos", "requested")).withColumn("_k", F.lower("requested"))
    have = documents.select(F.col(id_col).alias("_id"), F.lower(text.strip(F.col(name))).alias("_n")).where("_n <> ''")
    exact = have.groupBy("_n").agg(F.min("_id").alias("_exact"))
    # all endings of both sides: a name is found among the other's endings
    endings = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.length(c)))
    by_name = asked.where(F.contains("_k", F.lit("."))).select(key, "pos", F.explode(endings(F.col("_k"))).alias("_n")).join(have, "_n").select(key, "pos", "_id")
    by_request = have.select("_id", F.explode(endings(F.col("_n"))).alias("_k")).join(asked.where(F.contains("_k", F.lit("."))).select(key, "pos", "_k"), "_k").select(key, "pos", "_id")
    only = by_name.union(by_request).groupBy(key, "pos").agg(F.min("_id").alias("_one"), F.max("_id").alias("_other")).where("_one = _other").select(key, "pos", "_one")
    found = asked.join(exact, asked["_k"] == exact["_n"], "left").join(only, [key, "pos"], "left").select(key, "pos", "requested", F.coalesce("_exact", "_one").alias(id_col))
    first = F.row_number().over(Window.partitionBy(key, id_col).orderBy("pos"))
    return found.withColumn("_n", first).where(F.col(id_col).isNull() | (F.col("_n") == 1)).drop("_n")


def documents_named(messages: DataFrame, documents: DataFrame, *, key: str = "message_id", message: str = "message", id_col: str = "document_id", name: str = "file_name", shortest: int = 3, **limits: int) -> DataFrame:
    """Documents whose name without its extension stands in a message, with the place of it; letters and digits count.

    An automaton of the names reads each message once; rows are the names found, and then the documents of these names.
    """
    said = messages.select(key, name_key(F.col(message)).alias("_m"))
    stem = F.regexp_replace(text.strip(F.col(name)), r"(?<=.)\.[^.]*$", "")
    have = documents.select(id_col, name_key(stem).alias("_stem")).where(F.length("_stem") >= shortest)
    met = dictionary.occurrences(said, have, text="_m", name="_stem", **limits)
    return met.join(have, "_stem").groupBy(key, id_col).agg(F.min("place").alias("place"))


def resolved_deal(messages: DataFrame, deals: DataFrame, *, key: str = "message_id", message: str = "message", **limits: int) -> DataFrame:
    """The deal whose code, title or alias is the longest that stands in the message; none where two deals tie.

    `deals` has bucket_id, deal_code, title, aliases. Of the needles that an automaton finds in a message only the longest
    are looked up.
    """
    said = messages.select(key, text.deal_code(F.col(message)).alias("_m"))
    needles = deals.select("bucket_id", "deal_code", F.explode(F.concat(F.array("deal_code", "title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_raw"))
    needles = needles.select("bucket_id", "deal_code", text.deal_code(F.col("_raw")).alias("_needle")).where("_needle <> ''").distinct()
    met = dictionary.occurrences(said, needles, text="_m", name="_needle", longest_only=True, **limits).withColumn("_size", F.length("_needle"))
    # the longest of each block of names, of which the longest of all are left
    most = met.groupBy(key).agg(F.max("_size").alias("_most"))
    # of a needle that many deals share the first and the last tell that they tie
    deal = F.struct("bucket_id", "deal_code")
    meant = needles.groupBy("_needle").agg(F.min(deal).alias("_first"), F.max(deal).alias("_last"))
    longest = met.join(most, key).where("_size = _most").select(key, "_needle").join(meant, "_needle")
    one = longest.groupBy(key).agg(F.min("_first").alias("_least"), F.max("_last").alias("_deal")).where("_least = _deal")
    return one.select(key, "_deal.bucket_id", "_deal.deal_code")


def deal_card(deals: DataFrame, tenant: str, buckets: Sequence[str], code: str) -> DataFrame:
    """At most one card."""
    return deals.where((F.col("tenant_id") == tenant) & F.col("bucket_id").isin(*buckets) & (F.col("deal_code") == code)).orderBy("bucket_id").limit(1)


def deal_first(sources: DataFrame, matches: Column, limit: int, *, pos: str = "pos", id_col: str = "id") -> DataFrame:
    """The deal's own sources, then playbooks and notes. Others come before these only where the deal has none."""
    playbook = F.col("source_type").isin("sales_playbook", "sales_note")
    marked = sources.withColumn("_class", F.when(matches, 0).when(playbook, 2).otherwise(1))
    has = marked.agg(F.coalesce(F.bool_or(F.col("_class") == 0), F.lit(False)).alias("_has"))  # one row
    kept = marked.join(F.broadcast(has)).where("_class <> 1 or not _has")
    once = kept.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("_class", pos))).where("_n = 1")
    return once.orderBy("_class", pos).limit(limit).drop("_class", "_has", "_n")


def card_rows(deals: DataFrame) -> DataFrame:
    """Cards as evidence: id, title, source_type, source_path, content, one fact a line."""
    facts = {"code": F.col("deal_code"), "title": F.col("title"), "amount": F.concat_ws(" ", F.col("amount").cast("string"), "currency"), "status": F.col("status"), "close date": rules.close_date(F.col("close_date")), "owner": F.col("owner"), "bucket": F.col("bucket_id")}
    place = F.concat_ws("/", F.lit("demo_deals"), "bucket_id", "deal_code")
    return deals.select(F.concat_ws(":", F.lit("deal_card"), "bucket_id", "deal_code").alias("id"), F.concat(F.lit("Deal card "), "deal_code").alias("title"), F.lit("deal_card").alias("source_type"), place.alias("source_path"), text.row_to_text(facts).alias("content"))
