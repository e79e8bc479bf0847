"""Line deduplication by a fixed-depth log-template tree (DataFrame functions only).

A line's tokens are parsed down a tree of fixed depth: first by how many they are, then by the leading `depth` tokens;
tokens with a digit count as a variable field from the start. Within a leaf, a later token stays in the template where
at least `min_docs` documents have it in that place; any other is a variable field and generalises. The template recurs
if its fixed tokens are at least the share `similar` of all and it stands in at least `min_docs` documents, identical
texts counting as one. Lines of recurring templates are dropped.

With `copies` = 0.8, a text of which at least that share (of its characters but white space) stands in recurring lines is taken for
a near copy of others that have these lines, and counts as one with those whose least recurring line (by MD5) is the same: a
family of near copies, which share nearly all their lines, makes a handful of units and not as many as it has members, so
what its members have in common is no boilerplate and stays. Texts that hold recurring lines beside more of their own count
each, and so do they for the lines of a family that stand in other documents too.

A document loses every recurring line, whatever share of it that is: the heavier it carries boilerplate, the more goes.

Only hashes of lines are shuffled for the counts. Texts of lines travel only where their leaf has enough documents, and
are written down once; the leaves are broadcast while they are at most `broadcast_rows`, and joined by a shuffle beyond.
A line is known by two 64-bit hashes, its leaf's and its own, and a template by the hash of all its fields.

Every line that isn't blank is counted (`min_tokens` 1); one of `depth` tokens or fewer is its own template. A line of
under five tokens that all hold a digit has no word to be a template by, and recurs only as it stands.

Defined results: null texts stay null and empty ones empty; blank lines and lines under `min_tokens` tokens stay;
repeated rows lose the same lines; an empty table gives an empty result; other columns are kept. Lines end at \\n; of a
document that loses lines the others are joined by \\n again.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import checkpointed, without_places

VARIABLE = "<*>"
#: Lines of one to four tokens with a digit in each.
BARE = r"^[^ 0-9]*+[0-9][^ ]*(?: [^ 0-9]*+[0-9][^ ]*){0,3}$"


def masked(text: Column) -> Column:
    """Tokens with a digit become variable fields; looked at from a token's first character only."""
    return F.regexp_replace(text, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)


def fields(line: Column, part: Column, min_tokens: int) -> Column:
    """A part of a line with its variable fields, or as it stands if the line is short and all of digits."""
    return masked(part) if min_tokens > 4 else F.when(line.rlike(BARE), part).otherwise(masked(part))


def parsed_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """One row per line: id, text_hash, total (the text's bytes but white space, computed where asked for), at, spaced (the line with single spaces) and leaf (a hash).

    White space and the text's hash are seen to once a text, before its lines become rows; of a line only the leading
    tokens are masked, as the leaf asks for no more than these and the number of tokens.
    """
    spaced = F.regexp_replace(docs[text_col], r"[\t\x0B\f\r][ \t\x0B\f\r]*| [ \t\x0B\f\r]+", " ")
    total = F.octet_length(F.regexp_replace(docs[text_col], r"[ \n\t\x0B\f\r]+", "")).alias("total")
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), total, F.split(spaced, "\n").alias("lines"))
    rows = texts.select("id", "text_hash", "total", F.posexplode("lines").alias("at", "raw")).withColumn("spaced", F.trim("raw")).drop("raw")
    size = F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(F.col("size"), fields(F.col("spaced"), F.substring_index("spaced", " ", depth), min_tokens))
    return rows.withColumn("size", size).where((F.col("size") >= min_tokens) & (F.col("spaced") != "")).withColumn("leaf", leaf).drop("size")


def recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, similar: float = 0.7, min_docs: int = 8, min_tokens: int = 1, broadcast_rows: int = 500_000, copies: float | None = None) -> DataFrame:
    """Per document with such lines: id, text_hash, drop (places of the lines to drop, from 0)."""
    lines = parsed_lines(docs, id_col, text_col, depth, min_tokens)
    leaves = lines.select("leaf", "text_hash").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    leaves = checkpointed(leaves)
    hint = F.broadcast if leaves.count() <= broadcast_rows else (lambda df: df)
    sizes = [] if copies is None else [F.octet_length(F.replace("spaced", F.lit(" "), F.lit(""))).alias("size"), "total"]
    near = lines.join(hint(leaves), "leaf").select("id", "text_hash", "at", "leaf", *sizes, fields(F.col("spaced"), F.col("spaced"), min_tokens).alias("masked"))
    near = near.select("id", "text_hash", "at", "leaf", *(c for c in near.columns if c in ("size", "total")), F.xxhash64("masked").alias("line"), F.split("masked", " ").alias("tokens"))
    return _recurring(checkpointed(near), depth, similar, min_docs, copies)


def _recurring(near: DataFrame, depth: int, similar: float, min_docs: int, copies: float | None) -> DataFrame:
    by_text = near.groupBy("leaf", "line", "text_hash").agg(F.any_value("tokens").alias("tokens"))
    distinct = by_text.groupBy("leaf", "line").agg(F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    placed = distinct.select("leaf", "line", "n", F.posexplode("tokens").alias("place", "token")).where(F.col("place") >= depth)
    support = placed.groupBy("leaf", "place", "token").agg(F.sum("n").alias("docs"))
    fixed = support.where(F.col("docs") >= min_docs).select("leaf", "place", "token")
    # each line's later fields in order, so a line costs as much as it has tokens
    later = placed.join(fixed.withColumn("fixed", F.lit(True)), ["leaf", "place", "token"], "left")
    fields_of = later.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("token")).otherwise(VARIABLE).alias("field")))).alias("fields"), F.count("fixed").alias("n_fixed"))
    leading = F.least(F.lit(depth), F.size("tokens"))
    general = distinct.join(fields_of, ["leaf", "line"], "left").select(
        "leaf",
        "line",
        F.xxhash64("leaf", F.slice("tokens", 1, depth), F.coalesce(F.col("fields.field"), F.array().cast("array<string>"))).alias("template"),
        ((F.coalesce("n_fixed", F.lit(0)) + leading) / F.size("tokens")).alias("share"),
    )
    templates = general.where(F.col("share") >= similar).select("leaf", "line", "template")
    in_docs = by_text.select("leaf", "line", "text_hash").join(templates, ["leaf", "line"]).select("template", "text_hash").distinct()
    recurring = in_docs.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")
    if copies is not None:
        in_docs, recurring = checkpointed(in_docs), checkpointed(recurring)
        marks = distinct.select("leaf", "line", F.md5(F.array_join("tokens", " ")).alias("mark"))
        shared = templates.join(recurring, "template").join(marks, ["leaf", "line"]).select("leaf", "line", "mark")
        # identical texts are one
        held = near.join(shared, ["leaf", "line"]).groupBy("text_hash", "at").agg(F.any_value("size").alias("size"), F.any_value("total").alias("total"), F.any_value("mark").alias("mark"))
        units = held.groupBy("text_hash").agg(F.sum("size").alias("size"), F.any_value("total").alias("total"), F.min("mark").alias("unit")).where(F.col("size") >= copies * F.col("total")).select("text_hash", "unit")
        unit = F.coalesce("unit", F.col("text_hash").cast("string"))
        by_unit = in_docs.join(recurring, "template").join(units, "text_hash", "left").select("template", unit.alias("unit")).distinct()
        recurring = by_unit.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")
    dropped = near.select("id", "text_hash", "at", "leaf", "line").join(templates.join(recurring, "template").select("leaf", "line"), ["leaf", "line"])
    # as many as the document has lines
    return dropped.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("drop"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dropped_col: str = "dropped_lines", **limits: Any) -> DataFrame:
    """The documents, all columns, with recurring lines dropped from the text, and their places in `dropped_col`."""
    drop = recurring_lines(docs, id_col=id_col, text_col=text_col, **limits).select(F.col("id").alias("_drop_id"), F.col("text_hash").alias("_drop_hash"), F.col("drop").alias("_drop"))
    joined = docs.join(drop, docs[id_col].eqNullSafe(drop["_drop_id"]) & (F.xxhash64(docs[text_col]) == drop["_drop_hash"]), "left")
    none = F.array().cast("array<int>")
    return joined.withColumn(text_col, F.when(F.col("_drop").isNotNull(), F.array_join(without_places(F.split(F.col(text_col), "\n"), F.col("_drop")), "\n")).otherwise(F.col(text_col))).withColumn(dropped_col, F.coalesce("_drop", none)).drop("_drop_id", "_drop_hash", "_drop")
