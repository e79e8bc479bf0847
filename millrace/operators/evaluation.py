"""Reports on a corpus and on evaluation runs: tallies, gates, comparisons and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from . import numbering

#: The classes in their order, and those that are indexed.
CLASSES = ["noise", "churn_signal", "bug", "feature"]
INDEXED = ["bug", "feature"]


def counts_for(buckets: DataFrame, items: DataFrame, key: str, label: str, classes: Sequence[str], flag: str) -> DataFrame:
    """Per bucket, empty ones included: a count for each class, and how many are flagged. A bucket that isn't there has no row."""
    counted = items.groupBy(key).agg(*(F.count_if(F.col(label) == c).alias(c) for c in classes), F.count_if(F.col(flag)).alias("indexed"))
    zero = F.lit(0).cast("long")
    return buckets.select(key).join(counted, key, "left").select(key, *(F.coalesce(c, zero).alias(c) for c in (*classes, "indexed")))


def tally(rows: DataFrame, *, generated: str, ruled: str, is_copy: str, before_copies: bool) -> DataFrame:
    """label, n: by generated class without copies, or by ruled class with them; `total` counts all rows, whatever the class."""
    used = rows.where(~F.col(is_copy)) if before_copies else rows
    label = F.col(generated if before_copies else ruled)
    counted = used.agg(*(F.count_if(label == c).alias(c) for c in CLASSES), F.count(F.lit(1)).alias("total"))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in (*CLASSES, "total")))))


def shares_within(rows: DataFrame, label: str, targets: Mapping[str, float], points: float) -> DataFrame:
    """label, share (6 digits), within: whether each share is at most so many percentage points from its target."""
    counted = rows.agg(*(F.count_if(F.col(label) == c).alias(c) for c in targets), F.count(F.lit(1)).alias("_all"))
    share = lambda c: F.when(F.col("_all") > 0, F.col(c) / F.col("_all")).otherwise(0.0)
    each = [F.struct(F.lit(c).alias("label"), F.bround(share(c), 6).alias("share"), ((F.col("_all") > 0) & (F.abs(share(c) - t) * 100 <= points)).alias("within")) for c, t in targets.items()]
    return counted.select(F.inline(F.array(*each)))


def missing_scenarios(rows: DataFrame, label: str, scenario: str, known: Sequence[str]) -> DataFrame:
    """How many rows of an indexed class have no known scenario; null isn't known."""
    return rows.agg(F.count_if(F.col(label).isin(*INDEXED) & ~F.coalesce(F.col(scenario).isin(*known), F.lit(False))).alias("missing"))


def indexed_by_class(rows: DataFrame, label: str, flag: str) -> DataFrame:
    return rows.agg(*(F.count_if(F.col(flag) & (F.col(label) == c)).alias(c) for c in INDEXED))


def mismatches(rows: DataFrame, *, id_col: str, generated: str, ruled: str, reason: str, content: str) -> DataFrame:
    """Rows whose ruled class isn't the generated one, and exact copies; a preview of 80 characters."""
    differs, copy = ~F.col(generated).eqNullSafe(F.col(ruled)), F.coalesce(F.col(reason) == "exact_duplicate", F.lit(False))
    kinds = F.filter(F.array(F.when(differs, F.lit("mismatch")), F.when(copy, F.lit("suppressed"))), lambda k: k.isNotNull())
    return rows.select(F.explode(kinds).alias("kind"), id_col, generated, ruled, reason, F.substring(content, 1, 80).alias("preview"))


def with_copies(parts: Sequence[DataFrame], order: str, copies: Mapping[int, int]) -> DataFrame:
    """Parts one after another, then the first rows of some again: number (from 1, without gaps), part, is_copy.

    All rows are numbered by ranges of (is_copy, part, order), however large a part is.
    """
    tagged = [df.select(F.lit(i).alias("part"), F.lit(False).alias("is_copy"), *df.columns) for i, df in enumerate(parts)]
    tagged += [parts[i].orderBy(order).limit(n).select(F.lit(i).alias("part"), F.lit(True).alias("is_copy"), *parts[i].columns) for i, n in copies.items()]
    placed = numbering.numbered(reduce(DataFrame.unionByName, tagged), ["is_copy", "part", order], "number")
    return placed.withColumn("number", F.col("number") + 1)


def differences(rows: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """key, field: fields in which a row differs from the frozen one of the same key; `_row` where one side lacks it."""
    fields = [c for c in rows.columns if c != key]
    left, right = rows.select(key, F.struct(*fields).alias("_l")), frozen.select(key, F.struct(*fields).alias("_r"))
    both = left.join(right, key, "full")
    unlike = F.array(*(F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in fields))
    named = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.array(F.lit("_row"))).otherwise(F.filter(unlike, lambda x: x.isNotNull()))
    return both.select(key, F.explode(named).alias("field"))


def refuse(rows: DataFrame, what: str) -> None:
    """Raises if there is a row; looks for one and no more."""
    found = rows.first()
    if found is not None:
        raise ValueError(f"{what}: {found.asDict()}")


def same_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values on one side only, with the side; none if both sides are equal as sets."""
    return left.subtract(right).withColumn("side", F.lit("left")).union(right.subtract(left).withColumn("side", F.lit("right")))


def means(rows: DataFrame, key: Sequence[str], metrics: Sequence[str], hits: str | None = None) -> DataFrame:
    """Means by key that skip nulls, the number of rows, and of those with a hit."""
    extra = [F.count_if(F.size(hits) > 0).alias("hit_runs")] if hits else []
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(f"mean_{m}") for m in metrics), *extra)


def accepted(rows: DataFrame, *, arm: str, hits: str, metrics: Sequence[str], epsilon: float = 1e-9) -> DataFrame:
    """Whether arm h1 has runs and none with a hit, and no mean below that of h0. Without runs of both arms it raises."""
    base, new = F.col(arm) == "h0", F.col(arm) == "h1"
    some = F.when((F.count_if(base) == 0) | (F.count_if(new) == 0), F.raise_error(F.lit("runs of both arms are needed")).cast("boolean")).otherwise(True)
    cleared = (F.count_if(new) > 0) & (F.count_if(new & (F.col(hits) > 0)) == 0)
    kept = [(F.avg(F.when(new, F.col(m))) + epsilon >= F.avg(F.when(base, F.col(m)))) for m in metrics]
    named = [k.alias(f"{m}_kept") for k, m in zip(kept, metrics, strict=True)]
    return rows.agg(cleared.alias("cleared"), *named, (some & cleared & reduce(Column.__and__, kept)).alias("accepted"))


def ceiling_note(rows: DataFrame, *, search: str, scenario: str, expected: Sequence[str], top_k: int) -> DataFrame:
    """Whether repeated scenarios, rather than the limit k, hid an expected id: capacity, mean_unique, never_found, needed."""
    wanted = list(dict.fromkeys(expected))
    capacity = min(top_k, len(wanted))
    named = F.when(F.col(scenario) != "", F.col(scenario))
    each = rows.groupBy(search).agg(F.count_distinct(named).alias("n"), F.collect_set(F.when(named.isin(*wanted), named)).alias("f"))  # as many as are expected
    total = each.agg(F.avg("n").alias("mean"), F.max("n").alias("most"), F.array_distinct(F.flatten(F.collect_set("f"))).alias("found"))
    never = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("found", F.array().cast("array<string>")))
    needed = (F.size(never) > 0) & F.coalesce(F.col("most") < capacity, F.lit(False))
    return total.select(F.lit(capacity).alias("capacity"), F.coalesce("mean", F.lit(0.0)).alias("mean_unique"), F.sort_array(never).alias("never_found"), needed.alias("needed"))


def lexicon_classes(rows: DataFrame, noise: DataFrame, churn: DataFrame, *, content: str, fallback: str, phrase: str = "phrase") -> DataFrame:
    """Adds rule_class and rule_reason: a text whose key is a phrase of churn, also if it is one of noise, then of noise alone;
    any other keeps the class in `fallback`, and one outside of the classes raises. Phrases are joined by the hashes of their keys, each once."""
    key = lambda c: F.sha2(text.composed_key(F.col(c)).cast("binary"), 256)
    lists = [df.select(key(phrase).alias(f"_{name}_key")).distinct().withColumn(f"_{name}", F.lit(True)) for name, df in (("churn", churn), ("noise", noise))]
    keyed = rows.withColumn("_key", key(content))
    for listed in lists:
        keyed = keyed.join(listed, F.col("_key") == F.col(listed.columns[0]), "left")
    outside = F.raise_error(F.concat(F.lit("class outside of the classes: "), F.coalesce(F.col(fallback), F.lit("null")))).cast("string")
    kept = F.when(F.col(fallback).isin(*CLASSES), F.col(fallback)).otherwise(outside)
    found = F.when(F.col("_churn"), F.lit("churn_signal")).when(F.col("_noise"), F.lit("noise"))
    reason = F.when(F.col("_churn"), "lexicon_churn").when(F.col("_noise"), "lexicon_noise").otherwise("keep_generator")
    return keyed.withColumns({"rule_class": F.coalesce(found, kept), "rule_reason": reason}).select(*rows.columns, "rule_class", "rule_reason")


def stratified(rows: DataFrame, holdout: DataFrame, *, id_col: str, content: str, label: str, per_class: int, seed: str, classes: Sequence[str] = CLASSES, held: str = "text") -> tuple[DataFrame, DataFrame]:
    """An equal share of each class: (class, id, rank from 1), and (class, shortfall) of those with fewer rows.

    Texts that have a key on the holdout are out, equal keys of a class count once, by the smallest id, and ranks go by
    the SHA-256 of seed and id. Keys travel as hashes.
    """
    key = lambda c: F.sha2(text.composed_key(F.col(c)).cast("binary"), 256).alias("_key")
    known = rows.where(F.col(label).isin(*classes)).select(F.col(label).alias("class"), F.col(id_col).alias("id"), key(content)).where(F.col("_key").isNotNull())
    left = known.join(holdout.select(key(held)).distinct(), "_key", "left_anti").groupBy("class", "_key").agg(F.min("id").alias("id"))
    order = F.sha2(F.concat(F.lit(f"{seed}\n"), F.col("id").cast("string")).cast("binary"), 256)
    ranked = left.select("class", "id", F.row_number().over(Window.partitionBy("class").orderBy(order, "id")).alias("rank")).where(F.col("rank") <= per_class)
    all_ = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    counted = all_.join(ranked.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left")
    short = counted.select("class", (F.lit(per_class) - F.coalesce("n", F.lit(0))).cast("int").alias("shortfall")).where("shortfall > 0")
    return ranked, short


def with_cost(rows: DataFrame, prices: DataFrame, *, out: str = "cost") -> DataFrame:
    """Adds what a call costs by its provider, model, prompt_tokens and completion_tokens; null for a model without prices.
    `prices` has provider, model, input and output, for a million tokens each; a price list, of one row a model."""
    listed = prices.select(F.col("provider").alias("_provider"), F.col("model").alias("_model"), F.col("input").alias("_in"), F.col("output").alias("_out"))
    joined = rows.join(listed, (F.col("provider") == F.col("_provider")) & (F.col("model") == F.col("_model")), "left")
    return joined.withColumn(out, rules.cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("_in"), F.col("_out"))).select(*rows.columns, out)


def model_report(rows: DataFrame, key: str = "model") -> DataFrame:
    """Per model: results, whole mean latency and mean sources (two digits, none counting as 0), skipped, and of the others
    errors and false flags. Rows have latency_ms, source_count, error, skipped and flags."""
    failed, skipped = F.size(rules.failed_flags(F.col("flags"))), F.coalesce("skipped", F.lit(False))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.floor(F.avg("latency_ms")).cast("long").alias("avg_latency"),
        F.bround(F.avg(F.coalesce("source_count", F.lit(0))), 2).alias("avg_sources"),
        F.count_if((F.coalesce("error", F.lit("")) != "") & ~skipped).alias("errors"),
        F.count_if(skipped).alias("skipped"),
        F.sum(F.when(skipped, 0).otherwise(F.greatest(F.coalesce(failed, F.lit(0)), F.lit(0)))).cast("long").alias("failed_flags"),
    )


def scenario_summary(rows: DataFrame, key: str) -> DataFrame:
    """Per scenario: count, rows without sources, errors, skipped, false flags."""
    failed = F.size(rules.failed_flags(F.col("flags")))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source_count") == 0).alias("zero_source"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if("skipped").alias("skipped"),
        F.sum(F.when(F.col("skipped"), 0).otherwise(F.coalesce(failed, F.lit(0)))).cast("long").alias("failed_flags"),
    )


def flag_failures(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows that weren't skipped and have a false flag or an error: id, failed (sorted names), error."""
    failed = F.sort_array(rules.failed_flags(F.col("flags")))
    return rows.where(~F.coalesce("skipped", F.lit(False))).select(id_col, F.coalesce(failed, F.array().cast("array<string>")).alias("failed"), "error").where("size(failed) > 0 or error is not null")


def run_summary(rows: DataFrame, key: Column, flags: Sequence[str], latency: str) -> DataFrame:
    """By key (null: unknown): count, how often each flag holds and of how many it is known, mean latency (banker's rounding)."""
    counts = [c for f in flags for c in (F.count_if(F.col(f)).alias(f), F.count(f).alias(f"{f}_known"))]
    return rows.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"), *counts, F.bround(F.avg(latency), 2).alias("mean_latency"))


def guardrails(rows: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """By key: the count, and of each check how many rows break it; all in one pass."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in checks.items()))


def counter(rows: DataFrame, labels: Sequence[str], amount: Column | None = None) -> DataFrame:
    """Sum by label set; a null label is a label of its own."""
    return rows.groupBy(*labels).agg(F.sum(F.lit(1) if amount is None else amount).alias("value"))


def exposition(buckets: DataFrame, rows: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    """A histogram's lines: its cumulative buckets, then sum and count."""
    totals = rows.where(F.col(value).isNotNull()).groupBy(*labels).agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("c"))
    lines = totals.select(*labels, F.inline(F.array(F.struct(F.lit("sum").alias("line"), F.lit("").alias("le"), F.col("s").alias("value")), F.struct(F.lit("count").alias("line"), F.lit("").alias("le"), F.col("c").alias("value")))))
    return buckets.select(*labels, F.lit("bucket").alias("line"), "le", F.col("n").cast("double").alias("value")).union(lines)


def text_by_path(rows: DataFrame, path: str, content: str, order: str) -> DataFrame:
    """A file's contents in order, with a blank line between them; as long as the file is."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), "\n\n")
    return rows.groupBy(path).agg(joined.alias(content))


def evidence(digests: DataFrame, ocr: DataFrame, contents: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """Picture digests with the recognised text of the same picture and the text of the same file, where there are any."""
    return digests.join(ocr.withColumnRenamed("content", "ocr"), list(key), "left").join(contents.withColumnRenamed("content", "document"), path, "left")
