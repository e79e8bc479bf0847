"""Evaluation and service metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import f1, ratio


def class_scores(rows: DataFrame, gold: str, predicted: str, classes: Sequence[object]) -> DataFrame:
    """Per class, absent ones included: tp, fp, fn, precision, recall, f1, and macro_f1 over all classes.

    One pass; a prediction outside of the classes is a miss and no class of its own.
    """
    counts = [F.count_if((F.col(gold) == c) & (F.col(predicted) == c)).alias(f"tp{i}") for i, c in enumerate(classes)]
    counts += [F.count_if((F.coalesce(F.col(gold) != c, F.lit(True))) & (F.col(predicted) == c)).alias(f"fp{i}") for i, c in enumerate(classes)]
    counts += [F.count_if((F.col(gold) == c) & F.coalesce(F.col(predicted) != c, F.lit(True))).alias(f"fn{i}") for i, c in enumerate(classes)]
    one = rows.agg(*counts)
    each = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, c in enumerate(classes)))).alias("c")).select("c.*")
    scored = each.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    scored = scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return scored.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy()))  # as many rows as classes


def confusion(rows: DataFrame, gold: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """gold, predicted, n for each pair of classes, and for each class what wasn't parsed (null); empty pairs are 0. A gold
    class outside of `classes` raises; another prediction is in no cell."""
    outside = F.raise_error(F.concat(F.lit("gold class outside of the classes: "), F.coalesce(F.col(gold).cast("string"), F.lit("null")))).cast("boolean")
    known = rows.where(F.when(F.col(gold).isin(*classes), F.lit(True)).otherwise(outside))
    cells = [(g, p) for g in classes for p in (*classes, None)]
    counts = [F.count_if((F.col(gold) == g) & (F.col(predicted).isNull() if p is None else F.col(predicted) == p)) for g, p in cells]
    table = F.array(*(F.struct(F.lit(g).alias("gold"), F.lit("unparsed" if p is None else p).alias("predicted"), n.alias("n")) for (g, p), n in zip(cells, counts, strict=True)))
    return known.agg(table.alias("cells")).select(F.inline("cells"))


def split_score(rows: DataFrame, gold: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """One row: rows, unparsed, accuracy (0 of no rows) and macro_f1 over all classes."""
    by_class = class_scores(rows, gold, predicted, classes).agg(F.first("macro_f1").alias("macro_f1"))
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(predicted).isNull()).alias("unparsed"), F.count_if(F.col(gold) == F.col(predicted)).alias("_right"))
    return counted.withColumn("accuracy", ratio(F.col("_right"), F.col("rows"))).drop("_right").join(F.broadcast(by_class))  # one row and one row


def mean(rows: DataFrame, metric: str) -> DataFrame:
    """The mean of a metric; no rows, or none with a value, raise."""
    empty = F.raise_error(F.lit(f"no values of {metric}")).cast("double")
    return rows.agg(F.when(F.count(metric) == 0, empty).otherwise(F.avg(metric)).alias(f"mean_{metric}"))


def agreement(rows: DataFrame, gold: str, rule: str, model: str) -> DataFrame:
    by_rule, by_model = F.col(rule) == F.col(gold), F.col(model) == F.col(gold)
    return rows.agg(F.count_if(by_rule & by_model).alias("both"), F.count_if(by_rule & ~by_model).alias("rules_only"), F.count_if(~by_rule & by_model).alias("model_only"), F.count_if(~by_rule & ~by_model).alias("neither"))


def histogram(rows: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative buckets (le, n), the last being +Inf; a value counts from the first bound at or above it."""
    le = F.lit("+Inf")
    for bound in sorted(bounds, reverse=True):
        le = F.when(F.col(value) <= bound, F.lit(str(bound))).otherwise(le)
    names = [*map(str, sorted(bounds)), "+Inf"]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*labels).agg(*(F.count_if(le == n).alias(n) for n in names))
    running = [(n, sum((F.col(f"`{m}`") for m in names[: i + 1]), F.lit(0)).cast("long")) for i, n in enumerate(names)]
    return counted.select(*labels, F.inline(F.array(*(F.struct(F.lit(i).alias("le_no"), F.lit(n).alias("le"), c.alias("n")) for i, (n, c) in enumerate(running)))))


def histogram_quantile(buckets: DataFrame, labels: Sequence[str], q: float) -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank; the last finite bound where that is +Inf."""
    order = Window.partitionBy(*labels).orderBy("le_no")  # as many rows as bounds
    total = F.max("n").over(Window.partitionBy(*labels))
    rows = buckets.withColumns({"upper": F.col("le").try_cast("double"), "before": F.coalesce(F.lag("n").over(order), F.lit(0)), "rank": F.lit(q) * total})
    rows = rows.withColumn("lower", F.coalesce(F.lag("upper").over(order), F.lit(0.0)))
    inside = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("rank") - F.col("before")) / (F.col("n") - F.col("before"))
    value = F.when(F.col("le") == "+Inf", F.col("lower")).otherwise(inside)
    hit = rows.where((F.col("n") >= F.col("rank")) & (F.col("before") < F.col("rank")))
    return hit.select(*labels, value.alias("quantile"))


def run_status(failed: Column) -> Column:
    return F.when(F.bool_or(failed), "failed").otherwise("completed")


def fixed_window_admission(rows: DataFrame, key: str, ts: str, seconds: int, limit: int, tie: str) -> DataFrame:
    """Aligned windows; a request is allowed while its number in the window is at most the limit."""
    window = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds).alias("window_no")
    numbered = rows.withColumn("window_no", window).withColumn("in_window", F.row_number().over(Window.partitionBy(key, "window_no").orderBy(ts, tie)))
    return numbered.withColumn("allowed", F.col("in_window") <= limit)


def session_numbers(rows: DataFrame, key: str, ts: str, idle_seconds: int, tie: str) -> DataFrame:
    """Numbers of sessions that end after more than `idle_seconds` without a row."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    now = F.unix_timestamp(F.col(ts).cast("timestamp"))
    fresh = F.coalesce(now - F.lag(now).over(order) > idle_seconds, F.lit(True)).cast("int")
    return rows.withColumn("_new", fresh).withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
