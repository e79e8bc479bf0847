"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column | str) -> Column:
    """The text with A to Z lower-cased and nothing else changed; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(column, F.lit(""))
    # of a text that is all ASCII, lower() changes these letters only, and takes a fraction of translate()'s time
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder that spark.checkpoint.dir names; where it is unset a folder is made, if all is on one machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def without_places(items: Column, drop: Column) -> Column:
    """The array without the elements at the sorted places `drop` (from 0): the stretches between these, each copied once."""
    from_ = F.concat(F.array(F.lit(-1)), drop)

    def kept(array: Column) -> Column:
        return F.flatten(F.zip_with(from_, F.concat(drop, F.array(F.size(array))), lambda a, b: F.slice(array, a + 2, b - a - 1)))

    # as the one element of an array, `items` is evaluated once and not for every stretch
    return F.transform(F.array(items), kept)[0]


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, split: int) -> DataFrame:
    """Adds `out`, the row's place from 0 in its group, without holding a group in one task.

    Each group is cut by a hash of the order columns, and of a tag for rows that are equal in all of them, into `split` parts; a part's rows are numbered by a window, and the
    parts before it are added as an offset from a table of `split` counts per group.
    """
    part = f"_{out}_part"
    # written down with the tag, which a second reading could give otherwise
    cut = checkpointed(df.withColumn(part, F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(split))))
    counts = cut.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, part).orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(within))
    return ranked.join(offsets, [*group, part]).withColumn(out, F.col("_before") + F.col("_rank") - 1).drop(part, "_before", "_rank")
