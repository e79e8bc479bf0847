"""Numbers without gaps that no task counts alone: ranges, counts per range, and sums of the counts before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def numbered(rows: DataFrame, order: Sequence[str], out: str, *, group: Sequence[str] = (), parts: int = 0) -> DataFrame:
    """Adds `out`, the row's place from 0 in its group (of all rows, without one) by the columns of `order`.

    Rows are dealt out by ranges of group and order, equal ones by a tag too, so that neither a large group nor many equal rows
    are one task's. A range's rows are numbered by a window, and the rows of the group in the ranges before are added from
    a table of one row for each range that a group is in. The ranges are written down, as a second reading of the input
    could cut them elsewhere. Of rows equal in all of `order` any may come first.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by: list[Column] = [F.col(c) for c in (*group, *order)]
    tagged = rows.withColumn("_tag", F.monotonically_increasing_id())
    ranges = checkpointed(tagged.repartitionByRange(parts, *by, F.col("_tag")).withColumn("_part", F.spark_partition_id()))
    counts = ranges.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = counts.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.col("_part").alias("_of_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_part").orderBy(*order, "_tag")
    placed = ranges.withColumn("_place", F.row_number().over(within))
    same = placed["_part"] == offsets["_of_part"]
    for c in group:
        same = same & placed[c].eqNullSafe(offsets[f"_of_{c}"])
    return placed.join(offsets, same).withColumn(out, F.col("_before") + F.col("_place") - 1).select(*rows.columns, out)
