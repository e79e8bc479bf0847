"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only).

Each input partition yields one sorted run of (digest, best row, count). In every round `fan_in` neighbouring runs
exchange their entries by (target run, digest) and are merged; after log(runs) rounds one run is left, spread over all
tasks by digest, so no task ever holds a run whole. Copies collapse inside their own partition before the first
exchange, which is why a hot text costs each task one entry. The best row travels as a struct, for which Spark sorts
and merges (SortAggregate) instead of hashing. A round moves every entry once, so `fan_in` 2, the binomial exchange of
pairs, moves them log2(runs) times and 8, the default, a third as often.

Equality is verified at every level: entries merge only when the SHA-256 digest, the length in bytes and a second,
independent 64-bit hash agree.

Defined results: null text counts as empty; empty texts equal each other; a null id is lower than any id; of rows that
tie in id and text exactly one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checkpointed, lower_ascii

KEY = ["digest", "n_bytes", "check"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: id, digests of the normalised text, the row's tag and the run it belongs to."""
    text = lower_ascii(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), text.alias("t")).select(
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64(F.lit("second"), "t").alias("check"),
        F.monotonically_increasing_id().alias("tag"),
        F.spark_partition_id().alias("run"),
    )
    return checkpointed(rows)


def merge_runs(rows: DataFrame, runs: int, fan_in: int, keep: str) -> DataFrame:
    """Digests with their best row and count, from runs numbered from 0 to runs - 1."""
    best = F.max if keep == "max" else F.min
    level = rows.select("run", *KEY, F.struct("id", "tag").alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        level = level.groupBy("run", *KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))
        if runs == 1:
            return level.drop("run")
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int") if runs > 1 else F.lit(0))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "max", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. `keep` says which id of a group stays."""
    rows = digest_rows(docs, id_col, text_col)
    groups = merge_runs(rows, max(rows.rdd.getNumPartitions(), 1), fan_in, keep)
    # a hot digest makes a skewed side here, which adaptive execution splits: nothing above needs a key's rows together
    return rows.join(groups, KEY).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("tag") == F.col("best.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
