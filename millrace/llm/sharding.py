"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form an atomic group; groups are ordered by a 64-bit hash of the text. The shards are contiguous
runs of groups, cut so that the largest shard is as small as any cutting of this order allows: the capacity is found by
binary search, each candidate checked greedily, and the cuts are the greedy ones at the smallest feasible capacity.

The driver never sees the groups. It sees byte sums of hash ranges, 4096 at first; the search over these bounds the
capacity from above and below, which leaves a few ranges in which a cut can fall; only those are resolved into 1024
ranges each by one more aggregation, until every range near a cut is a single group. The last search is then exact.
Rows find their shard by comparing their hash with the cuts, and their slot by a distributed numbering.

Defined results: null text counts as empty, size 1; repeated rows share their group and have slots of their own; ties in
id are ordered by size and checksum; an empty table gives an empty result; other columns are ignored. A group larger
than an even share is never split, so it alone may set the capacity; shards may be empty then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import checkpointed, gapless_rank

#: A range of hashes (as unsigned offsets from the smallest signed number): first, bits of its width, bytes, groups.
Range = tuple[int, int, int, int]


def greedy_cuts(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Indexes at which a new shard begins when each takes as many as fit; None where `shards` don't suffice."""
    cuts, load = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if load + size > capacity:
            cuts.append(i)
            load = 0
            if len(cuts) == shards:
                return None
        load += size
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    low, high = max(-(-sum(sizes) // shards), max(sizes, default=0), 0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def unresolved(ranges: list[Range], shards: int) -> list[int]:
    """Indexes of the ranges of several groups in which a cut of the best partition may fall."""
    sizes = [r[2] for r in ranges]
    total, high = sum(sizes), smallest_capacity(sizes, shards)
    low = max(-(-total // shards), max((r[2] for r in ranges if r[3] == 1), default=0))
    first = last = 0
    found: set[int] = set()
    for _ in range(shards - 1):
        # the next cut is at or after where whole ranges fill the lower bound, at or before where parts of them pass the upper
        load = 0
        while first < len(sizes) and load + sizes[first] <= low:
            load += sizes[first]
            first += 1
        load = 0
        while last < len(sizes) and load <= high:
            load += sizes[last]
            last += 1
        found.update(range(first, min(last + 1, len(sizes))))
    return sorted(i for i in found if ranges[i][3] > 1 and ranges[i][1] > 0)


def find_cuts(groups: DataFrame, shards: int, *, first_bits: int = 12, next_bits: int = 10) -> list[int]:
    """Hashes (signed) at which shards 1, 2, ... begin. `groups` has h (signed 64-bit) and bytes, one row per group."""

    def ranges_of(df: DataFrame, width: int) -> list[Range]:
        at = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), width)
        rows = df.groupBy(at.alias("at")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        return [((r["at"] % 2 ** (64 - width)) << width, width, r["b"], r["n"]) for r in rows]

    ranges = sorted(ranges_of(groups, 64 - first_bits))
    while ranges and (open_ := unresolved(ranges, shards)):
        width = max(ranges[i][1] for i in open_)
        now = [i for i in open_ if ranges[i][1] == width]
        parent = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), width)
        wanted = [r - 2 ** 64 if r >= 2**63 else r for r in (ranges[i][0] >> width for i in now)]
        parts = ranges_of(groups.where(parent.isin(wanted)), max(0, width - next_bits))
        ranges = sorted([r for i, r in enumerate(ranges) if i not in set(now)] + parts)
    sizes = [r[2] for r in ranges]
    cuts = greedy_cuts(sizes, shards, smallest_capacity(sizes, shards)) or []
    return [ranges[i][0] - 2**63 for i in cuts]


def shard_of(hash_col: Column, cuts: list[int]) -> Column:
    return sum(((hash_col >= F.lit(c)).cast("int") for c in cuts), F.lit(0))


def shard_documents(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_split: int = 250_000) -> DataFrame:
    """Per input row: id, size (bytes + 1), text_crc32, shard, slot (gapless from 0 in its shard)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = checkpointed(docs.select(docs[id_col].alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    groups = checkpointed(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    placed = rows.withColumn("shard", shard_of(F.col("h"), find_cuts(groups, shards)))
    split = max(16, -(-rows.count() // rows_per_split))
    return gapless_rank(placed, ["shard"], ["id", "size", "text_crc32"], "slot", split).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
