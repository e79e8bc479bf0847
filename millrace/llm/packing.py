"""Best-fit packing of token sequences in bulk-synchronous rounds.

A document is its token ids and the end id. Only documents longer than a sequence are cut: into pieces of the full
length, of which the first may be shorter. Pieces are numbered in their length once (rank), by a distributed numbering.

A round is a sweep over pieces and gaps, both sorted from large to small: every piece takes its successor, the smallest
gap that fits and that no longer piece, or piece of better rank, has taken. In the sorted order gaps open and pieces
close like brackets, so a running depth tells which gap each piece gets: gap and piece meet at the same depth, next to
each other. A sorted order of whole numbers up to `tokens` needs only counts to be walked, so the depth at which each
size begins comes from a histogram (at most `tokens` sizes, on the driver), each row's own depth from its rank in its
size, and the meeting of rows from one shuffle by depth, in which a depth has at most two rows a size: no conflict is
left, and no key is hot. A gap that several of the longest pieces would fit is offered in as many slots. Then the gaps
are updated. Where the gaps can't hold most of the longest pieces that are left (those of which equally many fit into a
sequence), these open sequences of their own, in order. Rounds repeat until no piece is left; each writes its outcome and
the gaps down, so a lost executor costs a round at most. Pieces meet their sequence by (length, rank) at the end.

Defined results: null text counts as empty, which is one token; ties in length are ranked by id and piece; repeated rows
are packed each; an empty table gives an empty result; other columns are ignored. The ids are those of the tokenizers
library, a text's literal <|endoftext|> being that token.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import checkpointed, gapless_rank

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of white space that tiktoken's matcher, which backs up over them, may not have the stack for.
LONG_RUN = 50_000
RUN = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library for the same file.

    The vocabulary file is the tokenizers library's; its merges are run by tiktoken, which takes a fraction of the time
    and hands over arrays instead of lists.
    Texts that hold an added token literally, or a run of over LONG_RUN white-space characters, are encoded by the library
    itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content.get("added_tokens", [])}
        self.path, self.special = path, special
        ranks = {bytes(letters[c] for c in token): n for token, n in content["model"]["vocab"].items() if token not in special}
        self.model = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self) -> Any:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special) or len(text) >= LONG_RUN and RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.model.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which lasts from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, *, tokens: int = 2048, end_id: int = 0, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocabulary_path or vocabulary()), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                rows = []
                for doc, text in zip(part["id"].tolist(), part["t"].tolist(), strict=True):
                    ids = encode(text or "") + end
                    size = len(ids) // 4
                    first = (size - 1) % tokens + 1
                    for k, start in enumerate([0, *range(first, size, tokens)]):
                        stop = first if k == 0 else start + tokens
                        rows.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"]).astype({"id": "Int64"})

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("t")).mapInPandas(cut, PIECES)


def slots_of(gap: int, longest: int, most: int) -> int:
    """Slots a gap is offered in: as many as the longest piece left fits, `most` at most, and one at least."""
    return max(1, min(gap // longest, most))


def plan_sweep(gaps: dict[int, int], left: dict[int, int]) -> tuple[int, dict[int, int], dict[int, tuple[int, int]], Counter[int]]:
    """Of a sweep over gaps and pieces by size: slots a gap at most, depth before the slots of a size, for each length with
    a match the depth before its pieces and how many are matched, and what is left of the slots, by size. Sizes go from
    large to small, slots first."""
    longest, pieces = max(left), sum(left.values())
    most = max(1, -(-2 * pieces // max(sum(gaps.values()), 1)))
    slots: Counter[int] = Counter()
    for gap, n in gaps.items():
        m = slots_of(gap, longest, most)
        slots[longest] += n * (m - 1)
        slots[gap - (m - 1) * longest] += n
    depth, opens, closes, rest = 0, {}, {}, Counter()
    open_: list[tuple[int, int]] = []
    for size in sorted(slots.keys() | left.keys(), reverse=True):
        if slots[size]:
            opens[size] = depth
            depth += slots[size]
            open_.append((size, slots[size]))
        if matched := min(left.get(size, 0), depth):
            closes[size] = (depth, matched)
            depth -= matched
        while matched:
            slot, n = open_.pop()
            if n > matched:
                open_.append((slot, n - matched))
            rest[slot - size] += min(n, matched)
            matched -= min(n, matched)
    for size, n in open_:
        rest[size] += n
    return most, opens, closes, rest


def plan_opening(gaps: dict[int, int], left: dict[int, int], tokens: int) -> tuple[int, dict[int, int]]:
    """Pieces a sequence, and how many of each length open sequences; none where gaps hold over an eighth of the longest.

    The longest are those of which equally many fit into a sequence, or with over 7/8 of the longest's length where that
    is eight and more.
    """
    longest = max(left)
    each = tokens // longest
    least = tokens // (each + 1) if each < 8 else longest * 7 // 8
    longest_ones = sorted((n for n in left if n > least), reverse=True)
    total = sum(left[n] for n in longest_ones)
    count = total - sum(n * (gap // longest) for gap, n in gaps.items())
    opening: dict[int, int] = {}
    if count * 8 >= total * 7:
        for length in longest_ones:
            if count > 0:
                opening[length] = min(left[length], count)
                count -= opening[length]
    return each, opening


def small(spark: SparkSession, rows: list[tuple[int, ...]], columns: list[str]) -> DataFrame:
    """A local table of whole numbers, of at most `tokens` rows wherever it is used here."""
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(columns)}))


def units(spark: SparkSession, runs: list[tuple[int, int, int, int]], step: int = 1, chunk: int = 65_536) -> DataFrame:
    """One row per piece of runs (length, first rank, first place, how many): length, rank, place."""
    table = small(spark, runs, ["length", "first", "at", "n"])
    cut = table.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))))
    spread = cut.repartition("length", "i") if sum(r[3] for r in runs) > chunk else cut.coalesce(1)
    one = spread.withColumn("j", F.explode(F.sequence(F.col("i"), F.least(F.col("i") + chunk, F.col("n")) - 1)))
    return one.select("length", (F.col("first") + F.col("j")).alias("rank"), (F.col("at") + step * F.col("j")).alias("place"))


def sweep(gaps: DataFrame, slots: int, longest: int, most: int, opens: dict[int, int], closes: dict[int, tuple[int, int]], taken: dict[int, int], rows_per_split: int) -> DataFrame:
    """The pieces (length, rank) that find a gap in this round, with its sequence."""
    spark = gaps.sparkSession
    m = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / longest), F.lit(most))).cast("int")
    offered = gaps.withColumn("m", m).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("m"))))
    offered = offered.select("sequence", "slot", F.when(F.col("slot") < F.col("m"), longest).otherwise(F.col("gap") - (F.col("m") - 1) * longest).cast("long").alias("size"))
    split = -(-slots // rows_per_split)
    if split > 1:
        ranked = gapless_rank(offered, ["size"], ["sequence", "slot"], "r", split)
    else:
        ranked = offered.withColumn("r", F.row_number().over(Window.partitionBy("size").orderBy("sequence", "slot")) - 1)
    first = small(spark, list(opens.items()), ["size", "first"])
    opening = ranked.join(F.broadcast(first), "size").select((F.col("first") + F.col("r")).alias("depth"), (-2 * F.col("size")).alias("at"), "sequence", F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("rank"))
    # the depth falls by one from piece to piece
    runs = [(n, taken[n], d, k) for n, (d, k) in closes.items()]
    closing = units(spark, runs, step=-1).select((F.col("place") - 1).alias("depth"), (-2 * F.col("length") + 1).alias("at"), F.lit(None).cast("long").alias("sequence"), "length", "rank")
    by_depth = Window.partitionBy("depth").orderBy("at")
    met = opening.union(closing).withColumn("sequence", F.coalesce("sequence", F.lag("sequence").over(by_depth)))
    return met.where("length is not null").select("length", "rank", "sequence")


def assign(spark: SparkSession, counts: dict[int, int], tokens: int, rows_per_split: int = 250_000) -> DataFrame:
    """length, rank, sequence of all pieces, from how many pieces each length has; one sweep and one opening a round."""
    left, taken = dict(counts), dict.fromkeys(counts, 0)
    gaps, sizes, opened, done = None, {}, 0, []

    def take(matched: dict[int, int]) -> None:
        for length, n in matched.items():
            taken[length] += n
            left[length] -= n
            if not left[length]:
                del left[length]

    while left:
        placed, fresh, rest = [], [], Counter()
        if sizes:
            longest = max(left)
            most, opens, closes, rest = plan_sweep(sizes, left)
            if closes:
                placed.append(sweep(gaps, sum(rest.values()), longest, most, opens, closes, taken, rows_per_split))
                take({n: k for n, (_, k) in closes.items()})
        each, opening = plan_opening(rest, left, tokens) if left else (1, {})
        if opening:
            at, runs = 0, []
            for length, n in sorted(opening.items(), reverse=True):
                runs.append((length, taken[length], at, n))
                at += n
            placed.append(units(spark, runs).select("length", "rank", (F.floor(F.col("place") / each) + opened).alias("sequence")))
            fresh.append(spark.range(opened, opened - (-at // each)).select(F.col("id").alias("sequence"), F.lit(tokens).cast("long").alias("gap")))
            opened += -(-at // each)
            take(opening)
        done.append(checkpointed(reduce(DataFrame.union, placed)))
        changes = done[-1].select("sequence", (-F.col("length")).alias("gap"))
        least = min(left, default=tokens + 1)
        gaps = checkpointed(reduce(DataFrame.union, [*([gaps] if gaps else []), *fresh, changes]).groupBy("sequence").agg(F.sum("gap").alias("gap")).where(F.col("gap") >= least))
        sizes = {r["gap"]: r["n"] for r in gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).collect()} if left else {}  # at most `tokens` rows
    return reduce(DataFrame.union, done)


def pack(parts: DataFrame, *, tokens: int = 2048, rows_per_split: int = 250_000) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    parts = checkpointed(parts)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `tokens` rows
    if not counts:
        return parts.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    split = max(8, -(-max(counts.values()) // rows_per_split))
    ranked = gapless_rank(parts, ["length"], ["id", "piece", "start", "ids_crc32"], "rank", split)
    placed = assign(parts.sparkSession, counts, tokens, rows_per_split).withColumnRenamed("sequence", "sequence_id")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)  # at most `tokens` rows
    joined = ranked.join(placed, ["length", "rank"]).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return joined.select(*parts.columns, "sequence_id", "offset")
