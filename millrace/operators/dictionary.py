"""Names of a table found in texts by an automaton.

The distinct names are dealt into blocks of a bounded number of names and characters; each block is collected, broadcast and made
into an Aho-Corasick automaton once in each Python worker. A text is read once for each block, from left to right,
however many and however long the names are, and rows come out for the names that stand in it and for nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Automata that a worker keeps.
KEPT = 4


@lru_cache(KEPT)
def _automaton(token: str, names: Any) -> Any:
    """By the token of a block; `names` is a broadcast list."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, name in enumerate(names.value):
        made.add_word(name, (i, len(name)))
    made.make_automaton()
    return made


class _Names:
    """A broadcast list that counts as equal to any other, so that only the token tells automata apart."""

    def __init__(self, broadcast: Any) -> None:
        self.broadcast = broadcast

    @property
    def value(self) -> list[str]:
        return self.broadcast.value

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Names)


def occurrences(texts: DataFrame, names: DataFrame, *, text: str, name: str, longest_only: bool = False, block_names: int = 100_000, block_chars: int = 8_000_000) -> DataFrame:
    """The columns of `texts` but the text, with `name` and `place` (from 0, of its first occurrence) for each distinct name that
    stands in the text; with `longest_only` those of the greatest length among a block's. Null and empty names and texts
    give nothing; repeated texts count each."""
    spark = texts.sparkSession
    distinct = names.select(F.col(name).cast("string").alias("name")).where("name <> ''").distinct().persist()
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars")).first()
    others = [c for c in texts.columns if c != text]
    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{name}` string", "place int"])
    rows = texts.where(F.col(text) != "")
    blocks = max(-(-size["n"] // block_names), -(-size["chars"] // block_chars))
    found = []
    for block in range(blocks):
        part = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)
        listed = sorted(r["name"] for r in part.collect())  # a block's names: about block_names and block_chars at most
        token, held = uuid.uuid4().hex, _Names(spark.sparkContext.broadcast(listed))

        def match(batches: Iterator[pa.RecordBatch], token: str = token, held: _Names = held) -> Iterator[pa.RecordBatch]:
            automaton, words = _automaton(token, held), held.value
            for batch in batches:
                at, which, places = [], [], []
                for i, body in enumerate(batch.column(text).to_pylist()):
                    first: dict[int, int] = {}
                    for end, (n, length) in automaton.iter(body):
                        first.setdefault(n, end - length + 1)
                    if first and longest_only:
                        most = max(len(words[n]) for n in first)
                        first = {n: p for n, p in first.items() if len(words[n]) == most}
                    at += [i] * len(first)
                    which += [words[n] for n in first]
                    places += first.values()
                kept = batch.select(others).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(which, pa.string()), pa.array(places, pa.int32())], names=[*others, name, "place"])

        if listed:
            found.append(rows.mapInArrow(match, schema))
    distinct.unpersist()
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
