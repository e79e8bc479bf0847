"""Functions over array columns: vectors, set scores, folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed query, whose norm is computed once; null for a zero vector."""
    norm = math.sqrt(sum(x * x for x in query))
    products = F.zip_with(vector, F.array(*map(F.lit, query)), lambda a, b: a.cast("double") * b)
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, own * F.lit(norm))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, 0.0).otherwise(part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def recall(expected: Column, found: Column) -> Column:
    return ratio(F.size(F.array_intersect(F.array_distinct(expected), found)), F.size(F.array_distinct(expected)))


def ordered_merge(*lists: Column) -> Column:
    """Concatenation in which the first occurrence of a value stays."""
    return F.array_distinct(F.concat(*lists))


def left_out(known: Column, *others: Column) -> Column:
    """The values that are in none of the other lists, sorted, each once."""
    out = known
    for other in others:
        out = F.array_except(out, other)
    return F.sort_array(F.array_distinct(out))


def budgeted(parts: Column, budget: int) -> Column:
    """Parts (structs with `cost`) that are taken in order while the total stays within the budget.

    A part that is too large is skipped and doesn't stop later ones.
    """
    kind = F.filter(parts, lambda x: F.lit(False))
    start = F.struct(F.lit(0).cast("long").alias("used"), kind.alias("kept"))

    def add(state: Column, part: Column) -> Column:
        fits = state["used"] + part["cost"] <= budget
        return F.struct(F.when(fits, state["used"] + part["cost"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(part))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(parts, start, add, lambda s: s["kept"])


def _field(key: str) -> Callable[[Column], Column]:
    return lambda row: row[key]


def _equals(value: Column) -> Callable[[Column], Column]:
    return lambda x: x == value


def joint_caps(rows: Column, caps: dict[str, int]) -> Column:
    """Greedy diversity over an ordered array of structs: a row is taken if no cap is reached for its keys.

    Caps hold together, a row that is dropped uses none of them, and blank keys are not capped.
    """
    empty = F.filter(rows, lambda x: F.lit(False))

    def add(kept: Column, row: Column) -> Column:
        full = F.lit(False)
        for key, most in caps.items():
            same = F.size(F.filter(F.transform(kept, _field(key)), _equals(row[key])))
            full = full | ((F.coalesce(row[key], F.lit("")) != "") & (same >= most))
        return F.when(full, kept).otherwise(F.concat(kept, F.array(row)))

    return F.aggregate(rows, empty, add)
