"""Whitening, quality rules and hard negatives against brute force, and their edge cases."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import negatives, quality_rules, queries, whitening

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int"


def vectors_of(df):
    return {r["vec_id"]: r["embedding"] for r in df.collect()}


# --- whitening


def brute_deviations(rows):
    """Exact, in Python's whole numbers."""
    x = {k: [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for k, v in rows.items()}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    return {k: sum((len(x) * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in x.items()}, x


def test_whitening_of_the_table(spark):
    rows = vectors_of(spark.read.parquet(f"{SF}/embeddings.parquet"))
    got = queries.op11_whitening(spark, SF).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want, x = brute_deviations(rows)
    assert len(got) == 32 * len(rows) and set(got.n) == {len(rows)}
    assert all(want[k] == d for k, d in zip(got.vec_id, got.deviation, strict=True))
    m = np.array([x[k] for k in sorted(x)], np.float64)
    m -= m.mean(axis=0)
    values, vectors = np.linalg.eigh(m.T @ m / len(m))
    values, vectors = values[::-1], vectors[:, ::-1]
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    mine = m @ vectors[:, :32] / np.sqrt(values[:32])
    signs = np.sign((wide * mine).sum(axis=0))
    assert np.allclose(wide * signs, mine, atol=1e-7)
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, values[:32] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-8
    assert abs(np.abs(wide.T @ wide / len(wide) - np.eye(32)).max() - got.identity_error[0]) < 1e-9


def test_whitening_edges(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=4).tolist(), 1) for i in range(50)]
    odd = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [1.0, float("nan"), 0.0, 0.0], 1), (103, [float("inf"), 0.0, 0.0, 0.0], 1), (104, [], 1), (105, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + [rows[0], (None, rows[1][1], None)] + odd, ROWS).selectExpr("*", "'x' as deviation", "1 as place")
    model = whitening.fit(df, components=3)
    got = whitening.whiten(df, model).collect()
    assert model.n == len(got) == 52 and {r["vec_id"] for r in got} == {*range(50), None} and got[0]["place"] == 1
    w = np.array([r["whitened"] for r in got])
    assert np.abs(w.T @ w / len(w) - np.eye(3)).max() < 1e-9 > model.identity_error
    same = [r for r in got if r["vec_id"] == 0]
    assert len(same) == 2 and same[0] == same[1]
    # equal vectors have no component; fewer rows than entries have fewer
    equal = df.where("vec_id = 1")
    assert whitening.whiten(equal, whitening.fit(equal)).collect()[0]["whitened"] == []
    three = spark.createDataFrame(rows[:3], ROWS)
    assert len(whitening.fit(three).variances) == 2 and whitening.fit(three).identity_error < 1e-6
    empty = df.limit(0)
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0
    assert whitening.whiten(df.where("vec_id > 99"), whitening.fit(df.where("vec_id in (100, 104)"))).count() == 0


@pytest.mark.parametrize("scale", [1.0, 2.0**20, 2.0**40])
def test_deviations_are_exact_at_any_size(spark, scale):
    random = np.random.default_rng(4)
    rows = [(i, (random.normal(size=5) * 8).tolist(), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    model = whitening.fit(df, scale=64 * scale)
    x = [[int(np.floor(64 * scale * c)) + 1_000_000 for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((40 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, model).collect()} == want


def test_large_offsets_cancel():
    """The mean is exact, so vectors that differ in their last digits are centred without loss."""
    x = np.array([[2**60 + 1], [2**60 + 2], [2**60 + 6]])
    assert whitening.column_sums(x)[0] == 3 * 2**60 + 9
    assert whitening.column_sums(-x)[0] == -3 * 2**60 - 9


# --- quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_rules_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["quality_score"] >= 0.3)


def test_trees_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [r for r in queries.op12_quality_rules(spark, sf).join(labels, "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    judged = [r for r in rows if not r["base_failed"]]
    assert len(judged) > 40 and np.mean([(r["quality_score"] >= 0.5) == r["quality"] for r in judged]) > 0.95
    good, bad = ([r["quality_score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97  # area under the curve
    assert all(r["kept"] for r in judged if r["quality"])


def test_statistics_edges():
    for text in ("", None, " \n\t\n", "a", "a b", "a a a", "a a a a", "x\ny\nx\n x", "\x1c\x85 \xa0a b", "a b c a b c d a b", "\n\n", "### ###\n### ###"):
        assert quality_rules.statistics(text)[:5] == brute_counts(text), text
    long = "word " * 300_000 + "other"
    assert quality_rules.statistics(long)[:5] == (300_001, 1_200_005, 0, 0, 300_000)
    random = np.random.default_rng(2)
    for _ in range(50):
        text = " ".join(random.choice(list("abc"), random.integers(0, 30)))
        assert quality_rules.statistics(text)[:5] == brute_counts(text), text


def one_by_one(forest, x):
    total = Fraction(0) + Fraction(forest.base)
    for node in forest.roots.tolist():
        while forest.left[node] != node:
            node = (forest.left if x[forest.statistic[node]] <= forest.threshold[node] else forest.right)[node]
        total += Fraction(float(forest.value[node]))
    return 1 / (1 + np.exp(-float(total)))


def test_flattened_trees_and_constraints():
    random = np.random.default_rng(5)
    x = random.normal(size=(3000, 4))
    signs = np.array([1, -1, 0, 0])
    y = (x[:, 0] - x[:, 1] + np.sin(3 * x[:, 2]) + random.normal(size=3000) * 0.8 > 0).astype(float)
    forest = quality_rules.fit_forest(x, y, signs, trees=40)
    scores = forest.scores(x)
    assert np.mean((scores > 0.5) == y) > 0.8 and len(forest.roots) == 40
    assert np.allclose(scores[:100], [one_by_one(forest, r) for r in x[:100]])
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(random.normal(size=(50, 1, 4)), 60, axis=1)
        grid[:, :, j] = np.linspace(-3, 3, 60)
        moved = np.diff(forest.scores(grid.reshape(-1, 4)).reshape(50, 60), axis=1) * sign
        assert (moved >= -1e-12).all() and (moved > 1e-3).any()
    free = quality_rules.fit_forest(x, y, np.zeros(4), trees=40)
    grid = np.repeat(random.normal(size=(50, 1, 4)), 60, axis=1)
    grid[:, :, 0] = np.linspace(-3, 3, 60)
    assert (np.diff(free.scores(grid.reshape(-1, 4)).reshape(50, 60), axis=1) < -1e-6).any()  # so the constraint does something


def test_rules_edges(spark):
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, long), (4, clean), (4, clean), (None, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_words", "1 as _judged_", "2 as statistics")
    none = spark.createDataFrame([(4, None), (3, None)], "doc_id long, quality int")
    forest = quality_rules.train(docs, none)
    assert len(forest.roots) == 0
    got = quality_rules.judge(docs, forest).collect()
    assert [(r["base_failed"], r["kept"]) for r in got] == [(True, False), (True, False), (True, False), *[(False, True)] * 3]
    assert got[0]["statistics"] == 2 and got[3]["n_words"] == 60
    assert quality_rules.judge(docs.limit(0), forest).count() == 0
    assert quality_rules.train(docs.limit(0), none.limit(0)).scores(np.zeros((1, 12)))[0] > 0.5
    two = spark.createDataFrame([(4, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    assert quality_rules.judge(docs, quality_rules.train(docs, two)).count() == 6


# --- hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives_=10):
    known = [(i, label, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v, label in rows if None not in (i, v, label) and None not in v and np.isfinite(v).all()]
    out = set()
    for a, label, v in {(i, lab, tuple(v)) for i, lab, v in known if is_anchor(i)}:
        score = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, lab) for i, lab, w in known if i != a]
        for p, (s, i, _) in enumerate(sorted(x for x in score if x[2] == label)[:positives]):
            fits = sorted(x for x in score if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives_]
            out |= {(a, i, k + 1, n, -s, -t, p) for k, (t, n, _) in enumerate(fits)}
    return sorted(x[:6] for x in out)


@pytest.mark.parametrize("limits", [{}, {"buckets": 2}, {"buckets": 7, "anchor_rows": 2}])
def test_negatives_equal_brute_force(spark, limits):
    """Many ties, copies and a hot label; whatever the digits and blocks."""
    random = np.random.default_rng(6)
    base = random.normal(size=(30, 4)) / 2
    rows = [(i, [float(np.float32(x)) for x in base[i % 30 if i % 3 else 0]], int(random.choice([0, 0, 0, 1, 2]))) for i in range(400)]
    rows += [(900, None, 1), (901, [1.0, None, 0.0, 0.0], 1), (902, [float("nan")] * 4, 0), (903, [0.0] * 4, None), (None, [0.5] * 4, 0), (910, [0.0] * 4, 0)]
    df = spark.createDataFrame(rows, ROWS).repartition(5).selectExpr("*", "'x' as id", "1 as vector", "2 as rank", "3 as layer", "4 as anchor")
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 70 == 0, **limits).collect())
    assert got == brute_negatives(rows, lambda i: i % 70 == 0) and len(got) > 100


def test_scores_beyond_exact_doubles(spark):
    random = np.random.default_rng(7)
    rows = [(i, (random.normal(size=3) * 2.0**19).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute_negatives(rows, lambda i: i % 20 == 0) and max(r[4] for r in got) > 2**53


def test_negatives_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (100, [0.0, 1.0], 5), (3, [1.0], 1)]
    df = spark.createDataFrame(rows, ROWS)
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    # the repeated anchor is one; each repeated positive has a window, in which each repeated negative counts
    assert got == sorted((0, 1, k, 2, 65536, 32768) for k in (1, 2) for _ in range(2))
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df, F.col("vec_id") == 77).count() == 0
    assert negatives.mine(df.where("vec_id = 100"), F.col("vec_id") == 100).count() == 0
