"""Quality rules: fixed rules on counts, then gradient-boosted trees over document statistics.

Statistics are taken of the whole text. The fixed rules ask for enough words and few repeated ones; what passes them is
judged by boosted regression trees on the logistic loss. A tree splits at quantiles of the training rows; splits on a
statistic with a constraint must not raise the score as the statistic grows (or not lower it), which bounds handed down to both
sides keep true for the whole tree. For scoring, all trees are flattened into arrays of nodes (statistic, threshold, left,
right, value), and a batch of documents walks all of them at once, a level a step.

Only the fit sees a bounded sample: at most `train_docs` labelled documents, the first by a hash of their id, none of those held
out (crc32 of the id mod 5 is 0). Counts and scores take every document, in one pass without a shuffle.

Defined results: a null or empty text has no words and fails the rules; blank lines are no lines here; repeated rows get equal
results; duplicate labels count once and null ones not at all; without labels of both kinds the trees have nothing to learn,
and what passes the fixed rules is kept; an empty table gives an empty result; other columns are kept, those with the names
of the results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .quality import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The statistics that trees see, and whether a larger value may only lower (-1) or only raise (1) the score.
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "repeated_lines": -1, "repeated_words": -1, "shouted_words": -1,
    "double_marks": -1, "distinct_words": 0, "words_a_line": 0, "ended_lines": 1, "digits": 0, "longest_word": -1,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words inside windows of `size` words that stand twice or more, the first time included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    code = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    window = code[:n]
    for k in range(1, size):  # numbered anew at each step, so products stay under the square of the words
        window = np.unique(window, return_inverse=True)[1] * len(codes) + code[k : n + k]
    _, place, times = np.unique(window, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(times[place] > 1)
    edges[:n] += np.bincount(again, minlength=n)
    edges[size : n + size] -= np.bincount(again, minlength=n)
    return int((edges.cumsum()[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[float, ...]:
    """COUNTS, then STATISTICS, of a whole text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    n, chars = len(words), sum(map(len, words))
    symbols, repeated = sum(map(text.count, SYMBOLS)), repeated_words(words)
    counts = (n, chars, symbols, len(lines) - len(set(lines)), repeated)
    if not n:
        return (*counts, *[0.0] * len(STATISTICS))
    shouted = sum(len(w) > 1 and w.isupper() for w in words)
    ended = sum(x.rstrip(BLANK)[-1] in ".!?:;\"')]" for x in lines)
    digits = sum(map(text.count, "0123456789"))
    return (
        *counts, log1p(n), min(chars / n, 50.0), symbols / chars, counts[3] / len(lines), repeated / n, shouted / n,
        text.count("!!") / n, len(set(words)) / n, log1p(n / len(lines)), ended / len(lines), digits / chars, log1p(max(map(len, words))),
    )


@dataclass
class Forest:
    """Nodes of all trees: a leaf has itself on both sides."""

    roots: np.ndarray
    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher where label 1 is likelier; bounded blocks of documents walk all trees at once."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x) if len(self.roots) else 0, 4096):
            rows = np.arange(at, min(at + 4096, len(x)))[:, None]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(x[rows, self.statistic[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[rows[:, 0]] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


@dataclass
class Nodes:
    statistic: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        at = len(self.value)
        for column, x in zip((self.statistic, self.threshold, self.left, self.right, self.value), (0, 0.0, at, at, value), strict=True):
            column.append(x)
        return at


def fit_forest(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least_rows: int = 10, ridge: float = 1.0,
) -> Forest:
    """Boosting by Newton steps on the logistic loss; signs[j] constrains statistic j."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T] if len(x) else []
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, len(signs)), np.int64)
    share = float(y.mean()) if len(y) else 1.0
    base = float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 if share == 1 else -30.0
    nodes, roots = Nodes(), []
    margin = np.full(len(y), base)

    def step(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + ridge), low), high)

    def gain(g: float, h: float, v: float) -> float:
        return -(g * v + 0.5 * (h + ridge) * v * v)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = step(total_g, total_h, low, high)
        at = nodes.leaf(rate * own)
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(x.shape[1] if level < depth else 0):
            k = len(cuts[j]) + 1
            of = binned[rows, j]
            ns, gs, hs = (np.bincount(of, w, k).cumsum() for w in (None, g[rows], h[rows]))
            for b in range(k - 1):
                if ns[b] < least_rows or ns[-1] - ns[b] < least_rows:
                    continue
                a, c = step(gs[b], hs[b], low, high), step(total_g - gs[b], total_h - hs[b], low, high)
                if (c - a) * signs[j] < 0:
                    continue
                won = gain(gs[b], hs[b], a) + gain(total_g - gs[b], total_h - hs[b], c) - gain(total_g, total_h, own)
                if won > best[0]:
                    best = (won, j, b, a, c)
        _, j, b, a, c = best
        if j >= 0:
            inside = binned[rows, j] <= b
            middle = (a + c) / 2
            sides = ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle)) if signs[j] < 0 else ((low, high), (low, high))
            nodes.statistic[at], nodes.threshold[at] = j, float(cuts[j][b])
            nodes.left[at] = grow(rows[inside], g, h, *sides[0], level + 1)
            nodes.right[at] = grow(rows[~inside], g, h, *sides[1], level + 1)
        return at

    for _ in range(trees if 0 < share < 1 and len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        root = grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0)
        roots.append(root)
        now = Forest(*(np.array(a) for a in ([root], nodes.statistic, nodes.threshold, nodes.left, nodes.right, nodes.value)), depth, 0.0)
        p = now.scores(x)
        margin = margin + np.log(p / (1 - p))
    return Forest(*(np.array(a) for a in (np.array(roots, np.int64), np.array(nodes.statistic, np.int64), nodes.threshold, np.array(nodes.left, np.int64), np.array(nodes.right, np.int64), nodes.value)), depth, base)


def with_statistics(docs: DataFrame, *, text_col: str = "text", out: str = "statistics") -> DataFrame:
    @pandas_udf("array<double>")
    def taken(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(statistics(t)) for t in texts], dtype=object)

    return docs.withColumn(out, taken(docs[text_col]))


def train(docs: DataFrame, labels: DataFrame, *, train_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **limits: float) -> Forest:
    """The trees, from at most `train_docs` labelled documents that aren't held out."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(chosen), "_id")  # train_docs rows at most
    taken = with_statistics(rows, text_col="_text", out="_found").select("_id", "_label", "_found").groupBy("_id", "_label").agg(F.min("_found").alias("_found"))
    got = taken.orderBy("_id").collect()
    x = np.array([r["_found"][len(COUNTS) :] for r in got], np.float64).reshape(-1, len(STATISTICS))
    return fit_forest(x, np.array([r["_label"] for r in got], np.float64), np.array(list(STATISTICS.values())), **limits)


def judge(
    docs: DataFrame, forest: Forest, *, text_col: str = "text", min_words: int = 50, max_repeated: int = 50, threshold: float = 0.3,
) -> DataFrame:
    """The documents, all columns, with COUNTS, quality_score, base_failed (fewer than `min_words` words, or more than
    `max_repeated` hundredths of them repeated) and kept (neither failed nor scored under `threshold`)."""

    @pandas_udf("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,quality_score:double>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        found = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(COUNTS) + len(STATISTICS))
        made = pd.DataFrame(found[:, : len(COUNTS)].astype(np.int64), columns=COUNTS)
        return made.assign(quality_score=forest.scores(found[:, len(COUNTS) :]))

    results = [*COUNTS, "quality_score"]
    with_all = docs.drop(*(c for c in [*results, "base_failed", "kept"] if c != text_col)).withColumn("_judged", judged.asNondeterministic()(F.col(text_col)))
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeated) * F.col("n_words"))
    return with_all.withColumns({c: F.col(f"_judged.{c}") for c in results}).drop("_judged").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= threshold))
