"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are counts and shares of its own text, the same of its neighbours before and
after (differences to them included), and its place. The field is fitted by gradient steps on the exact log-likelihood of
labelled documents, whose lines all take the document's label; forward-backward gives each line's marginal, and the
length-weighted mean of the marginals, put through a one-variable logistic fit on the same training documents, is the
document's score.

As every line of a document takes its label, pairs of unlike lines are never seen, and moves between good and bad would be
forbidden; their weights are kept within 1 (a factor of e), so that a line is smoothed by its neighbours and not ruled.

Only the fit sees a bounded sample: `train_docs` labelled documents of at most `train_lines` lines, the first by a hash
of their id. Scoring reads every whole text, in one pass without a shuffle.

Defined results: a null or empty text is one empty line and gets a score like any other; blank lines are lines; repeated
rows get equal scores; duplicate or null labels count once or not at all; an empty table gives an empty result; without
labels of both kinds nothing can be learned and every text scores 0.5; other columns are kept. Of a text of many lines only a
block of them is held as features at a time, besides two numbers a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: What a question mark is written as before encoding, which makes ? of all characters beyond Latin-1.
QUESTION = "\x01"
#: Kinds of Latin-1 characters: lower (also all beyond Latin-1), upper, digit, white space, sentence mark, symbol.
KINDS = bytes(0 if c.islower() or c == "?" else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in f".,;:'\"{QUESTION}" else 5 for c in map(chr, range(256)))
FEATURES = 16
RUNS = ("***", "###", "$$$", "%%%", "&&&", "...", "---", "===", "~~~")
ENDS = frozenset(".!?:;\"')]")
SPLIT = re.compile(r"\n")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Own features (lines x FEATURES) and the lines' lengths in characters, 1 at least."""
    return features_of(SPLIT.split(text or ""))


def line_blocks(text: str, size: int) -> Iterator[list[str]]:
    """The lines, at most `size` at a time; the text isn't cut as a whole."""
    block, at = [], 0
    while (end := text.find("\n", at)) >= 0:
        block.append(text[at:end])
        at = end + 1
        if len(block) == size:
            yield block
            block = []
    yield [*block, text[at:]]


def features_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for line in lines:
        n = len(line)
        words = line.split()
        k = len(words)
        if not k:
            out.append((log1p(n) / 8, *[0.0] * (FEATURES - 2), 1.0))
            continue
        kinds = line.replace("?", QUESTION).encode("latin-1", "replace").translate(KINDS)
        lower, upper, digit, space, mark, symbol = map(kinds.count, (b"\0", b"\1", b"\2", b"\3", b"\4", b"\5"))
        runs = sum(map(line.count, RUNS))
        out.append((
            log1p(n) / 8, upper / max(lower + upper, 1), digit / n, space / n, symbol / n, mark / n, log1p(k) / 8, len(set(words)) / k,
            sum(map(eq, words, words[2:])) / k, min(n / k, 20) / 20, sum(map(eq, words, words[1:])) / k, line.count("|") / k, line.count("!!") / k, runs / k, line[-1] in ENDS, 0.0,
        ))
    return np.array(out, np.float32), np.array([max(len(x), 1) for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, the distances to them, place and a constant."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    place = np.zeros((n, 4), own.dtype)
    place[0, 0], place[-1, 1], place[:, 2], place[:, 3] = 1, 1, 1 / n, 1
    return np.hstack([own, own**2, before, after, np.abs(own - before), np.abs(own - after), place])


@dataclass
class Field:
    weights: np.ndarray  # a line's evidence for good
    moves: np.ndarray  # 2 x 2
    scale: float = 1.0
    shift: float = 0.0


def _batch(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all documents, and for each its place as (documents x longest), -1 where it has ended."""
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes) - sizes
    steps = np.arange(sizes.max())
    return np.vstack(docs), np.where(steps < sizes[:, None], starts[:, None] + steps, -1)


def marginals(evidence: np.ndarray, at: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many documents at once: P(good) per line, log-partition per document, summed pair counts."""
    docs, longest = at.shape
    live = at >= 0
    node = np.zeros((docs, longest, 2))
    node[..., 1] = np.where(live, evidence[np.maximum(at, 0)], 0)
    forward, backward = np.zeros_like(node), np.zeros_like(node)
    forward[:, 0] = node[:, 0]
    for t in range(1, longest):
        x = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1]) + node[:, t]
        forward[:, t] = np.where(live[:, t, None], x, forward[:, t - 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    for t in range(longest - 2, -1, -1):
        y = node[:, t + 1] + backward[:, t + 1]
        x = np.logaddexp(moves[:, 0] + y[:, 0, None], moves[:, 1] + y[:, 1, None])
        backward[:, t] = np.where(live[:, t + 1, None], x, 0)
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            p = forward[:, :-1, a] + moves[a, b] + node[:, 1:, b] + backward[:, 1:, b] - total[:, None]
            pairs[a, b] = np.exp(p[live[:, 1:]]).sum()
    good = np.exp(np.minimum(forward[..., 1] + backward[..., 1] - total[:, None], 0))
    flat = np.zeros(len(evidence))
    flat[at[live]] = good[live]
    return flat, total, pairs


def long_marginals(evidence: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of each line of one long chain. The chain is cut into about as many blocks as a block has steps: what a block
    does to the message from either state is worked out for all blocks at once, then the messages into the blocks one by
    one, then those inside, again for all blocks at once."""
    steps = len(evidence) - 1
    length = max(1, int(np.ceil(np.sqrt(steps))))
    blocks = max(1, -(-steps // length))
    node = np.zeros((length, blocks, 2))
    padded = np.zeros(blocks * length)
    padded[:steps] = evidence[1:]
    node[..., 1] = padded.reshape(blocks, length).T
    live = (np.arange(blocks * length) < steps).reshape(blocks, length).T[..., None]

    def onward(x: np.ndarray, t: int) -> np.ndarray:
        """Messages (blocks x ... x 2) one step on."""
        at = (slice(None), *[None] * (x.ndim - 2))
        y = np.logaddexp(x[..., 0, None] + moves[0], x[..., 1, None] + moves[1]) + node[t][at]
        return np.where(live[t][at], y, x)

    across = np.broadcast_to(np.where(np.eye(2) > 0, 0.0, -np.inf), (blocks, 2, 2))
    for t in range(length):
        across = onward(across, t)
    first, last = np.zeros((blocks, 2)), np.zeros((blocks, 2))
    x = np.array([0.0, evidence[0]])
    for k in range(blocks):
        first[k] = x
        x = np.logaddexp(x[0] + across[k, 0], x[1] + across[k, 1])
    total, y = np.logaddexp(*x), np.zeros(2)
    for k in range(blocks - 1, -1, -1):
        last[k] = y
        y = np.logaddexp(across[k, :, 0] + y[0], across[k, :, 1] + y[1])
    good = np.empty((length, blocks))
    for t in range(length):
        first = onward(first, t)
        good[t] = first[:, 1]
    for t in range(length - 1, -1, -1):
        good[t] += last[:, 1]
        z = node[t] + last
        last = np.where(live[t], np.logaddexp(moves[:, 0] + z[:, 0, None], moves[:, 1] + z[:, 1, None]), last)
    rest = good.T.ravel()[:steps]
    return np.exp(np.minimum(np.concatenate([[evidence[0] + y[1]], rest]) - total, 0))


def long_mean(field: Field, text: str, block: int = 20_000) -> float:
    """document_means of a text of many lines: features live for a block of lines at a time, evidence and lengths for all."""
    n = text.count("\n") + 1
    evidence, sizes = np.empty(n), np.empty(n, np.float32)
    at, before, held = 0, None, None

    def judge(after: np.ndarray | None) -> None:
        nonlocal at, before
        rows = with_neighbours(np.vstack([x for x in (before, held, after) if x is not None]))
        rows = rows[before is not None :][: len(held)]
        rows[:, -4:] = (0, 0, 1 / n, 1)
        rows[0, -4], rows[-1, -3] = before is None, after is None
        evidence[at : at + len(held)] = rows @ field.weights
        at += len(held)
        before = held[-1:]

    done = 0
    for lines in line_blocks(text, block):
        own, lengths = features_of(lines)
        sizes[done : done + len(own)] = lengths
        done += len(own)
        if held is not None:
            judge(own[:1])
        held = own
    judge(None)
    return float((long_marginals(evidence, field.moves) * sizes).sum() / sizes.sum(dtype=np.float64))


def text_means(field: Field, texts: Iterable[str | None], most_lines: int = 30_000, long_lines: int = 20_000) -> np.ndarray:
    """document_means of texts, of which at most so many lines are held as features at a time."""
    out, held, lines = [], [], 0

    def flush() -> None:
        nonlocal lines
        out.extend(document_means(field, held).tolist() if held else [])
        held.clear()
        lines = 0

    for text in texts:
        n = (text or "").count("\n") + 1
        if lines + n > most_lines or n > long_lines:
            flush()
        if n > long_lines:
            out.append(long_mean(field, text))
        else:
            held.append(line_features(text))
            lines += n
    flush()
    return np.array(out)


def document_means(field: Field, docs: list[tuple[np.ndarray, np.ndarray]], group: int = 240_000) -> np.ndarray:
    """Length-weighted mean of the marginals. Documents of like lengths are padded together, in bounded batches."""
    out = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda i: len(docs[i][1]))
    while order:
        longest, take = 0, 0
        while take < len(order) and take < 4096 and (take + 1) * (longest := len(docs[order[take]][1])) <= max(group // 8, longest):
            take += 1
        now, order = order[:take], order[take:]
        rows, at = _batch([with_neighbours(docs[i][0]) for i in now])
        good, _, _ = marginals(rows @ field.weights, at, field.moves)
        weights = np.concatenate([docs[i][1] for i in now])
        owner = np.repeat(np.arange(len(now)), [len(docs[i][1]) for i in now])
        out[now] = np.bincount(owner, good * weights, len(now)) / np.bincount(owner, weights, len(now))
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, steps: int = 100, ridge: float = 1e-3, max_lines: int = 40) -> Field:
    """Adam on the exact conditional log-likelihood; a document of more than `max_lines` lines is fitted as several chains."""
    made = [with_neighbours(d) for d, _ in docs]
    chains = [(d[i : i + max_lines], y) for d, y in zip(made, labels, strict=True) for i in range(0, len(d), max_lines)]
    rows, at = _batch([d for d, _ in chains])
    known = np.array([y for _, y in chains])
    rows = rows.astype(np.float64)
    live = at >= 0
    truth = np.zeros(len(rows))
    truth[at[live]] = np.repeat(known[:, None], at.shape[1], 1)[live]
    gold = np.zeros((2, 2))
    for label in (0, 1):
        gold[label, label] = live[known == label, 1:].sum()
    w, m = np.zeros(rows.shape[1]), np.zeros((2, 2))
    first, second = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        good, _, pairs = marginals(rows @ w, at, m)
        slope = np.concatenate([rows.T @ (good - truth), (pairs - gold).ravel()]) / len(rows) + ridge * np.concatenate([w, m.ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, m = w - move[:-4], np.clip(m - move[-4:].reshape(2, 2), -1.0, 1.0)
    field = Field(w, m)
    x, (a, b) = _logit(document_means(field, docs)), (1.0, 0.0)
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-(a * x + b)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - labels) * x).sum() + 1e-2 * a, (p - labels).sum()])
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    field.scale, field.shift = max(float(a), 1e-3), float(b)
    return field


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, train_docs: int = 1500, train_lines: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fits on at most `train_docs` labelled documents that aren't held out, without those of over `train_lines` lines."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(id_col), id_col).limit(train_docs)
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("t")).join(F.broadcast(chosen), id_col)  # train_docs rows at most

    @pandas_udf("struct<own:binary,sizes:binary>")
    def features(texts: pd.Series) -> pd.DataFrame:
        made = [line_features(t) for t in texts]
        return pd.DataFrame({"own": [o.tobytes() for o, _ in made], "sizes": [s.tobytes() for _, s in made]})

    short = F.coalesce(F.length("t") - F.length(F.replace(F.col("t"), F.lit("\n"), F.lit(""))), F.lit(0)) < train_lines
    got = rows.where(short).select(id_col, "quality", features("t").alias("f")).select(id_col, "quality", "f.*").dropDuplicates([id_col]).orderBy(id_col).collect()
    known = np.array([r["quality"] for r in got], np.float64)
    if len(set(known.tolist())) < 2:
        return Field(np.zeros(with_neighbours(np.zeros((1, FEATURES))).shape[1]), np.zeros((2, 2)))
    return fit([(np.frombuffer(r["own"], np.float32).reshape(-1, FEATURES), np.frombuffer(r["sizes"], np.float64)) for r in got], known)


def with_quality(docs: DataFrame, field: Field, *, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """The documents, all columns, with a score between 0 and 1: higher where label 1 is likelier."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = field.scale * _logit(text_means(field, texts)) + field.shift
        return pd.Series(1 / (1 + np.exp(-x)))

    return docs.withColumn(out, score.asNondeterministic()(docs[text_col]))
