"""SimHash near-duplicates: fingerprints linked at few differing bits, found with vantage-point trees.

Fingerprints: 4-word shingles (repeats included) hashed by XXH64 with seed 42; a bit is set where over half of the
hashes have it. Documents meet only through distinct fingerprints, so copies cost nothing after the first.

Pairs: two fingerprints within `max_bits` = 4 differ by at most one bit in one of three thirds of the 64 bits. Each
third has a vantage-point tree over Hamming distances, in which the search radius is therefore 1 and not 4. A level of
the tree has a slice of the third's bits of its own, a vantage point and a radius: a fingerprint goes inside or outside
by its distance to the point in that slice. By the triangle inequality a partner lies on the other side only if it
differs in the slice by at least the distance to the radius; only then is the other side's shard queried as well. As the
levels' slices don't overlap, these differences add up, and a query that has spent the radius on one level crosses no
other: a fingerprint is sent to 1 + levels shards at most, not to a number that doubles with each level. Of a pair that a
level parts, the inner one visits the outer side, so residents cross in one direction only. The radius of a level is the
one that parts a bounded sample most evenly. The number of levels follows the logarithm of the number of fingerprints, so shards keep their size as the corpus grows, up to one level a bit.

A shard with more than `shard_rows` residents or visitors (thousands of near copies) is cut into chunks of about that size,
and a task gets two of them: two chunks of residents, or one of residents and one of visitors. No task holds a shard
whole, however crowded it is. A task compares its rows by 64-bit exclusive-or and bit counts, in
blocks, and returns a spanning forest of the links it finds, never the pairs, which within a group grow with its square.
The forests are joined to components by rounds of large-star and small-star over (fingerprint, fingerprint) rows.

Defined results: null text counts as empty; texts without words have the fingerprint zero and link to each other and to
anything within 4 bits of zero; repeated rows are linked; a null id never becomes a component's id unless all are null;
an empty table gives an empty result; other columns are kept by `keep_one` and ignored otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from .util import UPPER, checkpointed

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
SHINGLE = 4
#: The thirds of a fingerprint, as bit masks.
THIRDS = (0x1FFFFF, 0x1FFFFF << 21, 0x3FFFFF << 42)
CHUNK = 50_000


def fingerprints(text: str | None, size: int = SHINGLE, prints: int = 1) -> np.ndarray:
    """Of a text's shingles `prints` fingerprints: the first of their hashes, the others of these hashes mixed once more."""
    import xxhash

    found = WORD.findall((text or "").encode("utf-8", "replace").translate(LOWER))
    if not found:
        return np.zeros(prints, np.uint64)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    size = min(size, len(found))
    starts = [0, *(ends[: len(found) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros((prints, 64), np.int64), len(starts)
    stops = ends[size - 1 :].tolist()
    for at in range(0, total, CHUNK):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)), np.uint64)
        for k in range(prints):
            mixed = h if not k else mixed_again(h, k)
            ones[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view(np.uint64)[:, 0]


def mixed_again(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes whose bits have nothing to do with those of h, nor with those of another k."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return int(fingerprints(text, size)[0])


@pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    return docs.withColumn(out, _fingerprints.asNondeterministic()(docs[text_col]))


def with_fingerprints(docs: DataFrame, prints: int, shingle: int, text_col: str = "text", out: str = "fps") -> DataFrame:
    """Adds an array of `prints` fingerprints of shingles of so many words."""

    @pandas_udf(T.ArrayType(T.LongType()))
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprints(t, shingle, prints).view(np.int64) for t in texts], dtype=object)

    return docs.withColumn(out, made.asNondeterministic()(docs[text_col]))


#: A level of a tree: vantage point, radius, bits looked at.
Level = tuple[int, int, int]


def plan_trees(sample: np.ndarray, count: int, leaf_rows: int, seed: int = 7) -> list[list[Level]]:
    """For each third, the levels; the sample sets the radii and nothing else."""
    random = np.random.default_rng(seed)
    trees = []
    for mask in THIRDS:
        bits = random.permutation([b for b in range(64) if mask >> b & 1]).tolist()
        depth = min(max(0, int(np.ceil(np.log2(max(count, 1) / leaf_rows)))), len(bits))
        width = 3 if depth * 3 <= len(bits) else 1  # an odd number of bits parts evenly; of three bits fewer cross than of one
        levels = []
        for k in range(depth):
            part = sum(1 << b for b in bits[k * width : (k + 1) * width])
            point = int(random.integers(0, 2**63)) & part
            d = np.bitwise_count((sample ^ np.uint64(point)) & np.uint64(part))
            share = np.bincount(d, minlength=width + 1) / max(len(d), 1)
            radius = min(range(width), key=lambda r: abs(share[: r + 1].sum() - 0.5))
            levels.append((point, radius, part))
        trees.append(levels)
    return trees


def route(fps: np.ndarray, levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf, index of the fingerprint and whether it is only a visitor there, of all shards that a fingerprint reaches."""
    at, leaf, visitor = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), bool)
    for point, radius, part in levels:
        d = np.bitwise_count((fps[at] ^ np.uint64(point)) & np.uint64(part)).astype(np.int64)
        inside = d <= radius
        cross = inside & (d + 1 > radius) & ~visitor  # a visitor has spent its one bit on the level that it crossed
        leaf = np.concatenate([leaf * 2 + ~inside, leaf[cross] * 2 + 1])
        at, visitor = np.concatenate([at, at[cross]]), np.concatenate([visitor, np.ones(cross.sum(), bool)])
    return leaf, at, visitor


def forest(residents: np.ndarray, visitors: np.ndarray, max_bits: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, smaller root) of the links among residents and between residents and visitors."""
    nodes = np.unique(np.concatenate([residents, visitors]))
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    own = np.unique(residents)
    place = np.searchsorted(nodes, own)
    step = max(1, cells // max(len(own), 1))
    for at in range(0, len(nodes), step):
        block = nodes[at : at + step]
        a, b = np.nonzero(np.bitwise_count(block[:, None] ^ own[None, :]) <= max_bits)
        left, right = a + at, place[b]
        # links inside what is joined already are dropped in bulk, so a dense group costs one pass and not its pairs
        while True:
            roots = np.array([find(i) for i in range(len(nodes))]) if len(left) > len(nodes) else None
            if roots is not None:
                open_ = roots[left] != roots[right]
                left, right = left[open_], right[open_]
            if not len(left):
                break
            for i, j in zip(left[: len(nodes)].tolist(), right[: len(nodes)].tolist(), strict=True):
                i, j = find(i), find(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
            left, right = left[len(nodes) :], right[len(nodes) :]
    roots = np.array([find(i) for i in range(len(nodes))], np.int64)
    linked = roots != np.arange(len(nodes))
    return nodes[linked], nodes[roots[linked]]


def links(prints: DataFrame, *, kinds: int | None = None, max_bits: int = 4, leaf_rows: int = 2048, shard_rows: int = 16384, sample_rows: int = 4096) -> DataFrame:
    """Forest rows (u, v) that join all fingerprints `fp` within max_bits of each other.

    With `kinds`, fingerprints have a kind `k` below that number, only those of one kind meet, and rows are (k, u, v); all kinds
    go through the same trees at once."""
    if max_bits > 5:
        raise ValueError("three thirds leave one differing bit to one of them only up to 5 bits in all")
    by = kinds or 1
    count = -(-prints.count() // by)
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fp")).limit(sample_rows).select("fp").collect()], np.int64).view(np.uint64)
    trees = plan_trees(sample, count, leaf_rows)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            kind = batch["k"].to_numpy(np.int64) if kinds else np.zeros(len(fps), np.int64)
            for tree, levels in enumerate(trees):
                leaf, at, visitor = route(fps, levels)
                yield pd.DataFrame({"shard": (leaf * 3 + tree) * by + kind[at], "fp": fps[at].view(np.int64), "visitor": visitor})

    placed = prints.mapInPandas(shards, "shard long, fp long, visitor boolean")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps, resident = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["resident"].to_numpy(bool)
        u, v = forest(fps[resident], fps[~resident], max_bits)
        return pd.DataFrame({"k": int(key[0]) % by, "u": u.view(np.int64), "v": v.view(np.int64)}, index=range(len(u)))

    found = in_pairs(placed, shard_rows).groupBy("shard", "a", "b").applyInPandas(compare, "k int, u long, v long")
    return (found if kinds else found.select("u", "v")).distinct()


def in_pairs(placed: DataFrame, shard_rows: int) -> DataFrame:
    """Deals shards (shard, fp, visitor) out in groups (shard, a, b) of at most two chunks; `resident` says whose links to all
    others of the group are looked for."""
    crowd = placed.groupBy("shard").agg(F.count_if(~F.col("visitor")).alias("n"), F.count_if("visitor").alias("m")).where((F.col("n") > 0) & (F.greatest("n", "m") > shard_rows))
    cut = crowd.select("shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("own"), F.ceil(F.col("m") / shard_rows).cast("int").alias("others"))
    chunk = F.pmod(F.xxhash64("fp"), F.when(F.col("visitor"), F.col("others")).otherwise(F.col("own"))).cast("int")
    dealt = placed.join(cut, "shard", "left").withColumn("chunk", chunk)
    own, after = F.sequence(F.lit(0), F.col("own") - 1), F.col("own") + F.col("others")
    # residents meet the chunks of residents before and after theirs, and of visitors; the latter have numbers after these
    with_residents = F.transform(own, lambda k: F.struct(F.least(k, F.col("chunk")).alias("a"), F.greatest(k, F.col("chunk")).alias("b")))
    with_visitors = F.transform(F.when(F.col("others") > 0, F.sequence(F.col("own"), after - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.col("chunk").alias("a"), k.alias("b")))
    to_residents = F.transform(own, lambda k: F.struct(k.alias("a"), (F.col("own") + F.col("chunk")).alias("b")))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    groups = F.when(F.col("own").isNull(), whole).when(F.col("visitor"), to_residents).otherwise(F.concat(with_residents, with_visitors))
    rows = dealt.select("shard", "fp", "visitor", "chunk", F.explode(groups).alias("g"))
    resident = F.when(F.col("chunk").isNull(), ~F.col("visitor")).otherwise(~F.col("visitor") & (F.col("chunk") == F.col("g.a")))
    return rows.select("shard", "g.a", "g.b", "fp", resident.alias("resident"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes with a link, root being the component's smallest node; by large-star and small-star."""
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        after = checkpointed(small)
        # stars: every node has one smaller neighbour, and no root has one
        state = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(after.select(F.col("v").alias("u")).distinct().withColumn("is_root", F.lit(True)), "u", "left")
        if state.where("n > 1 or is_root").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def bits_of(similar: float, bits: int) -> int:
    """Differing bits that texts of a Jaccard similarity of `similar` and more have of so many, but for the rarest of them.

    Sets of like sizes have the cosine 2s / (1 + s), and a bit differs as often as a random plane parts the angle; two
    standard deviations are added."""
    share = float(np.arccos(2 * similar / (1 + similar)) / np.pi)
    return int(np.ceil(bits * share + 2 * np.sqrt(bits * share * (1 - share))))


def _more_links(prints: DataFrame, first: DataFrame, count: int, similar: float, **limits: int) -> DataFrame:
    """Links (u, v) between first fingerprints `fp`, found by any of the fingerprints `fps` and kept where all of them together
    differ by few enough bits."""
    pairs = checkpointed(prints.select("fp", F.posexplode(F.slice("fps", 2, count - 1)).alias("k", "other")).distinct())
    reps = checkpointed(pairs.groupBy("k", "other").agg(F.min("fp").alias("rep")))
    star = pairs.join(reps, ["k", "other"]).where("fp <> rep").select(F.col("fp").alias("u"), F.col("rep").alias("v"))
    forest_ = links(reps.select("k", F.col("other").alias("fp")), kinds=count - 1, **limits)
    left, right = (reps.select("k", F.col("other").alias(c), F.col("rep").alias(f"{c}_rep")) for c in ("u", "v"))
    across = forest_.join(left, ["k", "u"]).join(right, ["k", "v"]).select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v")).where("u <> v")
    edges = first.union(star).union(across)
    sketch = prints.groupBy("fp").agg(F.min("fps").alias("fps"))
    left, right = (sketch.select(F.col("fp").alias(c), F.col("fps").alias(f"{c}_fps")) for c in ("u", "v"))
    both = edges.distinct().join(left, "u").join(right, "v")
    differ = F.aggregate(F.zip_with("u_fps", "v_fps", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return checkpointed(both.where(differ <= bits_of(similar, 64 * count)).select("u", "v"))


def _with_first(prints: DataFrame, least: Column, count: int = 1, similar: float = 0.0, **limits: int) -> DataFrame:
    """The rows of `prints` (with fp) and `first`, the smallest `least` of all fingerprints that links reach."""
    distinct = checkpointed(prints.groupBy("fp").agg(least.alias("first")))
    found = links(distinct.select("fp"), **limits)
    roots = components(found if count == 1 else _more_links(prints, found, count, similar, **limits))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("first").alias("first"))
    return prints.join(of.select("fp", "root").join(smallest, "root").select("fp", "first"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Per input row: id, fp (the fingerprint as a signed long) and component_id, the smallest id that links reach."""
    prints = checkpointed(with_fingerprint(docs.select(docs[id_col].alias(id_col), docs[text_col].alias("t")), "t").select(id_col, "fp"))
    return _with_first(prints, F.min(id_col), **limits).select(id_col, "fp", F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prints: int = 1, shingle: int = SHINGLE, similar: float = 0.8, **limits: int) -> DataFrame:
    """The documents, all columns, of which each near-duplicate group keeps the one with the smallest id.

    With several `prints`, texts link where any one of their fingerprints differs by few bits, if all together differ by no
    more bits than those of texts with the similarity `similar` do: of texts with one word in a hundred
    changed (0.89 of their shingles in common) one fingerprint at four bits links 0.44, eight of five words at five bits 0.93.

    A row is known by its id and its text's hash, so an id on several texts, or none, takes no other group's row along;
    null ids come last, and of one id the smaller hash first.
    """
    hashed = "_hash"
    while hashed in docs.columns:
        hashed = f"_{hashed}"
    docs = docs.withColumn(hashed, F.xxhash64(docs[text_col]))
    texts = docs.select(docs[id_col].alias("_id"), docs[hashed].alias("_hash"), docs[text_col].alias("t"))
    printed = with_fingerprint(texts, "t") if prints == 1 and shingle == SHINGLE else with_fingerprints(texts, prints, shingle, "t").withColumn("fp", F.col("fps")[0])
    printed = checkpointed(printed.drop("t"))
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    groups = checkpointed(_with_first(printed, F.min(key), prints, similar, **limits).select("_id", "_hash", "first"))
    is_first = F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_hash") == F.col("first.hash"))
    gone = groups.where(~is_first).select(F.col("_id").alias("_gone_id"), F.col("_hash").alias("_gone_hash")).distinct()
    kept = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (docs[hashed] == gone["_gone_hash"]), "left_anti")
    repeated = groups.where(is_first).groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates([id_col, hashed])).drop(hashed)

