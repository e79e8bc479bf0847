"""Benchmark decontamination by a broadcast hash set of test n-grams (DataFrame functions only).

A benchmark item's windows are its runs of `window` consecutive words; a shorter item is one window. To find them, a
training document is not probed at every word: a window of L words always covers a whole run of g = (L + 1) // 2 words
that starts at a multiple of L - g + 1, so only those aligned runs are hashed and looked up among the runs of the
benchmark. Where one is found, the few windows that can lie around it are cut out and compared as text with the
benchmark's (the verification), so a hash collision cannot mark a word. Everything up to here happens where the document
was read: only verified hits are shuffled.

The benchmark's tables are broadcast while they hold at most `broadcast_rows` runs and `broadcast_bytes` of phrases.
Beyond, only (id, text hash, place, run hash) rows meet the benchmark's runs in a shuffle; what is found there goes back
to its text, one row a document, and the windows cut out of it are compared in a second shuffle. No text is shuffled
more than once, however large the benchmark.

Defined results: null or empty text has no words and is never contaminated; a null id is an id of its own; items without
words have no windows; repeated rows give repeated results; an empty benchmark marks nothing; columns other than the id,
the text and (for the cleaning functions) those returned are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import lower_ascii, without_places

#: What separates words, before or after lower-casing: ASCII characters that are no letters or digits.
SEPARATORS = r"[^\p{Alnum}\P{ASCII}]+"
#: The same words before lower-casing, and what separates them.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column | str) -> Column:
    """The words of a text: runs of digits, a to z and characters beyond ASCII, after lower-casing A to Z."""
    return _split(lower_ascii(text))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: phrase, len, items (sorted distinct item ids as strings)."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), words(benchmark[text_col]).alias("w")).where("size(w) > 0 and item is not null")
    size = F.least(F.size("w"), F.lit(window))
    cut = items.withColumn("len", size).select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    phrases = cut.select("item", "len", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("phrase"))
    return phrases.groupBy("phrase", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _runs_at(length: int) -> tuple[int, int]:
    """Words in an aligned run and the step between runs for windows of `length` words."""
    run = (length + 1) // 2
    return run, length - run + 1


def _hash(run: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), F.array_join(run, " "))


def _probe(length: int, run: int) -> Callable[[Column], Column]:
    """Place, window length, hash of the run, and the few words around it that its windows can cover with their first place.

    A probe carries these words and not the document's, so a row is as short for a long text as for a short one.
    """

    def probe(at: Column) -> Column:
        first = F.greatest(at - (length - run), F.lit(1))
        return F.struct(at.alias("at"), F.lit(length).alias("len"), _hash(F.slice("w", at, F.lit(run)), length).alias("h"), first.alias("from"), F.slice("w", first, F.lit(2 * length - run)).alias("around"))

    return probe


def _windows(words_: Column, from_: Column | int, at: Column, length: Column) -> Column:
    """Array of struct(at, len, phrase): the windows of `length` words that cover the run at `at`, of words that begin at `from_`."""
    run = F.floor((length + 1) / 2).cast("int")
    first = F.greatest(at + run - length, F.lit(1))
    last = F.least(at, F.size(words_) + from_ - length)
    return F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("at"), length.alias("len"), F.array_join(F.slice(words_, s - from_ + 1, length), " ").alias("phrase")))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000, broadcast_bytes: int = 128_000_000) -> DataFrame:
    """Per contaminated document: key columns `id` and `text_hash`, `spans` (array of struct(at, len)), `items`."""
    windows = benchmark_windows(benchmark, window)
    counted = windows.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("phrase") + 64 * F.size("items")).alias("b")).collect()  # at most `window` rows
    sizes = {r["len"]: r["n"] for r in counted}
    small = sum(n * (k - _runs_at(k)[0] + 1) for k, n in sizes.items()) <= broadcast_rows and sum(r["b"] for r in counted) <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), words(docs[text_col]).alias("w"))
    probes, known = [], None
    for length in sorted(sizes) or [window]:
        run, step = _runs_at(length)

        starts = F.sequence(F.lit(1), F.size("w") - run + 1, F.lit(step))
        probes.append(F.when(F.size("w") >= length, F.transform(starts, _probe(length, run))).otherwise(F.array().cast("array<struct<at:int,len:int,h:bigint,from:int,around:array<string>>>")))
        p = F.split("phrase", " ")
        inner = F.array(*(_hash(F.slice(p, i, run), length) for i in range(1, length - run + 2)))
        of = windows.where(F.col("len") == length).select(F.explode(inner).alias("h"))
        known = of if known is None else known.union(of)
    probed = rows.select("id", "text_hash", F.explode(F.concat(*probes)).alias("p"))
    if small:
        found = probed.select("id", "text_hash", "p.at", "p.len", "p.h", "p.from", "p.around").join(hint(known.distinct()), "h", "left_semi")
        candidates = found.select("id", "text_hash", _windows(F.col("around"), F.col("from"), F.col("at"), F.col("len")).alias("c"))
    else:
        met = probed.select("id", "text_hash", "p.at", "p.len", "p.h").join(known.distinct(), "h", "left_semi")
        # a document has at most as many as words
        places = met.groupBy("id", "text_hash").agg(F.collect_set(F.struct("at", "len")).alias("p")).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "p")
        back = rows.join(places, rows["id"].eqNullSafe(places["_id"]) & (rows["text_hash"] == places["_hash"]))
        cut = F.transform("p", lambda p: _windows(F.col("w"), F.lit(1), p["at"], p["len"]))
        candidates = back.select("id", "text_hash", F.flatten(cut).alias("c"))
    candidates = candidates.select("id", "text_hash", F.inline("c"))
    hits = candidates.join(hint(windows), ["phrase", "len"])
    # one document's hits are as many as its words at most
    return hits.groupBy("id", "text_hash").agg(F.collect_set(F.struct("at", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def _hit_words(spans: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_words, n_hit, items (sorted strings), contaminated."""
    hits = find_hits(docs, benchmark, window=window, id_col=id_col, text_col=text_col).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.size(_hit_words("spans")).cast("long").alias("_n"), F.sort_array("items").alias("_items")
    )
    rows = docs.select(docs[id_col], F.xxhash64(docs[text_col]).alias("_h"), F.size(_split(F.coalesce(docs[text_col], F.lit("")))).cast("long").alias("n_words"))
    joined = rows.join(hits, rows[id_col].eqNullSafe(hits["_id"]) & (rows["_h"] == hits["_hash"]), "left")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return joined.select(rows[id_col], "n_words", F.coalesce("_n", F.lit(0).cast("long")).alias("n_hit"), items.alias("items"), F.col("_n").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that hold a benchmark window."""
    hits = find_hits(docs, benchmark, window=window, id_col=id_col, text_col=text_col).select(F.col("id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"))
    return docs.join(hits, docs[id_col].eqNullSafe(hits["_hit_id"]) & (F.xxhash64(docs[text_col]) == hits["_hit_hash"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the hit words, and the separators after them, cut out of the text; others stay as they are."""
    hits = find_hits(docs, benchmark, window=window, id_col=id_col, text_col=text_col).select(F.col("id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), _hit_words("spans").alias("_hit_words"))
    joined = docs.join(hits, docs[id_col].eqNullSafe(hits["_hit_id"]) & (F.xxhash64(docs[text_col]) == hits["_hit_hash"]), "left").drop("_hit_id", "_hit_hash")
    # each word with the separators that follow it, and what stands before the first word
    pieces = F.regexp_extract_all(text_col, F.lit(f"({CASED_WORD}{CASED_SEPARATORS})"), 1)
    lead = F.regexp_extract(text_col, f"^{CASED_SEPARATORS}", 0)
    kept = without_places(pieces, F.transform(F.sort_array("_hit_words"), lambda i: i - 1))
    return joined.withColumn(text_col, F.when(F.col("_hit_words").isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(kept, "")))).drop("_hit_words")
