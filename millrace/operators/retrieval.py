"""Retrieval over a table of vectors with payload: filters, top-k, caps, merges, neighbours and reranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.arrays import cosine, joint_caps
from . import numbering


def payload_filter(equal: dict[str, object] | None = None, among: dict[str, Sequence[object]] | None = None, overlap: dict[str, Sequence[str]] | None = None, either: dict[str, Sequence[object]] | None = None) -> Column:
    """AND of equalities, IN lists and array overlaps, and of one OR group; empty lists mean no filter."""
    parts = [F.col(k) == v for k, v in (equal or {}).items() if v is not None]
    parts += [F.col(k).isin(*v) for k, v in (among or {}).items() if v]
    parts += [F.arrays_overlap(F.col(k), F.array(*map(F.lit, v))) for k, v in (overlap or {}).items() if v]
    group = [F.col(k).isin(*v) for k, v in (either or {}).items() if v]
    if group:
        parts.append(reduce(Column.__or__, group))
    return reduce(Column.__and__, parts, F.lit(True))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, *, id_col: str, vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The filter runs below the limit, and each task keeps k rows only (TakeOrderedAndProject)."""
    kept = vectors if where is None else vectors.where(where)
    return kept.withColumn("score", cosine(F.col(vector_col), query)).orderBy(F.desc_nulls_last("score"), id_col).limit(k)


def scroll(vectors: DataFrame, limit: int, *, id_col: str, where: Column | None = None, after: object = None) -> DataFrame:
    """Rows that fit the filter, without a vector to compare: the first `limit` by id, or those after an id, with a null score."""
    kept = vectors if where is None else vectors.where(where)
    kept = kept if after is None else kept.where(F.col(id_col) > F.lit(after))
    return kept.withColumn("score", F.lit(None).cast("double")).orderBy(id_col).limit(limit)


def above_threshold(rows: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    """Null threshold keeps all rows; otherwise the bound is inclusive and null scores go."""
    return rows if threshold is None else rows.where(F.col(score) >= threshold)


def lowered_threshold(threshold: float | None, target: float = 0.45) -> float:
    return target if threshold is None else min(threshold, target)


def cap_per_key(rows: DataFrame, key: str, most: int, order: Sequence[Column]) -> DataFrame:
    """At most `most` rows of a key. Spark keeps `most` rows per key in each task before the exchange."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def merge_by_priority(lists: Sequence[DataFrame], id_col: str, pos: str) -> DataFrame:
    """Lists one after another, of which the first row of an id stays; `pos` is the place in the own list."""
    tagged = [df.withColumn("_priority", F.lit(i)) for i, df in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, tagged)
    first = Window.partitionBy(id_col).orderBy("_priority", pos)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumnRenamed("_priority", "list_no")


def backfilled(ranked: DataFrame, pool: DataFrame, *, kind: str, wanted: str, limit: int, id_col: str, pos: str, most: int = 2) -> DataFrame:
    """If the first `limit` rows lack a type, its first `most` rows of the pool come first."""
    lacks = ranked.where((F.col(pos) < limit) & (F.col(kind) == wanted)).agg((F.count(F.lit(1)) == 0).alias("_lacks"))
    extra = pool.where(F.col(kind) == wanted).orderBy(pos).limit(most).join(F.broadcast(lacks), F.col("_lacks")).drop("_lacks")
    return merge_by_priority([extra, ranked], id_col, pos)


def neighbours(rows: DataFrame, seeds: DataFrame, key: str, place: str, radius: int) -> DataFrame:
    """Rows within `radius` places of a seed with the same key; the range join is an equi-join over places."""
    around = seeds.select(key, F.explode(F.sequence(F.col(place) - radius, F.col(place) + radius)).alias(place)).distinct()
    return rows.join(around, [key, place], "left_semi")


def rerank_score(score: Column, matches: Column, is_window: Column) -> Column:
    return F.coalesce(score, F.lit(0.75)) + F.least(F.lit(0.2), matches * 0.05) + F.when(is_window, 0.03).otherwise(0.0)


def searched(vectors: DataFrame, query: Sequence[float], k: int, *, id_col: str, vector_col: str = "embedding", where: Column | None = None, threshold: float | None = None, caps: dict[str, int] | None = None, extra: DataFrame | None = None, multiplier: int = 3) -> DataFrame:
    """A search that fetches `multiplier` times k rows, drops low scores, puts `extra` rows first, limits rows a key, and cuts to k.

    `extra` has the columns of `vectors` and a place `pos`. After the first limit there are at most k * multiplier rows and
    those of `extra`, which is bounded by its own limit; they are numbered and capped as one list.
    """
    near = top_k(vectors, query, k * multiplier, id_col=id_col, vector_col=vector_col, where=where)
    kept = above_threshold(near, threshold).withColumn("pos", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), id_col)))
    lists = [kept] if extra is None else [extra.withColumn("score", F.lit(None).cast("double")).select(*kept.columns), kept]
    merged = merge_by_priority(lists, id_col, "pos").withColumn("rank", F.row_number().over(Window.orderBy("list_no", "pos"))).drop("list_no", "pos")
    if caps:
        rows = merged.drop(vector_col).groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in merged.columns if c not in ("rank", vector_col))))).alias("rows"))
        merged = rows.select(F.inline(joint_caps(F.col("rows"), caps)))
    return merged.orderBy("rank").limit(k)


def exact_rows(rows: DataFrame, message: str, limit: int, *, content: str = "content", row_number: str = "row_number", header_rows: int = 12) -> DataFrame:
    """Spreadsheet rows with most of the message's terms, then the first rows where it asks for a document's head; list_no, pos."""
    wanted = rules.excel_terms(F.lit(message))
    counted = rows.withColumn("matches", text.match_count(F.col(content), wanted))
    hits = counted.where("matches > 0").orderBy(F.desc("matches"), row_number).limit(limit)
    hits = hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("matches"), row_number)))  # `limit` rows
    asks = rules.contains_any(F.lit(message), rules.HEADER_MARKERS)
    head = counted.where(asks & (F.col(row_number) <= header_rows)).orderBy(row_number).limit(limit)
    head = head.withColumn("pos", F.row_number().over(Window.orderBy(row_number)))
    return merge_by_priority([hits, head], row_number, "pos")


def exact_images(rows: DataFrame, message: str, limit: int, *, content: str = "content") -> DataFrame:
    """Pictures anchored to a sheet's cells with most of the message's terms, by anchor row and picture."""
    anchored = (F.col("source_type") == "image_digest") & (F.col("parent_source_type") == "xlsx") & (F.col("anchor_type") == "xlsx_cell")
    counted = rows.where(anchored).withColumn("matches", text.match_count(F.col(content), rules.excel_terms(F.lit(message))))
    return counted.where("matches > 0").orderBy(F.desc("matches"), "anchor_row", "image_index").limit(limit)


#: The order of a document's parts: file, first paragraph, paragraphs before windows, id.
DOCUMENT_ORDER = ["source_path", "place", "is_window", "id"]


def with_document_place(rows: DataFrame) -> DataFrame:
    """place and is_window of rows with paragraph_index, or with paragraph_start_index where that is null."""
    return rows.withColumns({"place": F.coalesce("paragraph_index", "paragraph_start_index", F.lit(0)), "is_window": (F.coalesce("block_type", F.lit("")) != "paragraph").cast("int")})


def around_seeds(candidates: DataFrame, seeds: DataFrame, radius: int = 2) -> DataFrame:
    """Paragraphs, and windows whose stretch, within `radius` paragraphs of a seed's, whatever the file.

    Every paragraph number a candidate could meet is one row, so this is an equi-join; a window is a few paragraphs.
    """
    first = F.coalesce("paragraph_index", "paragraph_start_index") - radius
    last = F.coalesce("paragraph_index", "paragraph_end_index") + radius
    numbers = seeds.where("paragraph_index is not null").select(F.col("paragraph_index").alias("_p")).distinct()
    reach = candidates.select("id", F.explode(F.sequence(first, last)).alias("_p")).join(numbers, "_p", "left_semi").select("id").distinct()
    return candidates.join(reach, "id", "left_semi")


def exact_paragraphs(candidates: DataFrame, found: DataFrame, message: str, limit: int, radius: int = 2) -> DataFrame:
    """Paragraphs with most of the message's terms, then what stands around these and around what was found; list_no, pos."""
    counted = with_document_place(candidates.withColumn("matches", rules.docx_match_count(F.col("content"), rules.docx_terms(F.lit(message)))))
    order = [F.desc("matches"), *map(F.col, DOCUMENT_ORDER)]
    hits = counted.where("matches > 0").orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    near = around_seeds(counted, found.select("paragraph_index").union(hits.select("paragraph_index")), radius)
    near = near.orderBy(*DOCUMENT_ORDER).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*DOCUMENT_ORDER)))
    return merge_by_priority([hits, near], "id", "pos")


def reranked(rows: DataFrame, message: str, *, pos: str = "pos") -> DataFrame:
    """Rows with their rerank score and rank by it, ties in the order they had, counted by ranges; only documents' rows get a
    boost, others keep their score or 0."""
    docx = F.col("source_type") == "docx"
    boosted = rerank_score(F.col("score"), rules.docx_match_count(F.col("content"), rules.docx_terms(F.lit(message))), F.col("block_type") == "paragraph_window")
    scored = rows.withColumn("rerank", F.when(docx, boosted).otherwise(F.coalesce("score", F.lit(0.0))))
    placed = numbering.numbered(scored.withColumn("_falling", -F.col("rerank")), ["_falling", pos], "rank")
    return placed.withColumn("rank", F.col("rank") + 1).drop("_falling")


def truncated(rows: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """At most `limit` rows, each with whether there would be more; one row more than these is read."""
    more = rows.orderBy(*order).limit(limit + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return more.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def in_request_order(rows: DataFrame, ids: Sequence[object], id_col: str) -> DataFrame:
    """The rows of the requested ids, in the order of the request, and a row of nulls with found = false for a missing one."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(dict.fromkeys(ids))], f"pos int, {id_col} {dict(rows.dtypes)[id_col]}")  # as long as the request
    return F.broadcast(wanted).join(rows.withColumn("found", F.lit(True)), id_col, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")


def with_nested(rows: DataFrame, children: DataFrame, key: str, out: str, order: Sequence[str]) -> DataFrame:
    """The rows with their children as a sorted list of structs; an empty list where there are none. As long as a row has children."""
    fields = [c for c in children.columns if c != key]
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in fields if c not in order)))).alias(out))
    return rows.join(listed, key, "left").withColumn(out, F.coalesce(out, F.array().cast(dict(listed.dtypes)[out])))


def first_wins(rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """id, rule_reason, duplicate_of: of rows with equal keys the one with the smallest id stays; null keys equal each other."""
    keyed = rows.select(id_col, F.sha2(F.coalesce(key, F.lit("")).cast("binary"), 256).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(id_col).alias("_first"))
    copy = F.col(id_col) != F.col("_first")
    return keyed.join(first, "_key").select(id_col, F.when(copy, "exact_duplicate").alias("rule_reason"), F.when(copy, F.col("_first")).alias("duplicate_of"))


def windows(rows: DataFrame, key: str, place: str, *, size: int = 8, step: int = 6) -> DataFrame:
    """key, window_no, rows: windows of `size` rows in order, a new one every `step` rows; none for a key with one row.

    The last window may be part of the one before. A row goes to the windows it belongs to, so a window is all a task holds.
    """
    order = Window.partitionBy(key).orderBy(place)
    numbered = rows.withColumns({"_at": F.row_number().over(order) - 1, "_size": F.count(F.lit(1)).over(Window.partitionBy(key))}).where("_size >= 2")
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step))
    dealt = numbered.withColumn("window_no", F.explode(F.sequence(first, F.floor(F.col("_at") / step))))
    return dealt.groupBy(key, "window_no").agg(F.array_sort(F.collect_list(F.struct("_at", *rows.columns))).alias("rows"))


def best_upload(documents: DataFrame, *, owner: str, digest: str) -> DataFrame:
    """At most one document of the owner with the digest in its JSON metadata: indexed ones first, then the newest."""
    same = documents.where((F.col("owner_id") == owner) & (F.get_json_object("metadata", "$.content_sha256") == digest))
    return same.orderBy(F.desc(F.coalesce(F.col("status") == "indexed", F.lit(False))), F.desc("created_at"), "document_id").limit(1)


def json_rows(rows: DataFrame) -> DataFrame:
    """Each row as JSON, with dates and times in ISO form and nulls kept."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}
    return rows.select(F.to_json(F.struct(*rows.columns), options).alias("row"))
