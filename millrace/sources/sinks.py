"""What goes out: upserts, events, and rows of request, audit and registry logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, memory
from . import store


def upserted(current: DataFrame, incoming: DataFrame, key: Sequence[str], newest: Sequence[str] | None = None) -> DataFrame:
    """The current rows with those of `incoming` put over them by key; of several for one key the one with the largest
    `newest` (all its columns, where none are named) stays."""
    others = [c for c in incoming.columns if c not in key]
    last = incoming.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*(newest or others))).alias("_last")).select(*key, "_last.*")
    return current.join(last.select(*key), list(key), "left_anti").unionByName(last)


def events(rows: DataFrame, kind: str, key: Column, **fields: Column) -> DataFrame:
    """Key and JSON value, as the Kafka sink takes them."""
    body = F.struct(F.lit(kind).alias("event_type"), *(c.alias(n) for n, c in fields.items()))
    return rows.select(key.cast("string").alias("key"), F.to_json(body).alias("value"))


def failed_events(rows: DataFrame) -> DataFrame:
    """Lifecycle events of failed documents; the error is cut to 2000 characters."""
    return events(rows, "document.index_failed", F.col("document_id"), job_id=F.col("job_id"), document_id=F.col("document_id"), failed_stage=F.col("failed_stage"), error=F.substring("error", 1, 2000))


def request_log(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of requests, and of their sources, numbered from 1 with excerpts of at most 1200 characters."""
    sources = responses.select("request_id", F.posexplode("sources").alias("at", "source"))
    return responses.drop("sources"), sources.select("request_id", (F.col("at") + 1).alias("rank"), "source.document_id", F.substring("source.content", 1, 1200).alias("excerpt"))


def audit_rows(calls: DataFrame) -> DataFrame:
    """A preview of at most 500 characters where the call went well."""
    return calls.withColumn("preview", F.when(F.col("status") == "ok", F.substring("result", 1, 500))).drop("result")


def missing_assets(payloads: DataFrame, assets: DataFrame) -> DataFrame:
    """Of each (tenant, bucket, path) without an asset, the type and title of its first chunk."""
    key = ["tenant_id", "bucket_id", "source_path"]
    first = payloads.groupBy(*key).agg(F.min_by(F.struct("source_type", "title"), "chunk_index").alias("f"))
    return first.select(*key, "f.*").join(assets.select(*key).distinct(), key, "left_anti")


def unique_names(files: DataFrame, name: str, order: str) -> Column:
    """Names in an archive: of those that differ only in case the second has -2 before its extension, and so on."""
    n = F.row_number().over(Window.partitionBy(F.lower(files[name])).orderBy(files[order]))
    return F.when(n == 1, files[name]).otherwise(F.concat(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.lit("-"), n.cast("string"), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)))


def requested_events(jobs: DataFrame) -> DataFrame:
    """One event a request, keyed by its first job: request_id, tenant_id and sorted job ids. As many jobs as a request has."""
    listed = jobs.groupBy("request_id", "tenant_id").agg(F.sort_array(F.collect_set("job_id")).alias("job_ids"))
    return events(listed, "indexing.requested", F.element_at("job_ids", 1), job_ids=F.col("job_ids"), tenant_id=F.col("tenant_id"), request_id=F.col("request_id"))


def indexed_events(rows: DataFrame) -> DataFrame:
    """Lifecycle events of indexed documents, keyed by document."""
    names = ("job_id", "document_id", "bucket_id", "tenant_id", "chunks_indexed")
    return events(rows, "document.indexed", F.col("document_id"), **{c: F.col(c) for c in names})


def to_kafka(rows: DataFrame, topic: str, servers: str) -> None:
    """Key and value rows to a topic; needs the Kafka package on the cluster."""
    rows.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def result_rows(answers: DataFrame, flags: Column) -> DataFrame:
    """One row a scenario and model, with the number of its sources and its flags as JSON; of repeated answers the last."""
    best = F.max_by(F.struct(*(c for c in answers.columns if c not in ("run_id", "scenario_id", "model"))), "created_at")
    last = answers.groupBy("run_id", "scenario_id", "model").agg(best.alias("a")).select("run_id", "scenario_id", "model", "a.*")
    return last.withColumns({"source_count": F.size("sources"), "quality_flags": F.to_json(flags)})


def write_jsonl(rows: DataFrame, folder: str, holdout: str) -> None:
    """Rows as lines of JSON. Refuses to write at, above or below the holdout."""
    ours, theirs = folder.rstrip("/") + "/", holdout.rstrip("/") + "/"
    if ours.startswith(theirs) or theirs.startswith(ours):
        raise ValueError(f"{folder} would write over the holdout {holdout}")
    rows.write.mode("overwrite").json(folder)


def corpus_manifest(rows: DataFrame, *, content: str, generated: str, ruled: str, is_copy: str, scenario: str, flag: str) -> DataFrame:
    """What a corpus holds, as (name, label, n): rows by class before and after the rules (copies only after), indexed rows by
    class, shortest and longest texts, scenarios of the product classes, phones and cards. One pass, some rows."""
    kinds = [F.lit(c) for c in evaluation.CLASSES]
    found, size, product = text.pii_counts(F.col(content)), F.length(content), F.col(ruled).isin(*evaluation.INDEXED)
    counted = [("total", F.lit("before"), F.count_if(~F.col(is_copy))), ("total", F.lit("after"), F.count(F.lit(1)))]
    for c, k in zip(evaluation.CLASSES, kinds, strict=True):
        own = F.col(ruled) == c
        counted += [("before", k, F.count_if((F.col(generated) == c) & ~F.col(is_copy))), ("after", k, F.count_if(own)), ("shortest", k, F.min(F.when(own, size))), ("longest", k, F.max(F.when(own, size)))]
        if c in evaluation.INDEXED:
            counted.append(("indexed", k, F.count_if(own & F.col(flag))))
            counted.append(("scenarios", k, F.count_distinct(F.when(own, F.col(scenario)))))
    counted += [("missing_scenario", F.lit("product"), F.count_if(product & F.col(scenario).isNull())), ("pii", F.lit("phone"), F.sum(found["phones"])), ("pii", F.lit("card"), F.sum(found["cards"]))]
    cells = F.array(*(F.struct(F.lit(name).alias("name"), label.alias("label"), n.cast("long").alias("n")) for name, label, n in counted))
    return rows.agg(cells.alias("cells")).select(F.inline("cells")).where("n is not null")


def write_corpus(raw: DataFrame, cleaned: DataFrame, folder: str, holdout: str, *, id_col: str, reason: str = "reason", **columns: str) -> None:
    """The corpus as raw and cleaned lines of JSON, and beside them its manifest and the report on what the rules changed.

    The manifest comes last: a folder without one isn't whole."""
    content, generated, ruled = (columns[c] for c in ("content", "generated", "ruled"))
    for name, rows in (("raw", raw), ("cleaned", cleaned), ("report", evaluation.mismatches(cleaned, id_col=id_col, generated=generated, ruled=ruled, reason=reason, content=content)), ("manifest", corpus_manifest(cleaned, **columns).coalesce(1))):
        write_jsonl(rows, f"{folder.rstrip('/')}/{name}", holdout)


def summarised(spark: SparkSession, path: str, messages: DataFrame, *, key: str, order: str, role: str = "role", content: str = "text", idle: Column | None = None, questions: int = 2, width: int = 40, buckets: int = 64) -> list[int]:
    """Makes and stores a summary, one row a session, of the sessions for which `memory.summary_due` gives a reason; the
    others keep the one they have. A summary is the beginnings of the last questions; `idle` is the seconds since the last
    message, by a session's rows. Returns the buckets replaced."""
    last = Window.partitionBy(key, role).orderBy(F.desc(order))
    placed = messages.withColumns({"_place": F.row_number().over(last), "_idle": F.lit(0) if idle is None else idle})
    asked = F.collect_list(F.when((F.col(role) == "user") & (F.col("_place") <= questions), F.struct(F.col(order).alias("at"), F.substring(content, 1, width).alias("said"))))  # `questions` at most
    summary = F.array_join(F.transform(F.array_sort(asked), lambda x: x["said"]), " / ")
    now = placed.groupBy(key).agg(F.count(F.lit(1)).alias("messages"), F.sum(text.tokens_floor(F.col(content))).alias("tokens"), summary.alias("summary"), F.max("_idle").alias("_idle"))
    stored = store.read(spark, path, [key])
    before = now.select(key, F.lit(None).cast("long").alias("_at")) if stored is None else stored.select(key, F.col("messages").alias("_at"))
    reason = memory.summary_due(F.col("messages"), F.col("tokens"), F.col("_at"), F.col("_idle"))
    due = now.join(before, key, "left").withColumn("reason", reason).where("reason is not null")
    return store.merge(spark, path, due.select(key, "messages", "tokens", "summary", "reason"), [key], buckets=buckets)


def synced(current: DataFrame, remote: DataFrame, tenant_id: str, kind: str) -> DataFrame:
    """Rows of another database, from `spark.read.jdbc` or any source, put over ours by an id made of tenant, kind and external id."""
    made = text.uuid5(F.concat_ws(":", F.lit(tenant_id), F.lit(kind), F.col("external_id").cast("string")))
    return upserted(current, remote.withColumns({"id": made, "tenant_id": F.lit(tenant_id)}).select(*current.columns), ["id"])


def staged(files: DataFrame, buckets: DataFrame, *, bucket: str, tenant_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """New files in a bucket known by id or by name: documents (pending, with digest and a day to live), and the bucket if it is new.

    `files` has path and content; empty files raise.
    """
    content = F.when(F.length("content") == 0, F.raise_error(F.concat(F.lit("empty file "), "path")).cast("binary")).otherwise(F.col("content"))
    known = buckets.where((F.col("tenant_id") == tenant_id) & ((F.col("bucket_id") == bucket) | (F.col("name") == bucket))).orderBy("bucket_id").limit(1).select("bucket_id")
    own = text.uuid5(F.concat_ws(":", F.lit(tenant_id), F.lit("bucket"), F.lit(bucket)))
    one = files.sparkSession.range(1).select(own.alias("_own"))  # one row
    target = one.join(known, how="left").select(F.coalesce("bucket_id", "_own").alias("bucket_id"), F.col("bucket_id").isNull().alias("_new"))
    documents = files.withColumn("content", content).join(F.broadcast(target)).select(text.uuid5(F.concat_ws(":", F.lit(tenant_id), F.col("bucket_id"), F.col("path"))).alias("document_id"), "bucket_id", F.lit(tenant_id).alias("tenant_id"), "path", F.sha2("content", 256).alias("sha256"), F.lit("pending").alias("status"), (now + F.expr("interval 1 day")).alias("expires_at"))
    return documents, target.where("_new").select("bucket_id", F.lit(bucket).alias("name"), F.lit(tenant_id).alias("tenant_id"))
