"""A training corpus from raw documents: STAGES, each an operator of millrace.llm at work on all that the one before kept.

Defined results of every stage: a null text counts as empty for scores, fingerprints, windows and tokens, and stays null in
what is passed on; empty and very long texts are judged like any other; rows are known by id and text, so repeated ids, null
ids and repeated rows take no other row along, and of repeated rows the near-duplicate stage keeps one; other columns than
those of documents, whatever their names, are not passed on; an empty table gives an empty table; without
labels of both kinds the first stage has nothing to reject by and keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, line_dedup, packing, quality, simhash
from millrace.llm.util import checkpointed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_quality(docs, field, out="_score").where(F.col("_score") >= 0.3).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, however short; every document stays.

    Near copies, of which the next stage keeps one that must be whole, count as one document.
    """
    return line_dedup.dedup_lines(docs, dropped_col="_dropped", min_tokens=1, copies=0.8).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: similar by 0.8 in shingles of five words, by any of eight fingerprints."""
    return simhash.keep_one(docs, prints=8, shingle=5, max_bits=5).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]
#: The scores of a fitted model, XXH64 fingerprints and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
