"""A corpus pipeline of five stages, each of whose results is written as Parquet and read again.

ORACLE_SQL is None: trigram models, hashed shingles and tokenizers have no SQL form; tests/llm holds the
stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import jaccard, langid, linewinnow, packing, templates
from heronlake.llm.common import arrow_batches, read_table, stored
from heronlake.llm.tokens import tokenizer_path

ORACLE_SQL = None
#: Documents that go to a Python worker at a time.
BATCH = 500


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go."""
    with arrow_batches(spark, BATCH):
        return langid.known_language(docs, declared="lang", host="source")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first document alone; documents emptied by that go."""
    out = linewinnow.dedup_lines(docs, min_words=50, gram_words=25, removed="_lines_removed")
    kept = out.where((F.col("_lines_removed") == 0) | (F.trim("text") != "")).drop("_lines_removed")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays: that with the smallest doc_id, null ids last, of equal ones any.

    Groups are of rows, so repeated rows and rows with a null doc_id are documents like others. Rows without words stay.
    """
    row = f"row_{uuid.uuid4().hex}"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    with arrow_batches(spark, BATCH):
        groups = jaccard.similar_components(rows.select(F.col(row).alias("doc_id"), "text"), size=5, num=80, den=100)
        several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
        member = groups.join(several.select("component_id"), "component_id", "left_semi").select(F.col("doc_id").alias(row), "component_id")
        member = stored(member.join(rows.select(row, "doc_id"), row), "pipeline-groups")
    kept = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    gone = stored(member.select(row).join(kept.select(row), row, "left_anti"), "pipeline-copies")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    with arrow_batches(spark, BATCH):
        return templates.decontaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    with arrow_batches(spark, BATCH):
        return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
