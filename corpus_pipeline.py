"""The corpus pipeline: quality, line dedup, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. run() writes what each stage
returns to the shared folder and gives it to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm import line_dedup, ngram_join, packing, quality, secret_scan
from swatchline.llm.common import cut, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it's fitted on the labelled documents among docs."""
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    rows = quality.with_statistics(docs.select(F.struct("*").alias("row"), "text"))
    return rows.where(quality.compiled(*model) >= 0.5).select("row.*")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that recur in other documents; a document that loses all of its text goes."""
    others = [c for c in docs.columns if c != "text"]
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")))
    out = out.where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars").cast("long"))
    changed = {"text": F.col("text"), "n_chars": n_chars}
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. Null ids stay.

    Rows of one id count as one document, and stay or go together.
    """
    linked = ngram_join.link_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(linked, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark."""
    out = secret_scan.redact_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", drop_recurring_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Stages fit a model, decode candidates and tokenize: no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
