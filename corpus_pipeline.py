"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

toxic documents go, one document of each group of near copies stays, repeated paragraphs are cut, documents that hold
benchmark windows go, and what is left is packed into sequences. All stages but the last return the columns they got.
Null texts and empty tables pass through; columns of any other name are kept as they are. Steps that hand texts to Python
end inside their stage, while Arrow batches are small: a worker keeps its widest batch's memory through all later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscore.llm import decontamination, ngram_join, packing, paragraph_dedup
from inkscore.llm import toxicity as classifier
from inkscore.session import materialise, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; labels of the documents given teach it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with small_batches(spark):
        return materialise(classifier.score(docs, classifier.train(docs, labels)).filter("score < 0.5").select("row.*"), "not-toxic")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id.

    Documents without words are similar to none and stay; so do rows without doc_id and rows that repeat the kept doc_id.
    """
    found = ngram_join.similar_components(docs)
    # component_id is the smallest doc_id, so a document stays if it is its own component
    away = found.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = kept.join(away, "doc_id", "left_anti")
    return kept.select("row.*")


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated paragraphs and passages; one of which nothing is left goes."""
    made = paragraph_dedup.without_repeats(docs)
    made = made.filter((F.col("removed").isNull() & (F.col("n_cut") == 0)) | (F.length(F.trim("text")) > 0))
    return made.select(*[F.col("text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def benchmark_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    with small_batches(spark):
        return materialise(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "without-windows")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    with small_batches(spark):
        return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", near_copies),
    ("substring_dedup", repeated_paragraphs),
    ("decontamination", benchmark_windows),
    ("packing", sequences),
]

#: Fitted classifiers and token ids are no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
