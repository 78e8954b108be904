"""The task's tables expressed over the driver's test tables.

documents are the answers, benchmark the passages, labels the two targets, and
the components of embeddings the predictions of many models.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, spelling
from ..session import materialise, shared_dir

N_MODELS = 12
PREFIX = "upload_model/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all task slots for a table of few file splits; a large table stays as it is.

    Hashing by the row key keeps the later grouping by that key local.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("prompt_id"),
        F.array_join(F.slice(words, 1, 6), " ").alias("prompt_question"),
        F.array_join(F.slice(words, 1, 3), " ").alias("prompt_title"),
        F.col("text").alias("prompt_text"),
    )


def prompt_key(spark: SparkSession, sf_dir: str, column: str) -> Column:
    """Rows are dealt to all passages in turn; the number of passages is file metadata."""
    return F.pmod(F.col(column), F.lit(table(spark, sf_dir, "benchmark").count())).cast("string")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("student_id"),
        prompt_key(spark, sf_dir, "doc_id").alias("prompt_id"),
        "text",
    )
    return spread(docs, "student_id")


def truth_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("student_id"),
        F.col("quality").cast("double").alias("content"),
        F.col("toxic").cast("double").alias("wording"),
    )


def scored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that have targets: the training side."""
    return summaries(spark, sf_dir).join(truth_wide(spark, sf_dir), "student_id")


def unscored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir).join(truth_wide(spark, sf_dir).select("student_id"), "student_id", "left_anti")


def quoting_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that quote: the first 20 characters of their passage and a made-up span."""
    joined = joins.join_prompt(summaries(spark, sf_dir), prompts(spark, sf_dir))
    return joined.withColumn(
        "text",
        F.concat(
            "text", F.lit(' "'), F.substr("prompt_text", F.lit(1), F.lit(20)), F.lit('" "#" "'),
            F.substr("prompt_text", F.lit(1), F.lit(20)), F.lit('"'),
        ),
    )


def base_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.corpus_vocabulary(table(spark, sf_dir, "documents"), "text", min_count=5)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.dictionary(base_vocabulary(spark, sf_dir), prompts(spark, sf_dir))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon over the passages' words; scores follow from word length and first letter."""
    words = (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("word"))
        .distinct()
    )
    size, first = F.length("word"), F.ascii("word")
    return words.select(
        "word",
        # eighths add up without rounding, in any order
        (F.pmod(size * 7 + first, F.lit(17)) / 8.0 - 1.0).cast("double").alias("polarity"),
        (F.pmod(size + first, F.lit(9)) / 8.0).cast("double").alias("subjectivity"),
        (F.pmod(size * 5 + first, F.lit(9)) - 4.0).cast("double").alias("valence"),
    )


def irregular_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, syllables) for every passage word whose length is divisible by three, by its length."""
    size = F.length("word")
    return lexicon(spark, sf_dir).where(size % 3 == 0).select("word", (size % 4 + 1).cast("bigint").alias("syllables"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are the one, two or three tokens that open a passage or follow a full stop."""
    from ..functions import tokens as tk

    opened = table(spark, sf_dir, "benchmark").select(
        F.explode(F.split(F.lower("text"), r"\.")).alias("sentence")
    )
    found = opened.select(tk.tokens(F.col("sentence")).alias("t"))
    kinds = F.array(
        *[
            F.struct(
                F.array_join(F.slice("t", 1, n), " ").alias("phrase"), F.lit(label).alias("label"), F.lit(n).alias("n")
            )
            for n, label in ((1, "PERSON"), (2, "ORG"), (3, "GPE"))
        ]
    )
    return (
        found.select(F.size("t").alias("have"), F.inline(kinds))
        .where(F.col("have") >= F.col("n"))
        .select("phrase", "label")
        .distinct()
    )


def model_name(m: int, prefixed: bool = False) -> str:
    head = PREFIX if prefixed and m % 3 == 0 else ""
    tail = "_clean_text" if m % 4 == 0 else ""
    return f"{head}model_{m:02d}{tail}"


MODELS = tuple(model_name(m) for m in range(1, N_MODELS + 1))


def wide_predictions(spark: SparkSession, sf_dir: str, prefixed: bool = False) -> DataFrame:
    """Model m predicts content with component m and wording with component m + N_MODELS."""
    columns = []
    for m in range(1, N_MODELS + 1):
        name = model_name(m, prefixed)
        for target, component in (("wording", m + N_MODELS), ("content", m)):
            columns.append(F.get("embedding", F.lit(component - 1)).cast("double").alias(f"{name}_{target}_pred"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), *columns)


def predictions(spark: SparkSession, sf_dir: str, prefixed: bool = False) -> DataFrame:
    from ..sources.tables import melt_predictions

    return melt_predictions(wide_predictions(spark, sf_dir, prefixed))


def prediction_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, target, y): the label for content, component 64 for wording."""
    wide = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("double").alias("content"),
        F.get("embedding", F.lit(63)).cast("double").alias("wording"),
    )
    return wide.unpivot("row_id", ["content", "wording"], "target", "y")


def scored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, model, target, fold, pred, y) without a join: both come from one row."""
    entries = []
    for m in range(1, N_MODELS + 1):
        for target, component, truth in (("content", m, F.col("label")), ("wording", m + N_MODELS, F.get("embedding", F.lit(63)))):
            entries.append(
                F.struct(
                    F.lit(model_name(m)).alias("model"),
                    F.lit(target).alias("target"),
                    F.get("embedding", F.lit(component - 1)).cast("double").alias("pred"),
                    truth.cast("double").alias("y"),
                )
            )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.pmod("vec_id", F.lit(4)).cast("int").alias("fold"), F.inline(F.array(*entries))
    )


#: The feature table's parts: answers with targets, which models learn from, and the others, which they are applied to.
SCORED, UNSCORED = "scored", "unscored"


def feature_table(
    spark: SparkSession, sf_dir: str, options, n_splits: int, root: str | None = None, parts: Sequence[str] = (SCORED, UNSCORED)
) -> tuple[DataFrame, bool]:
    """The complete feature table of all answers, targets and folds where they exist, and whether it was in the cache.

    A query that only fits and judges models names the part that it reads. The dictionary comes from all answers whatever the
    part, and an answer's features from it, the answer and its passage, so a part's rows are those of the whole table.
    """
    from ..operators import folds
    from ..sources.tables import cached_parts
    from .features import build_features

    def build(missing: Sequence[str]) -> dict[str, DataFrame]:
        answers = summaries(spark, sf_dir).join(truth_wide(spark, sf_dir), "student_id", "left")
        of = {SCORED: F.col("content").isNotNull(), UNSCORED: F.col("content").isNull()}
        if len(missing) == 1:
            answers = answers.where(of[missing[0]])
        made = materialise(build_features(answers, prompts(spark, sf_dir), base_vocabulary(spark, sf_dir), options), "features")
        out = {}
        if SCORED in missing:
            out[SCORED] = folds.group_kfold(made.where(of[SCORED]), "prompt_id", n_splits, spread_by="student_id")
        if UNSCORED in missing:
            out[UNSCORED] = made.where(of[UNSCORED]).withColumn("fold", F.lit(None).cast("int"))
        return out

    inputs = [table(spark, sf_dir, name) for name in ("documents", "benchmark", "labels")]
    root = root or f"{shared_dir(spark)}/inkscore/feature-cache"
    made, there = cached_parts(spark, root, inputs, (options, n_splits), parts, build)
    return reduce(DataFrame.unionByName, [part.withColumn("fold", F.col("fold").cast("int")) for part in made.values()]), there
