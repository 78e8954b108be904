"""Text features over a stream of answers.

The text features of an answer depend on that answer and a static passage table
only, so the batch plan runs unchanged on a stream: no state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.features import FeatureOptions, text_features
from ..sources.schemas import SUMMARIES


def read_answer_stream(spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SUMMARIES).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_features(answers: DataFrame, prompts: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    return text_features(answers, prompts, options)
