"""Explicit schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

TARGETS = ("content", "wording")

PROMPTS = T.StructType(
    [
        T.StructField("prompt_id", T.StringType(), False),
        T.StructField("prompt_question", T.StringType()),
        T.StructField("prompt_title", T.StringType()),
        T.StructField("prompt_text", T.StringType()),
    ]
)
SUMMARIES = T.StructType(
    [
        T.StructField("student_id", T.StringType(), False),
        T.StructField("prompt_id", T.StringType(), False),
        T.StructField("text", T.StringType()),
    ]
)
SCORED_SUMMARIES = T.StructType(SUMMARIES.fields + [T.StructField(t, T.DoubleType()) for t in TARGETS])
PREDICTIONS = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("fold", T.IntegerType()),
        T.StructField("pred", T.DoubleType()),
    ]
)
