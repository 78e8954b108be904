"""Reduction of a text to plain letters, digits and single spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import CLEANING_STEPS


def clean_text(text: Column) -> Column:
    for pattern, replacement in CLEANING_STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text
