"""Batch scoring with a user's own model, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens as tk
from ..session import in_small_batches, materialise

TOKENS_AT_ONCE = 200_000


def score_partitions(
    df: DataFrame,
    load: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], Any],
    inputs: Sequence[str],
    keys: Sequence[str],
    output: str = "pred",
) -> DataFrame:
    """Add one prediction per row from a model that Spark cannot express.

    ``load`` runs once per task, on the executor; ``predict`` gets one batch of the
    input columns and returns as many numbers. Memory is bounded by the batch size
    (spark.sql.execution.arrow.maxRecordsPerBatch).
    """
    slim = df.select(*keys, *[c for c in inputs if c not in keys])
    schema = T.StructType([slim.schema[k] for k in keys] + [T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            result = batch[list(keys)].copy()
            result[output] = pd.Series(predict(model, batch[list(inputs)]), index=batch.index, dtype="float64")
            yield result

    return slim.mapInPandas(run, schema)


@in_small_batches
def score_models(
    df: DataFrame,
    settings: DataFrame,
    load: Callable[[dict], Any],
    predict: Callable[[Any, list[list[str]]], Any],
    text: str,
    keys: Sequence[str],
    most_models: int = 1000,
) -> DataFrame:
    """(keys, model, pred): every row once per model of a settings table, all models in one pass over the rows.

    ``settings`` has a row per model (at most ``most_models``, checked): model, max_length (tokens that the model reads; 0 or
    NULL for all), batch_size (rows that it gets at once, at most; 0 or NULL for a whole slice) and whatever else ``load`` needs.
    ``load`` gets such a row and runs once per task and model, on the executor; ``predict`` gets the token lists of a batch
    and returns as many numbers. A NULL text is not shown to a model and has the prediction NULL. Texts are cut into tokens
    once, and only up to the longest length asked for. They become Python strings by slices of an Arrow batch with at most
    ``TOKENS_AT_ONCE`` tokens (or one row), which bounds a task's memory however many rows a batch has and how long they are.
    The predictions are written once, while Arrow batches are small.
    """
    rows = [r.asDict() for r in settings.limit(most_models + 1).collect()]
    if len(rows) > most_models or len({r["model"] for r in rows}) < len(rows):
        raise ValueError(f"settings need a row per model, at most {most_models}")
    lengths = [r["max_length"] or 0 for r in rows]
    tokens = tk.tokens(F.col(text)) if 0 in lengths else F.slice(tk.tokens(F.col(text)), 1, max(lengths, default=1))
    slim = df.select(*keys, tokens.alias("_tokens"))
    schema = df.select(*keys).schema.add("model", "string").add("pred", "double")
    names = schema.fieldNames()

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows in slices of at most ``TOKENS_AT_ONCE`` tokens, or of one row."""
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(len(keys))), 0), dtype=np.int64)
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                most = (ends[first - 1] if first else 0) + TOKENS_AT_ONCE
                stop = min(max(first + 1, int(np.searchsorted(ends, most, side="right"))), len(sizes))
                yield batch.slice(first, stop - first)
                first = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [load(r) for r in rows]
        for batch in slices(batches):
            cells = batch.column(len(keys)).to_pylist()
            shown = [n for n, cell in enumerate(cells) if cell is not None]
            for setting, model in zip(rows, loaded, strict=True):
                length, size = setting["max_length"] or None, setting["batch_size"] or max(1, len(shown))
                preds: list[float | None] = [None] * len(cells)
                for first in range(0, len(shown), size):
                    part = shown[first : first + size]
                    for n, value in zip(part, predict(model, [cells[n][:length] for n in part]), strict=True):
                        preds[n] = float(value)
                label = pa.array([setting["model"]] * len(cells), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], label, pa.array(preds, pa.float64())], names)

    return materialise(slim.mapInArrow(run, schema), "scored")
