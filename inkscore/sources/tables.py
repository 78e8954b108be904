"""Readers and writers for passages, answers, predictions, features and submissions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # Quoted passages hold line breaks, so a file is one split: keep source files moderate.
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def read_prompts(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    if format == "csv":
        return _csv(spark, path, schemas.PROMPTS)
    return spark.read.schema(schemas.PROMPTS).format(format).load(path)


def read_summaries(spark: SparkSession, path: str, scored: bool = False, format: str = "csv") -> DataFrame:
    schema = schemas.SCORED_SUMMARIES if scored else schemas.SUMMARIES
    if format == "csv":
        return _csv(spark, path, schema)
    return spark.read.schema(schema).format(format).load(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, quoted so that the readers above restore every text exactly."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def head(df: DataFrame, key: str | Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in key order; a plain limit would not be reproducible."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def write_submission(df: DataFrame, path: str, key: str = "student_id") -> None:
    write_csv(submission(df, key), path)


def submission(df: DataFrame, key: str = "student_id") -> DataFrame:
    return df.select(key, *schemas.TARGETS)


def read_submission(spark: SparkSession, path: str, key: str = "student_id") -> DataFrame:
    schema = T.StructType(
        [T.StructField(key, T.StringType())] + [T.StructField(t, T.DoubleType()) for t in schemas.TARGETS]
    )
    return _csv(spark, path, schema)


def write_features(df: DataFrame, path: str, partition_by: str | None = "fold") -> None:
    """Feature cache; partitioned by fold so that a fold filter reads only its files."""
    writer = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        # one shuffle-free write: each task appends to at most n_splits folders
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fingerprint(inputs: Sequence[DataFrame], options: object) -> str:
    """A key of the inputs' rows, in any order, their columns, and the options; one aggregate for each input."""
    said = [repr(options)]
    for df in inputs:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        found = df.agg(F.count("*"), F.sum(row.cast("decimal(20,0)")), F.bit_xor(row)).first()
        said.append(f"{df.schema.simpleString()} {tuple(map(str, found))}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:32]


def _is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was completed; one that broke off leaves no mark of success."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def cached_features(
    spark: SparkSession, root: str, inputs: Sequence[DataFrame], options: object, build: Callable[[], DataFrame]
) -> tuple[DataFrame, bool]:
    """The table that ``build`` makes of the inputs under the options, and whether it was there already.

    Tables stand under ``root`` by the fingerprint of what they were made from: changed rows, columns or options have another
    place, so a stale table is never read, and a table that was only written in part is written anew.
    """
    path = f"{root}/{fingerprint(inputs, options)}"
    there = _is_written(spark, path)
    if not there:
        write_features(build(), path)
    return read_features(spark, path), there


def cached_parts(
    spark: SparkSession, root: str, inputs: Sequence[DataFrame], options: object, parts: Sequence[str], build: Callable[[Sequence[str]], Mapping[str, DataFrame]]
) -> tuple[dict[str, DataFrame], bool]:
    """As ``cached_features`` for a table in parts: only those parts are made, by one call of ``build``, that are not there yet."""
    key = fingerprint(inputs, options)
    paths = {part: f"{root}/{key}/part-{part}" for part in parts}
    missing = [part for part in parts if not _is_written(spark, paths[part])]
    if missing:
        for part, made in build(missing).items():
            write_features(made, paths[part])
    return {part: read_features(spark, path) for part, path in paths.items()}, not missing


def melt_predictions(wide: DataFrame, row_id: str = "row_id", targets: Sequence[str] = schemas.TARGETS) -> DataFrame:
    """Wide table with ``{model}_{target}_pred`` columns to (row_id, model, target, pred)."""
    pattern = rf"^(.*)_({'|'.join(targets)})_pred$"
    value_columns = [c for c in wide.columns if c != row_id and any(c.endswith(f"_{t}_pred") for t in targets)]
    long = wide.unpivot(row_id, value_columns, "series", "pred")
    return long.select(
        F.col(row_id),
        F.regexp_extract("series", pattern, 1).alias("model"),
        F.regexp_extract("series", pattern, 2).alias("target"),
        F.col("pred").cast("double").alias("pred"),
    )


def append_predictions(preds: DataFrame, path: str) -> None:
    """Add or replace the partitions of the models in ``preds``; reruns are idempotent."""
    (
        preds.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def drop_prediction(preds: DataFrame, model: str, target: str) -> DataFrame:
    return preds.where((F.col("model") != model) | (F.col("target") != target))


def strip_model_prefix(preds: DataFrame, prefix: str) -> DataFrame:
    bare = F.when(F.startswith(F.col("model"), F.lit(prefix)), F.substr(F.col("model"), F.lit(len(prefix) + 1)))
    return preds.withColumn("model", F.coalesce(bare, F.col("model")))


def models_named(preds: DataFrame, part: str, keep: bool = True) -> DataFrame:
    hit = F.contains(F.col("model"), F.lit(part))
    return preds.where(hit if keep else ~hit)
