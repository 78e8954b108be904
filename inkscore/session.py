"""Session-wide helpers: shared storage, lineage cuts and measured sizes."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A local session that names none gets a temporary folder; on a cluster that is an error, because its machines do
    not share one.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="inkscore-")
    return _fallback[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/inkscore/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to shared storage and read back.

    Used where a table is read several times or drives a loop. It survives lost
    executors, keeps column statistics for the planner and prunes on re-reads.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts reach Python in Arrow batches of about 4 MB, not of Spark's 64 MB, in whatever runs inside.

    Each task holds a batch several times, in Spark and in Python, and Python's workers keep what they once needed for
    later steps. Batches of narrow rows keep their number of rows.
    """
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, "4m")
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def in_small_batches(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``step(docs, ...)`` inside ``small_batches``; what it returns but has not run yet gets the session's own batches again."""

    @functools.wraps(step)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        with small_batches(docs.sparkSession):
            return step(docs, *args, **more)

    return run


def text_once(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(row, text) of ``docs`` for a step in Python, and the struct of all columns of ``docs`` made of these two.

    A text of type string stands beside the others, not in ``row`` too, so it reaches Python and comes back once.
    """
    away = docs.schema["text"].dataType == T.StringType() and len(docs.columns) > 1
    others = [c for c in docs.columns if not (away and c == "text")]
    whole = F.struct(*[F.col("text") if away and c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").cast("string").alias("text")), whole


def spread(df: DataFrame, *keys: str, rows: int, rows_per_task: int = 5000) -> DataFrame:
    """Hash rows over enough tasks ahead of steps that multiply rows or burn CPU.

    ``rows`` is the known size of the table that drives the step. The session's
    shuffle partitions are the ceiling, its task slots the floor. A partition count
    given in numbers is kept by adaptive execution, which would otherwise merge the
    partitions of a table that is still small at this point.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    ceiling = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slots)
    return df.repartition(max(slots, min(ceiling, -(-rows // rows_per_task))), *keys)


def _width(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(column, "")) + F.size(column) * 24, F.lit(0))
        return F.coalesce(F.size(column) * 64, F.lit(0))
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Approximate in-memory size of a table, by one aggregate over its rows."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(16))
    return df.select(width.cast("bigint").alias("width")).agg(F.sum("width")).first()[0] or 0
