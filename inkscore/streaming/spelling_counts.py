"""Spelling counts of a stream of answers against a dictionary that stands still.

Every micro-batch is the batch job of ``operators.spelling`` on its answers and writes a partition of its own number, which
it overwrites. Spark gives a batch that is repeated, after a failure or a lost driver, the number and the rows that it had,
so a repeat replaces what it wrote before and no answer is counted twice; no other state is held. An answer that comes again
in a later batch replaces its earlier count when the counts are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import spelling
from ..session import spread

BatchWriter = Callable[[DataFrame, int], None]


def batch_writer(dictionary: DataFrame, path: str, key: str = "student_id") -> BatchWriter:
    """Writes the counts of a batch to ``path``; ``dictionary`` is a written table, passages included.

    A batch may have fewer files than the cluster has task slots, so its answers are dealt to all of them by ``key``, which
    also keeps the words of an answer together.
    """

    def write(answers: DataFrame, number: int) -> None:
        dealt = spread(answers, key, rows=answers.count())
        counted = spelling.spelling_errors(dealt, dictionary, key)
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def start(answers: DataFrame, write: BatchWriter, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Count what is there and end, or go on as answers come."""
    stream = answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def read_counts(spark: SparkSession, path: str, key: str = "student_id") -> DataFrame:
    """(key, spelling_errors): the latest count of each answer, none if no batch was written; answers without key count as one."""
    schema, folder = f"{key} string, spelling_errors bigint, batch int", spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    written = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return written.groupBy(key).agg(F.max_by("spelling_errors", "batch").alias("spelling_errors"))
