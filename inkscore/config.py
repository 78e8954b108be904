"""Run configuration, as a value and as a one-row table."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run. Defaults are the published settings of the task.

    ``boost_rounds`` bounds the number of trees; boosting stops once the held-out error has not fallen for ``patience``
    rounds. ``max_length`` is the number of tokens that the text regressor reads; 0 reads all.
    """

    run_name: str = "base"
    n_splits: int = 4
    seed: int = 42
    max_length: int = 0
    hash_features: int = 4096
    regularisation: float = 1.0
    step_size: float = 0.048
    max_depth: int = 3
    l2: float = 0.011
    boost_rounds: int = 10000
    patience: int = 70
    min_instances: int = 5
    separator: str = "[SEP]"

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(self)])
