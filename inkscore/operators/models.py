"""Stage-one text regressors, stage-two boosted trees, stacking, sweeps and storage.

Training data is written once to shared storage; the models of all folds and targets come from the same passes over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..session import materialise, scratch_path
from ..sources.schemas import TARGETS
from . import boosting, ridge

FoldModels = Mapping[tuple[str, int], Any]


def by_fold(df: DataFrame, label: str) -> DataFrame:
    """Write the training rows once, partitioned by fold, and read them back."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy("fold").parquet(path)
    schema = df.schema
    back = df.sparkSession.read.schema(schema).parquet(path)
    return back.select(*df.columns)


def fit_stage1(train: DataFrame, config: RunConfig, targets: Sequence[str] = TARGETS) -> FoldModels:
    """One text regressor per (target, fold), each fitted on the other folds; ``train`` has fold, slots and the targets."""
    products = ridge.gram(train, config.hash_features, targets)
    return ridge.text_models(ridge.solve(products, config.hash_features, config.n_splits, [config.regularisation], targets))


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature array from named columns; undefined ratios count as 0."""
    return df.withColumn("vector", F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns]))


class BoostedModels(dict):
    """Boosters by (target, fold), with the held-out error after each round until boosting stopped."""

    def __init__(self, models: Mapping[tuple[str, int], boosting.Booster]):
        super().__init__(models)
        self.errors = {key: b.errors for key, b in models.items()}


def boosted_rows(binned: DataFrame, pairs: Sequence[tuple[str, int]], first: Column | int = 0) -> DataFrame:
    """A row for each booster and row of (fold, bins, targets); boosters are numbered from ``first`` on, as in ``pairs``."""
    entries = [F.struct((F.col("fold") == fold).alias("held"), F.col(target).cast("double").alias("y")) for target, fold in pairs]
    rows = binned.select(F.lit(first).alias("_first"), "bins", F.posexplode(F.array(*entries)).alias("_k", "_e"))
    return rows.select((F.col("_first") + F.col("_k")).alias("booster"), "_e.held", "_e.y", "bins").dropna(subset=["held", "y"])


def fit_boosted(train: DataFrame, config: RunConfig, targets: Sequence[str] = TARGETS) -> BoostedModels:
    """Boosted trees per (target, fold), with as many rounds as the held-out fold finds best.

    ``train`` has columns fold, vector and the targets. All boosters grow side by side until their best round lies
    ``patience`` rounds back.
    """
    pairs = [(t, k) for t in targets for k in range(config.n_splits)]
    first = train.select(F.size("vector")).first()
    names = [f"f{k}" for k in range(first[0] if first else 0)]
    cuts = boosting.cut_points(train.select(*[F.get("vector", F.lit(k)).alias(n) for k, n in enumerate(names)]), names)
    rows = boosting.binned(train.select("fold", *targets, "vector"), cuts)
    grown = boosting.Boosting(boosted_rows(rows, pairs), cuts, config)
    grown.advance(config.boost_rounds, config.patience)
    result = grown.result()
    return BoostedModels({pair: result[m] for m, pair in enumerate(pairs) if m in result})


def predict_held_out(
    train: DataFrame, models: FoldModels, config: RunConfig, row_id: str = "student_id", targets: Sequence[str] = TARGETS
) -> DataFrame:
    """(row_id, target, fold, pred, y): every row scored by the models that never saw it."""
    scored = score_all(train, models, [(t, k) for t in targets for k in range(config.n_splits)])
    entries = [
        F.struct(
            F.lit(t).alias("target"),
            F.get(F.array(*[F.col(f"{t}_pred_{k}") for k in range(config.n_splits)]), F.col("fold").cast("int")).alias("pred"),
            F.col(t).alias("y"),
        )
        for t in targets
    ]
    return scored.select(row_id, F.col("fold").cast("int").alias("fold"), F.inline(F.array(*entries))).select(row_id, "target", "fold", "pred", "y")


def score_all(df: DataFrame, models: FoldModels, which: Sequence[tuple[str, int]]) -> DataFrame:
    """All models in one pass over the rows, a column ``{target}_pred_{fold}`` each."""
    named = {f"{t}_pred_{k}": models[(t, k)] for t, k in which}
    return boosting.score(df, named) if isinstance(next(iter(named.values())), boosting.Booster) else ridge.score(df, named)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over columns of one row, NULLs skipped: no grouping, no shuffle."""
    kept = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept).cast("double"))


def predict_mean(
    test: DataFrame, models: FoldModels, config: RunConfig, row_id: str = "student_id", targets: Sequence[str] = TARGETS
) -> DataFrame:
    """(row_id, one column per target): mean over all fold models, in a single pass."""
    which = [(t, k) for t in targets for k in range(config.n_splits)]
    scored = score_all(test, models, which)
    return scored.select(
        row_id,
        *[row_mean([F.col(f"{t}_pred_{k}") for k in range(config.n_splits)]).alias(t) for t in targets],
    )


def stack(features: DataFrame, preds: DataFrame, row_id: str = "student_id", targets: Sequence[str] = TARGETS) -> DataFrame:
    """Add ``{target}_pred`` columns from long predictions, matched by key; rows without predictions stay, with NULL."""
    wide = preds.groupBy(row_id).agg(
        *[F.max(F.when(F.col("target") == t, F.col("pred"))).alias(f"{t}_pred") for t in targets]
    )
    return features.join(wide, row_id, "left")


def eval_history(spark: SparkSession, models: BoostedModels) -> DataFrame:
    """(fold, target, round, mse) of the held-out fold after each boosting round until the stop."""
    rows = [(fold, target, n, float(e)) for (target, fold), errors in models.errors.items() for n, e in enumerate(errors, 1)]
    return spark.createDataFrame(rows, "fold int, target string, round int, mse double")


def best_rounds(history: DataFrame) -> DataFrame:
    """The round with the lowest held-out error per fold and target, ties to the earlier."""
    return history.groupBy("fold", "target").agg(
        F.min_by("round", F.struct("mse", "round")).alias("round"), F.min("mse").alias("mse")
    )


def sweep_strengths(train: DataFrame, config: RunConfig, strengths: Sequence[float], targets: Sequence[str] = TARGETS) -> DataFrame:
    """(trial, value, mcrmse) of every regularisation strength: all folds, strengths and targets from one pass.

    ``train`` has a row id, fold, slots and the targets. The strengths' models are scored side by side in a second pass.
    """
    solved = materialise(ridge.solve(ridge.gram(train, config.hash_features, targets), config.hash_features, config.n_splits, strengths, targets), "sweep")
    named = {}
    for n, strength in enumerate(strengths):
        for (target, fold), model in ridge.text_models(solved.where(F.col("strength") == strength)).items():
            named[f"{n}_{target}_{fold}"] = model
    scored = ridge.score(train.select("fold", "slots", *targets), named)

    def error(n: int, target: str) -> Column:
        own = F.get(F.array(*[F.col(f"{n}_{target}_{k}") for k in range(config.n_splits)]), F.col("fold").cast("int"))
        return F.sqrt(F.avg((own - F.col(target)) * (own - F.col(target))))

    errors = scored.agg(*[error(n, t).alias(f"{n}_{t}") for n in range(len(strengths)) for t in targets])
    entries = [
        F.struct(F.lit(n).alias("trial"), F.lit(float(v)).alias("value"), (sum(F.col(f"{n}_{t}") for t in targets) / len(targets)).alias("mcrmse"))
        for n, v in enumerate(strengths)
    ]
    return errors.select(F.inline(F.array(*entries)))


def save_models(models: FoldModels, root: str, run: str) -> None:
    """Store text regressors or boosters as one table of a run; an earlier run of the same name is replaced."""
    spark = SparkSession.active()
    boosted = isinstance(next(iter(models.values())), boosting.Booster)
    table = boosting.to_table(spark, models) if boosted else ridge.to_table(spark, models)
    table.write.mode("overwrite").parquet(f"{root}/run={run}")


def load_models(root: str, run: str) -> FoldModels:
    table = SparkSession.active().read.parquet(f"{root}/run={run}")
    return BoostedModels(boosting.from_table(table)) if "feature" in table.columns else ridge.text_models(table)
