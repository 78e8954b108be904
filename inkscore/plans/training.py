"""Training, stacking and prediction end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import blend, boosting, folds, metrics, models, ridge
from ..session import materialise
from ..sources.schemas import TARGETS
from . import features as ft


def stage1_table(df: DataFrame, config: RunConfig, keep: Sequence[str]) -> DataFrame:
    """Model input hashed to slots; only the columns the fits need survive."""
    ready = df.withColumn("input", ft.model_input(config.separator))
    return ridge.token_slots(ready, config).select(*keep, "slots")


def stage1(train: DataFrame, config: RunConfig, key: str = "student_id"):
    """(table, fold models) of the text regressors; ``train`` carries a fold."""
    table = models.by_fold(stage1_table(train, config, [key, *TARGETS, "fold"]), "stage1")
    return table, models.fit_stage1(table, config)


def boosted(train: DataFrame, config: RunConfig, feature_set: str, stacked: tuple[str, ...] = (), key: str = "student_id"):
    """(table, fold models) of the boosted trees over the numeric features."""
    columns = ft.numeric_features(train, feature_set, stacked)
    vectors = models.assemble(train, columns).select(key, *TARGETS, "fold", "vector")
    table = models.by_fold(vectors, "stage2")
    return table, models.fit_boosted(table, config)


def pooled_score(held_out: DataFrame) -> float:
    return metrics.pooled(held_out).first()["mcrmse"]


def stage2(train: DataFrame, test: DataFrame, config: RunConfig, feature_set: str, key: str = "student_id") -> tuple[DataFrame, DataFrame]:
    """(held-out predictions, test predictions) of the boosted trees over tables that carry the stacked predictions."""
    names = tuple(f"{t}_pred" for t in TARGETS)
    table, boosters = boosted(train, config, feature_set, names, key)
    held_out = materialise(models.predict_held_out(table, boosters, config, key), "stage2-oof")
    vectors = models.assemble(test, ft.numeric_features(test, feature_set, names)).select(key, "vector")
    return held_out, models.predict_mean(vectors, boosters, config, key)


def run(train: DataFrame, test: DataFrame, config: RunConfig, feature_set: str = "enriched") -> dict[str, DataFrame]:
    """The whole task: folds, stage one, stacking, stage two, report and test predictions.

    ``train`` and ``test`` are feature tables; ``train`` also has the targets.
    """
    train = materialise(folds.group_kfold(train, "prompt_id", config.n_splits, spread_by="student_id"), "train")
    test = materialise(test, "test")
    table1, text_models = stage1(train, config)
    stage1_oof = materialise(models.predict_held_out(table1, text_models, config), "stage1-oof")
    test1 = models.predict_mean(stage1_table(test, config, ["student_id"]), text_models, config)

    test_stacked = test.join(test1.withColumnsRenamed({t: f"{t}_pred" for t in TARGETS}), "student_id")
    stage2_oof, submission = stage2(models.stack(train, stage1_oof), test_stacked, config, feature_set)
    spark = train.sparkSession
    return {
        "stage1_oof": stage1_oof,
        "stage2_oof": stage2_oof,
        "report": metrics.run_report(stage2_oof, config.to_frame(spark)),
        "submission": submission,
    }


def table_of(tables: Mapping[str, tuple[DataFrame, DataFrame]], name: str) -> tuple[DataFrame, DataFrame]:
    """The train and test tables whose mark the model's name holds; the longest mark wins, the empty one fits all names."""
    return tables[max((mark for mark in tables if mark in name), key=len)]


def blend_trials(spark: SparkSession, names: Sequence[str], n_trials: int, seed: int) -> DataFrame:
    """``n_trials`` drawn weights, then each model alone and their plain mean, so that no blend is chosen that is worse."""
    drawn = blend.sampled_trials(spark, names, n_trials, seed=seed)
    plain = [(n_trials + i, m, float(i == len(names) or m == names[i])) for i in range(len(names) + 1) for m in names]
    return drawn.unionByName(spark.createDataFrame(plain, "trial int, model string, weight double"))


def blend_run(
    tables: Mapping[str, tuple[DataFrame, DataFrame]],
    configs: Sequence[RunConfig],
    feature_set: str = "enriched",
    n_trials: int = 70,
    seed: int = 42,
    runs: str | None = None,
    key: str = "student_id",
) -> dict[str, DataFrame]:
    """Several stage-one models, the search of their weights, the best blend on both sides, stage two and its predictions.

    ``tables`` has (train, test) feature tables by mark: a model reads the pair whose mark its name holds, so models on cleaned
    and on plain texts stand side by side; the pair under "" serves all others and stage two. All pairs hold the same answers.
    Groups get the same folds in every table, as folds follow from group sizes and keys alone. Predictions of all models are
    one written table (model, key, target, fold, pred, y). Ties of trials go to the first.

    With ``runs`` each model and the stacked run keep their line in the table of runs at that path; a rerun replaces them.
    """
    names = [c.run_name for c in configs]
    if len(set(names)) < len(names) or len({c.n_splits for c in configs}) != 1:
        raise ValueError("runs need names of their own and one number of folds")
    if "" not in tables:
        raise ValueError('tables need a pair under ""')
    spark = tables[""][0].sparkSession
    ready = {
        mark: (materialise(folds.group_kfold(train, "prompt_id", configs[0].n_splits, spread_by=key), "train"), materialise(test, "test"))
        for mark, (train, test) in tables.items()
    }
    held_out, predicted = [], []
    for config in configs:  # a model each
        train, test = table_of(ready, config.run_name)
        table, fitted = stage1(train, config, key)
        name = F.lit(config.run_name).alias("model")
        held_out.append(models.predict_held_out(table, fitted, config, key).select(name, "*"))
        means = models.predict_mean(stage1_table(test, config, [key]), fitted, config, key)
        predicted.append(means.unpivot(key, list(TARGETS), "target", "pred").select(name, "*"))
    oof = materialise(reduce(DataFrame.unionByName, held_out), "models-oof")
    test_preds = materialise(reduce(DataFrame.unionByName, predicted), "models-test")

    train, test = ready[""]
    truth = train.unpivot(key, list(TARGETS), "target", "y")
    trials = materialise(blend_trials(spark, names, n_trials, seed), "trials")
    results = materialise(blend.search_weights(blend.gram(blend.to_matrix(oof, truth, names, key), names), trials), "search")
    weights = materialise(blend.best_trials(results).select("trial").join(trials, "trial").select("model", "weight"), "weights")
    train_blend = materialise(blend.weighted_blend(oof, weights, key), "blend-oof")
    test_blend = materialise(blend.weighted_blend(test_preds, weights, key), "blend-test")

    last = replace(configs[0], run_name="stacked")
    stage2_oof, submission = stage2(models.stack(train, train_blend, key), models.stack(test, test_blend, key), last, feature_set, key)
    reports = {c.run_name: metrics.run_report(oof.where(F.col("model") == c.run_name), c.to_frame(spark)) for c in configs}
    reports[last.run_name] = metrics.run_report(stage2_oof, last.to_frame(spark))
    if runs:
        for report in reports.values():  # a line each
            metrics.keep_run(report, runs)
    return {
        "oof": oof,
        "leaderboard": metrics.leaderboard(oof),
        "search": results,
        "weights": weights,
        "blend_oof": metrics.align(train_blend, truth, key),
        "stage2_oof": stage2_oof,
        "report": reduce(DataFrame.unionByName, reports.values()),
        "submission": submission,
    }


def blended_features(features: DataFrame, preds: DataFrame, trials: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """``features`` once for each trial, with the trial's blend of each target as ``{target}_pred``.

    Predictions are put side by side by one aggregation; each trial's blend is then a product within the row. A blend is
    NULL where a prediction is or the weights sum to zero.
    """
    models_ = [r["model"] for r in trials.select("model").distinct().orderBy("model").collect()]  # a row per model
    slots = [F.max(F.when((F.col("model") == m) & (F.col("target") == t), F.col("pred"))) for t in TARGETS for m in models_]
    wide = preds.groupBy(key).agg(F.array(*slots[: len(models_)]).alias(f"_{TARGETS[0]}"), F.array(*slots[len(models_) :]).alias(f"_{TARGETS[1]}"))
    weights = trials.groupBy("trial").agg(F.array(*[F.coalesce(F.max(F.when(F.col("model") == m, F.col("weight"))), F.lit(0.0)) for m in models_]).alias("w"))
    table = [(r["trial"], list(r["w"])) for r in weights.collect() if abs(sum(r["w"])) >= blend.EPSILON]  # a row per trial
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("trial"), F.array(*[F.lit(x / sum(w)) for x in w]).alias("w")) for t, w in sorted(table)]))
    rows = features.join(wide, key, "left").withColumn("_t", each)

    def blended(target: str):
        return F.aggregate(F.zip_with(F.col("_t.w"), F.col(f"_{target}"), lambda w, p: w * p), F.lit(0.0), lambda a, x: a + x)

    return rows.select(F.col("_t.trial").alias("trial"), *names, *[blended(t).alias(f"{t}_pred") for t in TARGETS])


def race(
    features: DataFrame,
    gram_cells: DataFrame,
    preds: DataFrame,
    trials: DataFrame,
    config: RunConfig,
    feature_set: str,
    first_rounds: int = 16,
    finalists: int = 4,
    key: str = "student_id",
) -> DataFrame:
    """(trial, rung, rounds, mcrmse, blend_mcrmse): stage two on every trial's blend, by successive halving.

    All trials' boosters grow side by side over one table. At each rung the better half of the trials, by pooled held-out
    score, goes on for twice the rounds, from where its boosters stand; the last ``finalists`` run until patience ends.
    A trial has a line for each rung that it reached.
    """
    columns = ft.numeric_features(features, feature_set)
    stacked = [f"{t}_pred" for t in TARGETS]
    slim = materialise(features.select(key, "fold", *TARGETS, *columns), "race-features")
    rows = materialise(blended_features(slim, preds, trials, ["fold", *TARGETS, *columns], key), "race-rows")
    # blends of different trials have different scales: each is replaced by its place among the trial's own quantiles
    steps = [k / boosting.MAX_BINS for k in range(1, boosting.MAX_BINS)]
    own = rows.groupBy("trial").agg(*[F.array_distinct(F.percentile_approx(c, steps, 1000)).alias(f"_{c}") for c in stacked])
    placed = rows.join(F.broadcast(own), "trial")  # a row per trial
    def place(column: str):
        value = F.coalesce(F.col(column), F.lit(0.0))
        below = F.filter(F.coalesce(F.col(f"_{column}"), F.array().cast("array<double>")), lambda end: end < value)
        return F.size(below).cast("double")

    placed = placed.withColumns({c: place(c) for c in stacked})
    cuts = boosting.cut_points(slim, columns) + [np.arange(boosting.MAX_BINS - 1, dtype=np.float64)] * len(stacked)
    pairs = [(t, k) for t in TARGETS for k in range(config.n_splits)]
    bins = boosting.binned(models.assemble(placed, [*columns, *stacked]).select("trial", "fold", *TARGETS, "vector"), cuts)
    grown = boosting.Boosting(models.boosted_rows(bins, pairs, F.col("trial") * len(pairs)), cuts, config)

    def score(trial: int) -> float:
        """Pooled over folds, each booster at its best round so far."""
        total = 0.0
        for n in range(len(TARGETS)):
            mine = [m for m in range(trial * len(pairs) + n * config.n_splits, trial * len(pairs) + (n + 1) * config.n_splits) if m in grown.boosters]
            held = sum(grown.held[m] for m in mine)
            total += (sum(grown.held[m] * min(grown.boosters[m].errors) for m in mine if grown.held[m]) / held) ** 0.5 if held else float("nan")
        return total / len(TARGETS)

    lines, rung, budget = [], 0, first_rounds
    left = sorted({m // len(pairs) for m in grown.boosters})
    while left:
        last = len(left) <= finalists
        grown.advance(config.boost_rounds if last else budget, config.patience)
        scores = sorted((score(trial), trial) for trial in left)
        for value, trial in scores:
            rounds = max(len(b.errors) for m, b in grown.boosters.items() if m // len(pairs) == trial)
            lines.append((trial, rung, rounds, value))
        if last:
            break
        left = [trial for _, trial in scores[: max(finalists, len(scores) // 2)]]
        grown.keep({trial * len(pairs) + k for trial in left for k in range(len(pairs))})
        rung, budget = rung + 1, 2 * budget
    made = features.sparkSession.createDataFrame(lines, "trial int, rung int, rounds int, mcrmse double")
    return made.join(blend.search_weights(gram_cells, trials).withColumnRenamed("mcrmse", "blend_mcrmse"), "trial")
