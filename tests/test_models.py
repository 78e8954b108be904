"""Fold models on a small table with a known signal."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkscore.config import RunConfig
from inkscore.operators import blend, boosting, folds, metrics, models, ridge
from inkscore.plans import training
from inkscore.session import materialise, scratch_path
from inkscore.sources.schemas import TARGETS

CONFIG = RunConfig(n_splits=3, boost_rounds=8, hash_features=64, regularisation=0.05, step_size=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    """Content follows how often "good" is said, wording how many words there are."""
    rng = random.Random(1)
    made = []
    for i in range(180):
        good, other = rng.randint(0, 4), rng.randint(0, 8)
        text = " ".join(["good"] * good + ["word"] * other)
        made.append((str(i), f"p{i % 9}", "T", "Q", text, float(good + other), float(good), float(good), float(other)))
    schema = (
        "student_id string, prompt_id string, prompt_title string, prompt_question string, fixed_summary_text string,"
        " summary_length double, f2 double, content double, wording double"
    )
    return materialise(folds.group_kfold(spark.createDataFrame(made, schema), "prompt_id", 3), "rows")


def baseline(rows):
    return metrics.pooled(
        rows.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in TARGETS])))
        .withColumn("pred", F.when(F.col("target") == "content", F.lit(2.0)).otherwise(F.lit(4.0)))
    ).first()["mcrmse"]


def covers_each_row_once(held_out, rows):
    return held_out.groupBy("student_id", "target").count().where("count <> 1").count() == 0 and held_out.count() == 2 * rows.count()


def test_folds_do_not_share_passages(rows):
    assert rows.groupBy("prompt_id").agg(F.countDistinct("fold").alias("n")).where("n <> 1").count() == 0
    assert folds.train_rows(rows, 0).count() + folds.valid_rows(rows, 0).count() == rows.count()


def test_stage1_held_out_storage_and_test_mean(spark, rows):
    table, fitted = training.stage1(rows, CONFIG)
    assert set(fitted) == {(t, k) for t in TARGETS for k in range(3)}
    held_out = models.predict_held_out(table, fitted, CONFIG)
    assert covers_each_row_once(held_out, rows)
    assert training.pooled_score(held_out) < 0.5 * baseline(rows)

    root = scratch_path(spark, "models")
    models.save_models(fitted, root, "r")
    models.save_models(fitted, root, "r")
    again = models.predict_held_out(table, models.load_models(root, "r"), CONFIG)
    assert training.pooled_score(again) == pytest.approx(training.pooled_score(held_out))

    test = training.stage1_table(rows, CONFIG, ["student_id"])
    mean = models.predict_mean(test, fitted, CONFIG)
    assert mean.columns == ["student_id", *TARGETS] and mean.count() == rows.count()
    assert mean.where("content IS NULL OR wording IS NULL").count() == 0


def test_ridge_equals_linear_regression(spark):
    """The same tf-idf weights, standardised, by the normal equations of Spark, for every fold, strength and target."""
    from pyspark.ml.feature import IDF
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.ml.regression import LinearRegression
    from pyspark.sql.types import StructField, StructType

    rng, features = random.Random(3), 24
    made = []
    for i in range(150):
        slots = [rng.randint(0, features - 3) for _ in range(rng.randint(0, 12))] + [features - 1]  # one slot in all rows, one in none
        made.append((str(i), i % 3, slots, float(slots.count(2) + rng.random()), 5.0 * slots.count(3) - len(slots) + rng.random()))
    schema = "student_id string, fold int, slots array<int>, content double, wording double"
    train = materialise(spark.createDataFrame(made, schema), "ridge").repartition(3)
    got = ridge.solve(ridge.gram(train, features), features, 3, [0.03, 1.0]).collect()
    assert len(got) == 12
    vectors = [(r[1], Vectors.dense([float(r[2].count(k)) for k in range(features)]), r[3], r[4]) for r in made]
    base = spark.createDataFrame([(f, c, w) for f, _, c, w in vectors], "fold int, content double, wording double")
    fields = StructType([*base.schema.fields, StructField("counts", VectorUDT())])
    table = spark.createDataFrame([(f, c, w, v) for f, v, c, w in vectors], fields)
    for fold in range(3):
        rows = table.where(F.col("fold") != fold)
        weighting = IDF(inputCol="counts", outputCol="weighted").fit(rows)
        ready = weighting.transform(rows).cache()
        for r in (r for r in got if r["fold"] == fold):
            fitted = LinearRegression(featuresCol="weighted", labelCol=r["target"], regParam=r["strength"], solver="normal").fit(ready)
            want = fitted.coefficients.toArray() * weighting.idf.toArray()
            assert max(abs(want - r["weights"])) < 1e-6 and r["intercept"] == pytest.approx(fitted.intercept, abs=1e-6)


def test_sweep_costs_one_pass_and_equals_single_runs(rows):
    table = models.by_fold(training.stage1_table(rows, CONFIG, ["student_id", *TARGETS, "fold"]), "swept")
    tried = {r["value"]: r["mcrmse"] for r in models.sweep_strengths(table, CONFIG, [0.1, 5.0]).collect()}
    for value, error in tried.items():
        config = replace(CONFIG, regularisation=value)
        held_out = models.predict_held_out(table, models.fit_stage1(table, config), config)
        assert training.pooled_score(held_out) == pytest.approx(error, abs=1e-9)
    assert tried[0.1] < tried[5.0]


def test_stage1_reads_whole_texts(spark):
    """The signal stands behind 600 other tokens."""
    made = [(str(i), i % 3, "w " * 600 + "good " * (i % 5), float(i % 5), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(made, "student_id string, fold int, input string, content double, wording double")
    config = RunConfig(n_splits=3, hash_features=700, regularisation=0.01)
    table = models.by_fold(ridge.token_slots(df, config).drop("input"), "long")
    held_out = models.predict_held_out(table, models.fit_stage1(table, config), config)
    assert training.pooled_score(held_out) < 0.3
    with pytest.raises(ValueError):
        ridge.gram(table, 100_000)


def vectors_of(rows):
    vectors = models.assemble(rows, ["summary_length", "f2"]).select("student_id", *TARGETS, "fold", "vector")
    return models.by_fold(vectors, "vectors")


def test_boosting_stops_early_and_beats_the_mean(spark, rows):
    table, config = vectors_of(rows), replace(CONFIG, boost_rounds=30, patience=4)
    fitted = models.fit_boosted(table, config)
    held_out = models.predict_held_out(table, fitted, config)
    assert covers_each_row_once(held_out, rows)
    assert training.pooled_score(held_out) < 0.3 * baseline(rows)
    assert all(0 < m.n_trees <= config.boost_rounds for m in fitted.values())
    history = materialise(models.eval_history(rows.sparkSession, fitted), "history")
    best = {(r["fold"], r["target"]): r["mse"] for r in models.best_rounds(history).collect()}
    for (fold, target), mse in best.items():
        errors = [r["mse"] for r in history.where((F.col("fold") == fold) & (F.col("target") == target)).orderBy("round").collect()]
        assert mse == min(errors) and fitted[(target, fold)].n_trees == errors.index(mse) + 1
        assert len(errors) == config.boost_rounds or len(errors) - 1 - errors.index(mse) == config.patience
        own = held_out.where((F.col("fold") == fold) & (F.col("target") == target))
        assert own.agg(F.avg((F.col("pred") - F.col("y")) ** 2)).first()[0] == pytest.approx(mse)
    root = scratch_path(spark, "models")
    models.save_models(fitted, root, "b")
    again = models.predict_held_out(table, models.load_models(root, "b"), config)
    assert training.pooled_score(again) == pytest.approx(training.pooled_score(held_out))


def test_boosting_continues_where_it_stopped(rows):
    """Errors of continued fits, in blocks of rounds or level by level, equal those of one long fit."""
    names = ["f0", "f1"]
    table = vectors_of(rows)
    cuts = boosting.cut_points(table.select(*[F.get("vector", F.lit(k)).alias(n) for k, n in enumerate(names)]), names)
    pairs = [(t, k) for t in TARGETS for k in range(3)]
    long = models.boosted_rows(boosting.binned(table.select("fold", *TARGETS, "vector"), cuts), pairs)
    whole = boosting.Boosting(long, cuts, CONFIG, block=100)
    whole.advance(12)
    want = {m: b.errors for m, b in whole.boosters.items()}
    assert len(want) == 6 and all(len(e) == 12 and min(e) < e[0] for e in want.values())
    for options in ({"block": 5}, {"block": 2, "task_cells": 0}):
        parts = boosting.Boosting(long, cuts, CONFIG, **options)
        parts.advance(3)
        parts.advance(9)
        for m, errors in want.items():
            assert parts.boosters[m].errors == pytest.approx(errors, abs=1e-9)


def test_blocks_grow_with_the_rounds(rows, monkeypatch):
    """The table is written a number of times that grows with the logarithm of the rounds."""
    cuts = [np.array([0.5, 1.5, 2.5])]
    binned = boosting.binned(rows.select("fold", *TARGETS, F.array("f2").alias("vector")), cuts)
    grown = boosting.Boosting(models.boosted_rows(binned, [("content", 0)]), cuts, CONFIG, block=2)
    blocks, own = [], grown._block
    monkeypatch.setattr(grown, "_block", lambda rounds, patience: (blocks.append(rounds), own(rounds, patience)))
    grown.advance(30)
    assert blocks == [2, 4, 8, 16] and len(grown.boosters[0].errors) == 30


def test_boosters_of_a_run_have_a_task_each(spark):
    for boosters in (range(8), range(16, 24), range(3, 30, 9)):
        tasks = boosting.tasks_apart(spark, list(boosters))
        rows = spark.createDataFrame([(m,) for m in boosters] * 5, "booster int").repartition(tasks, "booster")
        assert rows.select("booster", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count_distinct("booster").alias("n")).where("n > 1").count() == 0


def test_sums_by_node_feature_and_bin_hold_nothing_of_all_cells():
    import tracemalloc

    rng = np.random.default_rng(3)
    bins, at, residual = rng.integers(0, 8, (20_000, 40)), rng.integers(0, 2, 20_000), rng.normal(size=20_000)
    columns = boosting._columns(bins.astype(np.uint8))
    tracemalloc.start()
    count, total = boosting._sums(columns, at, residual, (2, 40, 8)).reshape(2, 2, 40, 8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < bins.size * 8 / 4
    for node, feature, b in ((0, 0, 0), (1, 39, 7), (0, 17, 3)):
        here = (at == node) & (bins[:, feature] == b)
        assert count[node, feature, b] == here.sum() and abs(total[node, feature, b] - residual[here].sum()) < 1e-9


def test_patience_outlasts_a_slow_start():
    errors = [1.0, 0.9995, 0.999, 0.6, 0.7, 0.65, 0.5, 0.5, 0.6, 0.7]
    assert boosting.stopped(errors, 3) and not boosting.stopped(errors, 4) and not boosting.stopped(errors, None)
    assert boosting.stopped([1.0, 1.0, 1.1], 2) and not boosting.stopped([1.0, 1.0], 2)


def test_race_of_trials(spark, rows, monkeypatch):
    """Trials whose blend holds the better model stay longest; every rung of a trial goes on from the last."""
    monkeypatch.setattr(training.ft, "numeric_features", lambda df, feature_set, stacked=(): ["summary_length"])
    truth = rows.select("student_id", F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in TARGETS])))
    noise = F.pmod(F.xxhash64("student_id", "target"), F.lit(1000)) / 100.0
    preds = truth.select("student_id", "target", F.explode(F.array(F.struct(F.lit("good").alias("model"), F.col("y").alias("pred")), F.struct(F.lit("poor").alias("model"), noise.alias("pred")))).alias("m"))
    preds = materialise(preds.select("student_id", "target", "m.model", "m.pred"), "preds")
    weights = [(n, m, w) for n in range(8) for m, w in (("good", 1.0 if n in (2, 5) else 0.0), ("poor", 0.0 if n in (2, 5) else 1.0 + n))]
    trials = spark.createDataFrame([*weights, (8, "good", 1.0), (8, "poor", -1.0)], "trial int, model string, weight double")
    cells = blend.gram(blend.to_matrix(preds, truth, ["good", "poor"], "student_id"), ["good", "poor"])
    made = training.race(rows, cells, preds, trials, replace(CONFIG, boost_rounds=12, patience=5), "basic", first_rounds=2, finalists=2)
    lines = {(r["trial"], r["rung"]): r for r in made.collect()}
    assert {t for t, _ in lines} == set(range(8))  # weights that sum to zero make no trial
    last = max(r for _, r in lines)
    assert {t for t, r in lines if r == last} == {2, 5} and last == 2
    assert all(lines[t, r]["mcrmse"] <= lines[t, r - 1]["mcrmse"] and lines[t, r]["rounds"] > lines[t, r - 1]["rounds"] for t, r in lines if r)
    assert lines[2, 0]["blend_mcrmse"] == pytest.approx(0.0) and lines[2, 2]["mcrmse"] < 0.5 * lines[0, 0]["mcrmse"]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None)], "a double, b double, c double")
    got = [r["m"] for r in df.select(models.row_mean([F.col("a"), F.col("b"), F.col("c")]).alias("m")).collect()]
    assert got == [2.5, None]


def test_stacking(spark, rows):
    preds = spark.createDataFrame([("1", "content", 0.25), ("1", "wording", 0.75)], "student_id string, target string, pred double")
    stacked = {r["student_id"]: (r["content_pred"], r["wording_pred"]) for r in models.stack(rows, preds).collect()}
    assert stacked.pop("1") == (0.25, 0.75) and len(stacked) == rows.count() - 1 and set(stacked.values()) == {(None, None)}


def test_blend_run(spark, rows, monkeypatch):
    """Models read the table that their name asks for; the blend, stage two and the table of runs follow from them."""
    monkeypatch.setattr(training.ft, "numeric_features", lambda df, feature_set, stacked=(): ["summary_length", *stacked])
    train = rows.drop("fold")
    test = train.drop(*TARGETS).withColumn("student_id", F.concat(F.lit("t"), "student_id"))
    silent = [df.withColumn("fixed_summary_text", F.lit("nothing")) for df in (train, test)]
    configs = [replace(CONFIG, run_name="good"), replace(CONFIG, run_name="strong", regularisation=5.0), replace(CONFIG, run_name="poor_silent")]
    runs = scratch_path(spark, "runs")
    given = {"": (train, test), "silent": tuple(silent)}
    made = training.blend_run(given, configs, n_trials=20, runs=runs)
    board = {r["model"]: r["mcrmse"] for r in made["leaderboard"].collect()}
    assert set(board) == {"good", "strong", "poor_silent"}
    assert board["good"] < 0.5 * board["poor_silent"] and board["poor_silent"] > 0.9 * baseline(rows)
    found = {r["trial"]: r["mcrmse"] for r in made["search"].collect()}
    assert [found[20 + n] for n in range(3)] == pytest.approx([board[c.run_name] for c in configs])
    best = min(found.values())
    assert best <= min(board.values()) + 1e-12
    assert metrics.mcrmse(made["blend_oof"]).first()["mcrmse"] == pytest.approx(best, abs=1e-9)
    assert covers_each_row_once(made["stage2_oof"], rows)
    assert made["submission"].select("student_id").distinct().count() == made["submission"].count() == rows.count()
    assert made["submission"].where("content IS NULL OR wording IS NULL").count() == 0
    training.blend_run(given, configs, n_trials=20, runs=runs)
    kept = {r["run_name"]: r["mcrmse"] for r in spark.read.parquet(runs).collect()}
    assert spark.read.parquet(runs).count() == 4 and set(kept) == {*board, "stacked"}
    assert kept["good"] == pytest.approx(board["good"])


def test_blend_run_refuses_unclear_settings(rows):
    with pytest.raises(ValueError):
        training.blend_run({"": (rows, rows)}, [CONFIG, CONFIG])
    with pytest.raises(ValueError):
        training.blend_run({"clean": (rows, rows)}, [CONFIG])


def test_table_of_a_model():
    tables = {"": 1, "clean": 2, "clean_text": 3}
    assert [training.table_of(tables, n) for n in ("a", "a_clean", "a_clean_text")] == [1, 2, 3]


def test_lexicons_are_told_apart():
    from inkscore.functions.lexicons import Lexicon

    first, second = Lexicon([("a", 1.0, 0.0, 0.0)]), Lexicon([("a", 0.5, 0.0, 0.0)])
    assert repr(first) == repr(Lexicon([("a", 1.0, 0.0, 0.0)])) != repr(second)


def grown_plainly(bins, label, config, rounds, n_bins):
    """Trees by sums over all rows on every level."""
    columns, residual, out = boosting._columns(bins), label.copy(), []
    for _ in range(rounds):
        tree = boosting._empty_tree(config.max_depth)
        for level in range(config.max_depth):
            shape = 2**level, bins.shape[1], n_bins
            sums = boosting._sums(columns, boosting.walk(columns, tree, shape[0]), residual, shape)
            boosting._put(tree, level, config.max_depth, boosting._best_cuts(sums, shape, config.min_instances, config.l2), config.step_size)
        residual = residual - boosting.grown(bins, [tree])
        out.append(tree)
    return out


@pytest.mark.parametrize("wide, depth, rounds", [(7, 3, 90), (6, 1, 5), (1, 4, 5)])
def test_trees_read_only_the_smaller_children(wide, depth, rounds, monkeypatch):
    """The same trees as from sums over all rows; a level reads half of the rows at most, the first one none but at first."""
    rng = np.random.default_rng(7)
    bins = np.minimum(rng.integers(0, 12, (600, wide)), rng.integers(1, 12, wide)).astype(np.uint8)
    if wide > 6:
        bins[:, 5] = bins[:, 2]  # equal gains go to the first feature
    label, config = bins[:, 0] * 0.5 + (bins[:, -1] > 3) * rng.normal(size=600), RunConfig(max_depth=depth)
    reads, own = [], boosting.Columns.sums

    def counted(self, rows, *weights):
        reads.append(len(label) if rows is None else len(rows))
        return own(self, rows, *weights)

    monkeypatch.setattr(boosting.Columns, "sums", counted)
    grower = boosting.Grower(boosting.Columns(bins, 40), label.copy(), config)
    made = [grower.grow() for _ in range(rounds)]
    want = grown_plainly(bins, label, config, rounds, 40)
    for a, b in zip(made, want, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-9)
    assert np.allclose(grower.residual, label - boosting.grown(bins, want))
    assert sum(reads) <= len(label) * (rounds * depth / 2 + 1 + rounds // boosting._SUMMED_ANEW)


def test_a_block_of_rounds_is_grown_once(rows, tmp_path, monkeypatch):
    """Spark must not run a block a second time to learn how its trees are to be sorted."""
    table = vectors_of(rows)
    cuts = boosting.cut_points(table.select(F.get("vector", F.lit(0)).alias("f0"), F.get("vector", F.lit(1)).alias("f1")), ["f0", "f1"])
    long = models.boosted_rows(boosting.binned(table.select("fold", *TARGETS, "vector"), cuts), [("content", 0)])
    grown = boosting.Boosting(long, cuts, CONFIG)
    plan, own = [], type(long).collect
    monkeypatch.setattr(type(long), "collect", lambda df: (plan.append(df._jdf.queryExecution().executedPlan().toString()), own(df))[1])
    grown.advance(3)
    assert len(grown.boosters[0].errors) == 3 and plan and not any("rangepartitioning" in p for p in plan)
