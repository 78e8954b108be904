"""Joins, metrics, blending, sources and the stream, on hand-made tables."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from inkscore.functions.lexicons import Lexicon
from inkscore.operators import blend, joins, lexicon_join, metrics, scoring
from inkscore.plans import bindings
from inkscore.plans import features as ft
from inkscore.session import materialise, measured_bytes, scratch_path
from inkscore.sources import schemas, tables
from inkscore.streaming.answers import read_answer_stream, stream_features

PROMPTS = [("p1", "Why?", "Title", "The cat sat. It was a big cat."), ("p2", None, "Other", "Dogs bark, loudly.")]
ANSWERS = [
    ("1", "p1", "The cat was big.", 1.0, 2.0),
    ("2", "p2", 'Dogs "bark" a lot', 0.5, 0.5),
    ("3", "gone", "No passage here", None, None),
    ("4", "p1", "", 0.0, 0.0),
    ("5", "p1", "cat sat", 1.0, 1.0),
]


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame(PROMPTS, "prompt_id string, prompt_question string, prompt_title string, prompt_text string")


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(ANSWERS, "student_id string, prompt_id string, text string, content double, wording double")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join_on_a_hot_key(spark, how):
    fact = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    dimension = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    small = joins.lookup_join(fact, dimension, "k", how, spread_by="id")
    large = joins.lookup_join(fact, dimension, "k", how, spread_by="id", broadcast_bytes=0, salts=8)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_salt_spreads_the_hot_key(spark):
    fact = spark.range(4000).select("id", F.lit("hot").alias("k"))
    salts = fact.groupBy(F.pmod(F.xxhash64("id"), F.lit(joins.SALTS))).count().collect()
    assert len(salts) == joins.SALTS and max(r["count"] for r in salts) < 4000 / joins.SALTS * 2
    with pytest.raises(ValueError):
        joins.salted_join(fact, fact, ["k"], "full")


def test_measured_bytes_grow_with_the_table(spark):
    df = spark.createDataFrame([("x" * 100, ["a", "b"])] * 10, "s string, l array<string>")
    assert 1000 < measured_bytes(df) < 4000
    assert measured_bytes(df.limit(0)) == 0


def test_left_join_keeps_answers_without_passage(answers, prompts):
    made = {r["student_id"]: r for r in ft.text_features(answers, prompts).collect()}
    assert len(made) == len(ANSWERS)
    assert made["3"]["prompt_length"] is None and made["3"]["word_overlap_count"] is None
    assert made["3"]["summary_length"] == 3
    assert made["4"]["summary_length"] == 0 and made["4"]["bigram_overlap_ratio"] == 0.0
    assert made["4"]["keyword_density"] is None and made["4"]["text_similarity"] == 0.0
    assert made["5"]["trigram_overlap_ratio"] is None
    assert made["2"]["quotes_count"] == 1
    assert made["1"]["bigram_overlap_count"] == 1
    assert 0 <= made["1"]["jaccard_similarity"] <= 1


def test_feature_order_and_sets(answers, prompts, spark):
    vocabulary = spark.createDataFrame([("was", 5), ("here", 5)], "word string, freq bigint")
    full = ft.build_features(answers, prompts, vocabulary)
    assert full.columns == [*ft.ID_COLUMNS, *ft.ENRICHED, "content", "wording"]
    assert len(ft.ENRICHED) == 43 and len(ft.BASIC) == 9 and set(ft.BASIC) < set(ft.ENRICHED)
    assert "length_ratio" not in ft.BASIC
    rows = {r["student_id"]: r for r in full.collect()}
    assert len(rows) == len(ANSWERS) and rows["4"]["splling_err_num"] == 0
    assert rows["2"]["text"] == ANSWERS[1][2] and '"' in rows["2"]["fixed_summary_text"]
    assert ft.drop_non_features(full).columns == ft.ENRICHED
    assert ft.numeric_features(full) == sorted(ft.ENRICHED)
    with pytest.raises(ValueError):
        ft.numeric_features(full.drop("compound"))


def test_cleaning_modes(answers, prompts, spark):
    vocabulary = spark.createDataFrame([("was", 5)], "word string, freq bigint")

    def row(clean):
        options = ft.FeatureOptions("basic", clean=clean, max_distance=1)
        return ft.build_features(answers.where("student_id = '2'"), prompts, vocabulary, options).first()

    fixed, cleaned = row("fixed_only"), row("all")
    assert fixed["text"] == 'Dogs "bark" a lot' and '"' not in fixed["fixed_summary_text"]
    assert cleaned["text"] == "Dogs bark a lot" and cleaned["quotes_count"] == 0
    with pytest.raises(ValueError):
        ft.FeatureOptions(clean="some")


def test_model_input_needs_every_part(answers, prompts):
    joined = joins.join_prompt(answers, prompts).withColumnRenamed("text", "fixed_summary_text")
    made = {r["student_id"]: r["i"] for r in joined.select("student_id", ft.model_input("|").alias("i")).collect()}
    assert made["1"] == "Title|Why?|The cat was big." and made["2"] is None and made["3"] is None


def test_lexicon_table_and_literals_agree(spark, answers, prompts):
    entries = [("cat", 0.5, 0.25, 2.0), ("big", -0.25, 0.5, -1.5), ("dogs", 1.0, 1.0, 0.0)]
    table = spark.createDataFrame(entries, "word string, polarity double, subjectivity double, valence double")
    answers = answers.union(spark.createDataFrame([("6", "p1", "I a big x y z", None, None)], answers.schema))
    made = ft.text_features(answers, prompts, ft.FeatureOptions("enriched", lexicon=Lexicon(entries)))
    literal = made.select("student_id", "sentiment_polarity", "sentiment_subjectivity", "neg", "neu", "pos", "compound")
    expected = {r[0]: tuple(r[1:]) for r in literal.collect()}
    p = {r["student_id"]: (r["polarity"], r["subjectivity"]) for r in lexicon_join.polarity_scores(answers, table).collect()}
    v = {r["student_id"]: tuple(r["scores"]) for r in lexicon_join.valence_scores(answers, table).collect()}
    for k, want in expected.items():
        assert (*p[k], *v[k]) == pytest.approx(want)


def test_entity_overlap_by_label(spark, answers, prompts):
    gazetteer = spark.createDataFrame(
        [("cat", "ANIMAL"), ("big cat", "ANIMAL"), ("cat", "PET"), ("dogs", "ANIMAL"), ("lot", "PLACE"), ("it was a big cat", "LONG")], "phrase string, label string"
    )
    answers = answers.union(spark.createDataFrame([("6", "p1", "So it was a big cat", None, None)], answers.schema))
    got = {(r["student_id"], r["label"]): r["n_common"] for r in lexicon_join.entity_overlap(answers, prompts, gazetteer).collect()}
    assert got == {("1", "ANIMAL"): 1, ("1", "PET"): 1, ("2", "ANIMAL"): 1, ("5", "ANIMAL"): 1, ("5", "PET"): 1, ("6", "LONG"): 1, ("6", "ANIMAL"): 2, ("6", "PET"): 1}


def test_ten_thousand_names_and_a_split_passage(spark):
    """Overlapping names of several lengths, against a search for each name in each answer."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(10_500)})[:10_000]
    gazetteer = spark.createDataFrame([(n, rng.choice(["PERSON", "ORG"])) for n in names] + [(names[0], "BOTH")], "phrase string, label string")
    passage = " . ".join(names)
    prompts = spark.createDataFrame([("p", passage), ("q", "nothing here")], "prompt_id string, prompt_text string")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", names[0].upper()]
    answers = spark.createDataFrame([(str(k), "p" if k % 9 else "q", t) for k, t in enumerate(texts)] + [("x", "gone", "w1")], "student_id string, prompt_id string, text string")
    labels = [(r["phrase"], r["label"]) for r in gazetteer.collect()]
    want = {}
    for k, t in enumerate(texts):
        for phrase, label in labels if k % 9 and t else []:
            if f" {phrase} " in f" {t.lower()} ":
                want[str(k), label] = want.get((str(k), label), 0) + 1
    made = lexicon_join.entity_overlap(answers, prompts, gazetteer, answers_per_trie=20)
    assert {(r["student_id"], r["label"]): r["n_common"] for r in made.collect()} == want and len(want) > 100


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [
        (i, m, t, i % 3, rng.random(), float(i % 2))
        for i in range(40)
        for m in ("a", "upload_model/b", "c_clean_text")
        for t in ("content", "wording")
    ]
    return spark.createDataFrame(rows, "row_id bigint, model string, target string, fold int, pred double, y double")


def rms(pairs):
    pairs = list(pairs)
    return math.sqrt(sum((y - p) ** 2 for y, p in pairs) / len(pairs))


def test_pooled_is_not_the_mean_of_folds(scored):
    one = scored.where("model = 'a'")
    rows = one.collect()
    want = {t: rms((r["y"], r["pred"]) for r in rows if r["target"] == t) for t in schemas.TARGETS}
    got = metrics.mcrmse(one).first()
    assert (got["content_rmse"], got["wording_rmse"]) == pytest.approx((want["content"], want["wording"]))
    assert metrics.pooled(one).first()["mcrmse"] == pytest.approx(sum(want.values()) / 2)
    assert metrics.fold_rmse(one).count() == 6
    board = metrics.leaderboard(scored).collect()
    assert [r["mcrmse"] for r in board] == sorted(r["mcrmse"] for r in board) and len(board) == 3


def test_blends(spark, scored):
    preds = scored.select("row_id", "model", "target", "pred")
    only_a = blend.weighted_blend(preds, blend.weight_table(spark, {"a": 2.0, "upload_model/b": 0.0, "c_clean_text": 0.0}))
    want = {(r["row_id"], r["target"]): r["pred"] for r in preds.where("model = 'a'").collect()}
    assert {(r["row_id"], r["target"]): r["pred"] for r in only_a.collect()} == pytest.approx(want)
    zero = blend.weighted_blend(preds, blend.weight_table(spark, {"a": 1.0, "c_clean_text": -1.0}))
    assert all(r["pred"] is None for r in zero.collect())


def test_weight_search_equals_blending_each_trial(spark, scored):
    models = ["a", "upload_model/b", "c_clean_text"]
    preds, truth = scored.select("row_id", "model", "target", "pred"), scored.select("row_id", "target", "y").distinct()
    trials = blend.sampled_trials(spark, models, 6).unionByName(
        blend.weight_table(spark, {"a": 1.0, "upload_model/b": -1.0, "c_clean_text": 0.0}).withColumn("trial", F.lit(99))
    )
    assert all(-0.5 <= r["weight"] <= 1.0 for r in trials.where("trial < 99").collect())
    cells = blend.gram(blend.to_matrix(preds, truth, models), models)
    assert cells.count() == 2 * 6
    got = {r["trial"]: r["mcrmse"] for r in blend.search_weights(cells, trials).collect()}
    assert sorted(got) == list(range(6))
    for trial in got:
        weights = trials.where(F.col("trial") == trial).select("model", "weight")
        direct = metrics.pooled(metrics.align(blend.weighted_blend(preds, weights), truth)).first()["mcrmse"]
        assert got[trial] == pytest.approx(direct, abs=1e-9)
    best = blend.best_trials(blend.search_weights(cells, trials)).first()
    assert best["mcrmse"] == min(got.values())


def test_sampled_trials_do_not_depend_on_partitions(spark):
    models = [f"m{k}" for k in range(5)]
    many = {(r["trial"], r["model"]): r["weight"] for r in blend.sampled_trials(spark, models, 200).collect()}
    few = {(r["trial"], r["model"]): r["weight"] for r in blend.sampled_trials(spark, models[:2], 50).repartition(7).collect()}
    assert len(many) == 1000 and all(many[k] == w for k, w in few.items())
    assert all(-0.5 <= w <= 1.0 and abs(w * 100 - round(w * 100)) < 1e-9 for w in many.values())
    assert len(set(many.values())) > 120 and abs(sum(many.values()) / 1000 - 0.25) < 0.05
    other = {(r["trial"], r["model"]): r["weight"] for r in blend.sampled_trials(spark, models, 200, seed=1, step=None).collect()}
    assert all(-0.5 <= w <= 1.0 for w in other.values()) and len(set(other.values())) == 1000


def test_a_rerun_replaces_its_line(spark, scored, tmp_path):
    path = str(tmp_path / "runs")
    report = metrics.mcrmse(scored)
    for name, factor in (("a", 1.0), ("b", 1.0), ("a", 2.0)):
        metrics.keep_run(report.withColumns({"mcrmse": F.col("mcrmse") * factor, "run_name": F.lit(name)}), path)
    lines = {r["run_name"]: r["mcrmse"] for r in spark.read.parquet(path).collect()}
    want = report.first()["mcrmse"]
    assert lines == pytest.approx({"a": 2 * want, "b": want})


def test_wide_blend_needs_no_grouping(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0)], "row_id bigint, m1_content_pred double, m1_wording_pred double, m2_content_pred double, m2_wording_pred double")
    made = blend.blend_wide(wide, {"m1": 3.0, "m2": 1.0})
    assert tuple(made.first()) == (1, 1.5, 2.5)
    long = blend.weighted_blend(tables.melt_predictions(wide), blend.weight_table(spark, {"m1": 3.0, "m2": 1.0}))
    assert {r["target"]: r["pred"] for r in long.collect()} == {"content": 1.5, "wording": 2.5}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_prediction_names(scored):
    bare = tables.strip_model_prefix(scored, "upload_model/")
    assert {r["model"] for r in bare.select("model").distinct().collect()} == {"a", "b", "c_clean_text"}
    assert tables.models_named(scored, "clean_text").count() == 80
    assert tables.models_named(scored, "clean_text", keep=False).count() == 160
    assert tables.drop_prediction(scored, "a", "content").count() == 200


def test_csv_round_trip_with_line_breaks_and_quotes(spark, prompts, answers):
    path = scratch_path(spark, "csv")
    tricky = prompts.withColumn("prompt_text", F.concat("prompt_text", F.lit('\nshe said "no", twice, \\ and left ')))
    tables.write_csv(tricky, path)
    assert sorted(map(tuple, tables.read_prompts(spark, path).collect())) == sorted(map(tuple, tricky.collect()))
    path = scratch_path(spark, "csv")
    tables.write_csv(answers.where("text <> ''"), path)
    back = tables.read_summaries(spark, path, scored=True)
    assert back.schema.fieldNames() == schemas.SCORED_SUMMARIES.fieldNames()
    assert back.where("content IS NULL").count() == 1


def test_prediction_sink_replaces_only_the_given_models(spark, scored):
    path = scratch_path(spark, "preds")
    preds = scored.select("row_id", "target", "pred", "model")
    tables.append_predictions(preds, path)
    tables.append_predictions(preds.where("model = 'a'").withColumn("pred", F.lit(7.0)), path)
    back = tables.read_predictions(spark, path, preds.schema)
    assert back.count() == preds.count()
    assert back.where("model = 'a' AND pred = 7.0").count() == 80 and back.where("pred = 7.0").count() == 80


def test_feature_cache_by_fingerprint(spark, tmp_path):
    root, built = str(tmp_path / "cache"), []

    def ask(rows, options):
        df = spark.createDataFrame(rows, "id int, text string")

        def build():
            built.append(options)
            return df.withColumn("fold", F.col("id") % 2)

        made, there = tables.cached_features(spark, root, [df], options, build)
        return sorted(map(tuple, made.select("id", "text", "fold").collect())), there

    rows = [(1, "a"), (2, None), (3, "c")]
    first = ask(rows, ("enriched", 4))
    assert first == ([(1, "a", 1), (2, None, 0), (3, "c", 1)], False)
    assert ask(rows[::-1], ("enriched", 4)) == (first[0], True) and len(built) == 1
    assert not ask(rows, ("enriched", 5))[1] and not ask([*rows, (3, "c")], ("enriched", 4))[1] and len(built) == 3
    key = tables.fingerprint([spark.createDataFrame(rows, "id int, text string")], ("enriched", 4))
    os.remove(f"{root}/{key}/_SUCCESS")
    assert not ask(rows, ("enriched", 4))[1] and ask(rows, ("enriched", 4)) == (first[0], True)
    plan = tables.read_features(spark, f"{root}/{key}").where("fold = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


def test_models_are_shown_few_tokens_at_once(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TOKENS_AT_ONCE", 50)
    texts = spark.createDataFrame([(k, "w " * n if n is not None else None) for k, n in enumerate([30, 20, 1, 70, None, 0, 60, 10])], "id int, text string").coalesce(1)
    settings = spark.createDataFrame([("m", 0, None)], "model string, max_length int, batch_size int")
    made = scoring.score_models(texts, settings, lambda row: 0, lambda _, rows: [sum(map(len, rows))] * len(rows), "text", ["id"])
    assert [r["pred"] for r in made.orderBy("id").collect()] == [50.0, 50.0, 1.0, 70.0, None, 0.0, 60.0, 10.0]


def test_feature_table_of_scored_answers_alone(spark, tmp_path, monkeypatch):
    """A query that only learns builds no features of other answers; its rows are those of the whole table."""
    sf, seen = "/root/testdata/sf0.001", []

    def counted(answers, *rest):
        seen.append(answers.count())
        return answers.withColumn("length", F.length("text"))

    monkeypatch.setattr(ft, "build_features", counted)
    options = ft.FeatureOptions("basic")
    alone, there = bindings.feature_table(spark, sf, options, 4, str(tmp_path / "a"), [bindings.SCORED])
    scored = bindings.truth_wide(spark, sf).where("content IS NOT NULL").count()
    assert not there and seen == [scored] and alone.count() == scored
    both, there = bindings.feature_table(spark, sf, options, 4, str(tmp_path / "a"))
    everyone = bindings.summaries(spark, sf).count()
    assert not there and seen == [scored, everyone - scored] and both.count() == everyone
    assert bindings.feature_table(spark, sf, options, 4, str(tmp_path / "a"))[1] and len(seen) == 2
    whole, _ = bindings.feature_table(spark, sf, options, 4, str(tmp_path / "b"))
    names = sorted(whole.columns)
    assert seen[2:] == [everyone] and both.select(names).exceptAll(whole.select(names)).isEmpty()
    assert whole.where("fold IS NOT NULL").select(names).exceptAll(alone.select(names)).isEmpty()


def test_feature_cache_prunes_folds(spark):
    path = scratch_path(spark, "features")
    tables.write_features(spark.range(20).withColumn("fold", (F.col("id") % 4).cast("int")), path)
    part = tables.read_features(spark, path).where("fold = 1")
    assert part.count() == 5
    assert "PartitionFilters: [isnotnull(fold" in part._jdf.queryExecution().executedPlan().toString()


def test_scoring_with_user_model_and_settings(spark, answers):
    lengths = scoring.score_partitions(answers, lambda: 2.0, lambda m, batch: batch["text"].str.len() * m, ["text"], ["student_id"])
    assert {r["student_id"]: r["pred"] for r in lengths.collect()} == {a[0]: 2.0 * len(a[2]) for a in ANSWERS}
    settings = spark.createDataFrame([("short", 1, 2, 1), ("long", 100, None, 10), ("all", 0, 0, 0)], "model string, max_length int, batch_size int, plus int")
    texts = answers.unionByName(spark.createDataFrame([("6", None)], "student_id string, text string"), allowMissingColumns=True).coalesce(1)

    def predict(plus, batch):  # the size of the batch shows as thousands
        return [1000 * len(batch) + plus + len(tokens) for tokens in batch]

    made = scoring.score_models(texts, settings, lambda row: row["plus"], predict, "text", ["student_id"])
    got = {(r["student_id"], r["model"]): r["pred"] for r in made.collect()}
    assert len(got) == 18 and got[("6", "short")] is got[("6", "long")] is None
    assert got[("1", "short")] == 2002.0 and got[("5", "short")] == 1002.0  # five texts by twos
    assert got[("1", "long")] == 5015.0 and got[("1", "all")] == 5005.0 and got[("4", "all")] == 5000.0
    with pytest.raises(ValueError):
        scoring.score_models(texts, settings, lambda row: 0, predict, "text", ["student_id"], most_models=2)
    with pytest.raises(ValueError):
        scoring.score_models(texts, settings.union(settings), lambda row: 0, predict, "text", ["student_id"])
    assert scoring.score_models(texts.limit(0), settings, lambda row: 0, predict, "text", ["student_id"]).count() == 0


def test_stream_equals_batch(spark, answers, prompts):
    source, sink = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    rows = answers.select("student_id", "prompt_id", "text")
    rows.write.parquet(source)
    streamed = stream_features(read_answer_stream(spark, source), prompts)
    run = (
        streamed.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    batch = ft.text_features(rows, prompts)
    got = spark.read.parquet(sink).select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_materialise_reads_what_it_wrote(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert sorted(map(tuple, materialise(df, "t").collect())) == sorted(map(tuple, df.collect()))


def test_models_get_small_batches_of_long_words(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("student_id"), F.repeat(F.lit("abcdefghij"), 500).alias("text"))
    settings = spark.createDataFrame([("whole", 0, None)], "model string, max_length int, batch_size int")
    made = scoring.score_models(texts, settings, lambda s: None, lambda m, batch: [len(batch)] * len(batch), "text", ["student_id"])
    assert made.agg(F.count("*"), F.max("pred") < 1000).first()[:] == (3000, True)
