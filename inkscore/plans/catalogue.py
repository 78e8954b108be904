"""Every operator as a query over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import overlap as ov
from ..functions import readability as rd
from ..functions import tagging
from ..functions import tokens as tk
from ..functions.cleaning import clean_text as clean_column
from ..functions.lets import long_size, ratio
from ..functions.lexicons import Lexicon, known_words
from ..operators import blend, folds, joins, lexicon_join, metrics, models, nested, scoring, spelling, word_values
from ..session import materialise, scratch_path
from ..sources import schemas, tables
from ..streaming import spelling_counts
from ..streaming.answers import read_answer_stream
from . import bindings as b
from . import features as ft
from . import training

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def text() -> Column:
    return F.col("text")


def passage() -> Column:
    return F.col("prompt_text")

# A lexicon of words that are frequent in the test texts; eighths add up without rounding.
SAMPLE_LEXICON = Lexicon(
    (
        ("the", 0.125, 0.25, 0.5),
        ("of", -0.25, 0.375, -0.75),
        ("and", 0.375, 0.5, 1.125),
        ("that", -0.5, 0.625, -1.25),
        ("with", 0.625, 0.75, 1.875),
        ("for", -0.75, 0.875, -2.125),
        ("de", 0.875, 1.0, 2.25),
        ("la", -1.0, 0.125, -2.5),
        ("der", 1.0, 0.25, 2.875),
        ("und", -0.125, 0.375, -3.125),
    )
)
OPTIONS = {name: ft.FeatureOptions(feature_set=name, lexicon=SAMPLE_LEXICON) for name in ft.FEATURE_SETS}

MODEL_RUN = RunConfig()


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(column: Column, name: str) -> Column:
    return F.round(column, 6).alias(name)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison with another engine's sums."""
    return df.select(*[r6(F.col(f"`{n}`"), n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def per_answer(columns: Callable[[], Sequence[Column]]) -> Query:
    """Row-local columns of every answer; columns can only be made once a session is active."""
    return lambda spark, sf: b.summaries(spark, sf).select("student_id", *columns())


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return joins.join_prompt(b.summaries(spark, sf), b.prompts(spark, sf))


def tokenised_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tokens of both sides and what they share; passages are cut before the join."""
    passages = b.prompts(spark, sf).select("prompt_id", F.array_distinct(tk.tokens(passage())).alias("p_tokens"))
    answers = b.summaries(spark, sf).select("student_id", "prompt_id", F.array_distinct(tk.tokens(text())).alias("tokens"))
    return joins.join_prompt(answers, passages).withColumn("common", F.array_intersect("tokens", "p_tokens"))


# ---- sources and sinks -------------------------------------------------------------------------


@query
def scan_prompts(spark, sf):
    path = scratch_path(spark, "prompts-csv")
    tables.write_csv(b.prompts(spark, sf), path)
    return tables.read_prompts(spark, path)


@query
def scan_summaries(spark, sf):
    path = scratch_path(spark, "summaries-csv")
    scored = b.summaries(spark, sf).join(b.truth_wide(spark, sf), "student_id", "left")
    tables.write_csv(scored, path)
    return tables.read_summaries(spark, path, scored=True)


@query
def feature_cache(spark, sf):
    """The complete table by fold: built, found again, and missed under another option."""
    root = scratch_path(spark, "feature-cache")
    _, before = b.feature_table(spark, sf, OPTIONS["enriched"], 4, root)
    made, after = b.feature_table(spark, sf, OPTIONS["enriched"], 4, root)
    inputs = [b.table(spark, sf, name) for name in ("documents", "benchmark", "labels")]
    moved = tables.fingerprint(inputs, (OPTIONS["enriched"], 4)) != tables.fingerprint(inputs, (OPTIONS["enriched"], 5))
    found = made.where("fold IS NOT NULL").drop("prompt_question", "prompt_title", "prompt_text")
    return rounded(found).withColumn("found_again", F.lit(after and not before and moved))


@query
def pred_table_scan(spark, sf):
    return b.predictions(spark, sf)


@query
def pred_table_sink(spark, sf):
    path = scratch_path(spark, "predictions")
    preds = b.predictions(spark, sf)
    tables.append_predictions(preds, path)
    # A rerun of some models replaces exactly their partitions.
    tables.append_predictions(tables.models_named(preds, "clean_text"), path)
    return tables.read_predictions(spark, path, preds.schema)


@query
def submission(spark, sf):
    blended = blend.uniform_blend(b.predictions(spark, sf))
    wide = blended.groupBy(F.col("row_id").cast("string").alias("student_id")).agg(
        *[r6(F.max(F.when(F.col("target") == t, F.col("pred"))), t) for t in schemas.TARGETS]
    )
    path = scratch_path(spark, "submission")
    tables.write_submission(wide, path)
    return tables.read_submission(spark, path)


@query
def sample_head(spark, sf):
    return tables.head(b.summaries(spark, sf), "student_id", 12)


@query
def peek(spark, sf):
    return tables.head(b.predictions(spark, sf), ["row_id", "model", "target"], 5)


# ---- projections and filters -------------------------------------------------------------------


@query
def fold_split(spark, sf):
    keyed = folds.group_kfold(b.summaries(spark, sf), "prompt_id", spread_by="student_id")
    keyed = keyed.select("student_id", "prompt_id", "fold")
    train = folds.train_rows(keyed, 0).withColumn("part", F.lit("train"))
    return train.unionByName(folds.valid_rows(keyed, 0).withColumn("part", F.lit("valid")))


@query
def drop_non_features(spark, sf):
    made = ft.text_features(b.scored_summaries(spark, sf), b.prompts(spark, sf), OPTIONS["basic"])
    return rounded(ft.drop_non_features(made.withColumn("fold", F.lit(0))))


@query
def drop_if_present(spark, sf):
    return pairs(spark, sf).drop("text", "prompt_text", "no_such_column")


@query
def model_input_text(spark, sf):
    made = pairs(spark, sf).withColumnRenamed("text", "fixed_summary_text")
    return made.select("student_id", ft.model_input("[SEP]").alias("input"))


@query
def truncate_tokens(spark, sf):
    kept = b.summaries(spark, sf).select("student_id", tk.truncate(tk.tokens(text()), 512).alias("kept"))
    return kept.select("student_id", long_size(F.col("kept")).alias("n_kept"), F.try_element_at("kept", F.lit(-1)).alias("last_token"))


@query
def strip_model_prefix(spark, sf):
    return tables.strip_model_prefix(b.predictions(spark, sf, prefixed=True), b.PREFIX)


@query
def model_subset(spark, sf):
    return tables.models_named(b.predictions(spark, sf), "clean_text")


@query
def drop_pred_column(spark, sf):
    return tables.drop_prediction(b.predictions(spark, sf), b.MODELS[0], "content")


# ---- joins -------------------------------------------------------------------------------------


@query
def join_prompt(spark, sf):
    return pairs(spark, sf).select("student_id", "prompt_id", "prompt_title", "prompt_question", tk.num_chars(passage()).alias("prompt_chars"))


@query
def concat_columns(spark, sf):
    return joins.expand_struct(per_answer(lambda: [rd.counts(text()).alias("counts")])(spark, sf), "counts")


@query
def oof_scatter(spark, sf):
    """Fold k is predicted by model k + 1; the folds' rows are put together again."""
    scored = b.scored_predictions(spark, sf)
    parts = [scored.where((F.col("fold") == k) & (F.col("model") == b.MODELS[k])) for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.select("row_id", "fold", "target", "pred")


@query
def oov_words(spark, sf):
    return spelling.oov_words(b.summaries(spark, sf), b.dictionary(spark, sf))


@query
def in_prompt_words(spark, sf):
    passages = b.prompts(spark, sf).select("prompt_id", F.array_distinct(tk.spaced_words(passage())).alias("p_words"))
    answers = b.summaries(spark, sf).select("student_id", "prompt_id", tk.spaced_words(text()).alias("words"))
    joined = joins.join_prompt(answers, passages)
    return joined.select("student_id", F.explode(F.array_intersect("words", "p_words")).alias("word"))


@query
def labels_preds_align(spark, sf):
    return metrics.align(b.predictions(spark, sf), b.prediction_truth(spark, sf))


@query
def correction_candidates(spark, sf):
    known = b.dictionary(spark, sf)
    unknown = materialise(spelling.oov_words(b.summaries(spark, sf), known), "oov")
    return spelling.correction_candidates(unknown, known, 1)


# ---- aggregates --------------------------------------------------------------------------------


def first_model(spark, sf):
    return b.scored_predictions(spark, sf).where(F.col("model") == b.MODELS[0])


@query
def rmse(spark, sf):
    content = first_model(spark, sf).where(F.col("target") == "content")
    return content.agg(r6(metrics.rmse(F.col("y"), F.col("pred")), "rmse"))


@query
def mcrmse(spark, sf):
    return rounded(metrics.mcrmse(first_model(spark, sf)))


@query
def compt_score(spark, sf):
    first = b.table(spark, sf, "embeddings").select(
        F.col("label").cast("double").alias("content"),
        F.get("embedding", F.lit(63)).cast("double").alias("wording"),
        F.get("embedding", F.lit(0)).cast("double").alias("content_pred"),
        F.get("embedding", F.lit(b.N_MODELS)).cast("double").alias("wording_pred"),
    )
    return rounded(metrics.vector_score(first, {t: (t, f"{t}_pred") for t in schemas.TARGETS}))


def oof(spark, sf):
    own = F.element_at(F.array(*[F.lit(m) for m in b.MODELS[:4]]), F.col("fold") + 1)
    return b.scored_predictions(spark, sf).where(F.col("model") == own)


@query
def pooled_oof_rmse(spark, sf):
    return rounded(metrics.pooled(oof(spark, sf)))


@query
def fold_rmse(spark, sf):
    return rounded(metrics.fold_rmse(oof(spark, sf)))


@query
def model_leaderboard(spark, sf):
    return rounded(metrics.leaderboard(b.scored_predictions(spark, sf)))


@query
def fold_mean(spark, sf):
    """Models 1 to 4 act as fold models; some predictions are missing."""
    missing = F.pmod(F.col("row_id") + F.substr("model", F.lit(7), F.lit(2)).cast("bigint"), F.lit(7)) == 0
    preds = b.predictions(spark, sf).where(F.col("model").isin(list(b.MODELS[:4])))
    return rounded(blend.fold_mean(preds.withColumn("pred", F.when(~missing, F.col("pred")))))


@query
def uniform_blend(spark, sf):
    return rounded(blend.uniform_blend(b.predictions(spark, sf)))


def formula_weights(spark) -> DataFrame:
    return blend.weight_table(spark, {b.model_name(m): ((m * 7) % 31 - 10) / 20.0 for m in range(1, b.N_MODELS + 1)})


@query
def weighted_blend(spark, sf):
    return rounded(blend.weighted_blend(b.predictions(spark, sf), formula_weights(spark)))


@query
def inverse_rmse_weights(spark, sf):
    return rounded(blend.inverse_error_weights(metrics.leaderboard(b.scored_predictions(spark, sf))))


@query
def tag_histogram(spark, sf):
    cut = b.summaries(spark, sf).select("student_id", tk.tokens(text()).alias("t"))
    tagged = cut.select("student_id", tagging.tags("t").alias("tags"))
    counted = tagged.select("student_id", F.size("tags").alias("n_tags"), F.inline(ov.bag(F.col("tags"))))
    return counted.select("student_id", F.col("term").alias("tag"), "n", r6(ratio(F.col("n"), F.col("n_tags")), "share"))


@query
def char_histogram(spark, sf):
    marks = b.summaries(spark, sf).select("student_id", F.explode(tk.char_ratios(text())).alias("mark", "share"))
    return rounded(marks)


@query
def group_kfold(spark, sf):
    """Few unequal, equal and many groups: every key of each table gets one fold."""
    sources = (("documents", "lang"), ("documents", "source"), ("conversations", "conv_id"), ("orders", "o_custkey"))
    assigned = [
        folds.assign_groups(b.table(spark, sf, name), column).select(
            F.lit(f"{name}.{column}").alias("key"), F.col("grp").cast("string").alias("grp"), "fold"
        )
        for name, column in sources
    ]
    whole = assigned[0]
    for part in assigned[1:]:
        whole = whole.unionByName(part)
    return whole


@query
def distinct_count(spark, sf):
    return per_answer(lambda: [tk.distinct_count(tk.spaced_words(text())).alias("distinct_words"),
        tk.distinct_count(tk.tokens(text())).alias("distinct_tokens")])(spark, sf)


# ---- token sets --------------------------------------------------------------------------------


@query
def word_overlap(spark, sf):
    return tokenised_pairs(spark, sf).select(
        "student_id",
        ov.stop_word_overlap("common").alias("stop_overlap"),
        ov.stop_word_overlap("common", ov.CONTENT).alias("content_overlap"),
    )


@query
def ngrams(spark, sf):
    made = b.summaries(spark, sf).select("student_id", tk.tokens(text()).alias("tokens"))
    made = made.select("student_id", *[tk.ngrams(F.col("tokens"), n).alias(f"g{n}") for n in (2, 3)])
    return made.select(
        "student_id",
        *[long_size(F.col(f"g{n}")).alias(f"n_{n}grams") for n in (2, 3)],
        *[tk.distinct_count(F.col(f"g{n}")).alias(f"distinct_{n}grams") for n in (2, 3)],
        *[F.md5(F.array_join(f"g{n}", "|")).alias(f"digest_{n}grams") for n in (2, 3)],
    )


def ngram_table(spark, sf) -> DataFrame:
    passages = b.prompts(spark, sf).select("prompt_id", tk.tokens(passage()).alias("p"))
    passages = passages.select("prompt_id", *[F.array_distinct(tk.ngrams(F.col("p"), n)).alias(f"p{n}") for n in (2, 3)])
    answers = b.summaries(spark, sf).select("student_id", "prompt_id", tk.tokens(text()).alias("t"))
    answers = answers.select("student_id", "prompt_id", "t", tk.ngrams(F.col("t"), 2).alias("g2"))
    joined = joins.join_prompt(answers, passages)
    return joined.select(
        "student_id",
        long_size(F.col("t")).alias("summary_length"),
        ov.common_count(F.col("g2"), F.col("p2")).alias("bigram_overlap_count"),
        ov.common_count(tk.widen(F.col("g2"), F.col("t"), 3), F.col("p3")).alias("trigram_overlap_count"),
    )


@query
def ngram_overlap(spark, sf):
    return ngram_table(spark, sf).drop("summary_length")


@query
def ngram_overlap_ratio(spark, sf):
    length = F.col("summary_length")
    return ngram_table(spark, sf).select(
        "student_id",
        r6(ov.overlap_ratio(F.col("bigram_overlap_count"), length, 2), "bigram_overlap_ratio"),
        r6(ov.overlap_ratio(F.col("trigram_overlap_count"), length, 3), "trigram_overlap_ratio"),
    )


@query
def jaccard(spark, sf):
    share = ov.jaccard(F.col("common"), F.col("tokens"), F.col("p_tokens"))
    return tokenised_pairs(spark, sf).select("student_id", r6(share, "jaccard"))


@query
def quotes_overlap(spark, sf):
    return b.quoting_summaries(spark, sf).select("student_id", ov.quoted_in(text(), passage()).alias("quotes_count"))


@query
def entity_overlap(spark, sf):
    return lexicon_join.entity_overlap(b.summaries(spark, sf), b.prompts(spark, sf), b.gazetteer(spark, sf))


# ---- functions of one text ---------------------------------------------------------------------


@query
def tokens(spark, sf):
    made = b.summaries(spark, sf).select("student_id", tk.tokens(text()).alias("t"))
    return made.select("student_id", long_size(F.col("t")).alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


QUERIES["token_length"] = per_answer(lambda: [tk.token_length(text()).alias("summary_length")])
QUERIES["ws_words"] = per_answer(lambda: [long_size(tk.spaced_words(text())).alias("word_count")])
QUERIES["char_counts"] = per_answer(lambda: [tk.count_char(text(), ",").alias("comma_count"),
    tk.count_char(text(), ";").alias("semicolon_count"),
    tk.count_char(text(), "!").alias("exclamation_count"),
    tk.count_char(text(), "?").alias("question_count")])
QUERIES["sentence_pieces"] = per_answer(lambda: [tk.sentence_pieces(text()).alias("sentence_length")])
QUERIES["space_pieces"] = per_answer(lambda: [tk.space_pieces(text()).alias("word_count2")])
QUERIES["vocab_richness"] = per_answer(lambda: [tk.distinct_count(tk.spaced_words(text())).alias("vocabulary_richness")])
QUERIES["num_unq_words"] = per_answer(lambda: [tk.distinct_space_pieces(text()).alias("num_unq_words")])
QUERIES["num_chars"] = per_answer(lambda: [tk.num_chars(text()).alias("num_chars")])
QUERIES["avg_word_length"] = per_answer(lambda: [r6(tk.average_word_length(tk.spaced_words(text())), "avg_word_length")])
QUERIES["punctuation_sum"] = per_answer(lambda: [r6(tk.punctuation_share(text()), "punctuation_sum")])
QUERIES["sentences"] = per_answer(lambda: [rd.sentences(text()).alias("sentences")])
QUERIES["syllables"] = per_answer(lambda: [rd.syllables(text()).alias("syllables")])
QUERIES["difficult_words"] = per_answer(lambda: [rd.long_words(text()).alias("count_difficult_words"), rd.long_words(text(), 4).alias("at_least_4")])


def readability(formula: Callable[[Column], Column], name: str) -> Query:
    """The formula for every answer and every passage."""

    def run(spark, sf):
        answers = b.summaries(spark, sf).select(F.lit("answer").alias("side"), F.col("student_id").alias("id"), rd.counts(text()).alias("c"))
        passages = b.prompts(spark, sf).select(F.lit("passage").alias("side"), F.col("prompt_id").alias("id"), rd.counts(passage()).alias("c"))
        return answers.unionByName(passages).select("side", "id", r6(formula(F.col("c")), name))

    return run


QUERIES["flesch_reading_ease"] = readability(rd.reading_ease, "flesch_reading_ease")
QUERIES["flesch_kincaid"] = readability(rd.grade_level, "flesch_kincaid_grade_level")
QUERIES["gunning_fog"] = readability(rd.fog_index, "gunning_fog")


@query
def clean_text(spark, sf):
    pages = b.spread(b.table(spark, sf, "pages").select("page_id", "url", "html"), "page_id")
    return pages.select("page_id", clean_column(F.concat("url", F.lit(" "), "html")).alias("cleaned"))


@query
def length_ratio(spark, sf):
    passages = b.prompts(spark, sf).select("prompt_id", tk.token_length(passage()).alias("p"))
    answers = b.summaries(spark, sf).select("student_id", "prompt_id", tk.token_length(text()).alias("n"))
    return joins.join_prompt(answers, passages).select("student_id", r6(ratio(F.col("n"), F.col("p")), "length_ratio"))


@query
def keyword_density(spark, sf):
    passages = b.prompts(spark, sf).select("prompt_id", F.array_distinct(tk.spaced_words(passage())).alias("p_words"))
    answers = b.summaries(spark, sf).select("student_id", "prompt_id", tk.spaced_words(text()).alias("words"))
    covered = ov.covered_words(F.col("words"), F.col("p_words"))
    return joins.join_prompt(answers, passages).select(
        "student_id", r6(ov.keyword_density(covered, long_size(F.col("words"))), "keyword_density")
    )


@query
def token_tags(spark, sf):
    cut = b.summaries(spark, sf).select("student_id", tk.tokens(text()).alias("t"))
    return cut.select("student_id", F.array_join(tagging.tags("t"), " ").alias("tags"))


@query
def pos_mean(spark, sf):
    cut = b.summaries(spark, sf).select("student_id", F.array_distinct(tk.tokens(text())).alias("t"))
    return cut.select("student_id", r6(tagging.mean_tag_share(tagging.distinct_tags("t")), "pos_mean"))


@query
def lexicon_polarity(spark, sf):
    return rounded(lexicon_join.polarity_scores(b.summaries(spark, sf), b.lexicon(spark, sf)))


@query
def valence_scores(spark, sf):
    scored = lexicon_join.valence_scores(b.summaries(spark, sf), b.lexicon(spark, sf))
    return rounded(joins.expand_struct(scored, "scores"))


@query
def expand_struct(spark, sf):
    words = b.prompts(spark, sf).select("prompt_id", tk.lowered_words(passage()).alias("words"))
    known = words.withColumn("known", SAMPLE_LEXICON.known("words"))
    passages = known.select("prompt_id", SAMPLE_LEXICON.valence(F.col("known"), F.size("words")).alias("scores"))
    return rounded(joins.expand_struct(passages, "scores", "_prompt"))


@query
def tfidf_similarity(spark, sf):
    passages = b.prompts(spark, sf).select("prompt_id", ov.bag(tk.terms(passage())).alias("p_terms"))
    answers = b.summaries(spark, sf).select("student_id", "prompt_id", ov.bag(tk.terms(text())).alias("terms"))
    both = joins.join_prompt(answers, passages)
    both = both.select("*", ov.common_terms(F.col("terms"), F.col("p_terms")).alias("common"))
    return both.select(
        "student_id", r6(ov.tfidf_cosine(F.col("terms"), F.col("p_terms"), F.col("common")), "text_similarity")
    )


# ---- spelling ----------------------------------------------------------------------------------


@query
def augment_vocabulary(spark, sf):
    return spelling.augment_vocabulary(b.base_vocabulary(spark, sf), b.prompts(spark, sf))


@query
def spelling_errors(spark, sf):
    return spelling.spelling_errors(b.summaries(spark, sf), b.dictionary(spark, sf))


@query
def spelling_errors_stream(spark, sf):
    """Answers come as a stream; the second batch fails after it was written and is repeated from the checkpoint."""
    source, sink, state = (scratch_path(spark, f"stream-{part}") for part in ("answers", "counts", "state"))
    b.summaries(spark, sf).write.parquet(source)
    answers = read_answer_stream(spark, source, files_per_batch=max(1, spark.sparkContext.defaultParallelism // 2))
    write = spelling_counts.batch_writer(b.dictionary(spark, sf), sink)

    def lost(batch: DataFrame, number: int) -> None:
        write(batch, number)
        if number == 1:
            raise RuntimeError("lost after writing")

    first = spelling_counts.start(answers, lost, state)
    try:
        first.awaitTermination()
    except StreamingQueryException as error:
        if "lost after writing" not in str(error):
            raise
    spelling_counts.start(answers, write, state).awaitTermination()
    return spelling_counts.read_counts(spark, sink)


@query
def autocorrect(spark, sf):
    fixed = spelling.autocorrect(b.summaries(spark, sf), b.dictionary(spark, sf))
    return fixed.select("student_id", "fixed_summary_text")


# ---- feature sets ------------------------------------------------------------------------------


def feature_query(feature_set: str) -> Query:
    """All features that need no spell-fixed text, the spelling count among them."""

    def run(spark, sf):
        made = ft.text_features(b.summaries(spark, sf), b.prompts(spark, sf), OPTIONS[feature_set])
        errors = spelling.spelling_errors(b.summaries(spark, sf), b.dictionary(spark, sf))
        made = made.join(errors.withColumnRenamed("spelling_errors", "splling_err_num"), "student_id", "left")
        return rounded(made.select("student_id", *ft.FEATURE_SETS[feature_set]))

    return run


QUERIES["features_basic"] = feature_query("basic")
QUERIES["features_enriched"] = feature_query("enriched")


@query
def features_lexicon_table(spark, sf):
    """The enriched text features with scores from a lexicon table instead of a list in the plan."""
    made = ft.text_features(b.summaries(spark, sf), b.prompts(spark, sf), OPTIONS["enriched"], lexicon=b.lexicon(spark, sf))
    return rounded(made.select("student_id", *[c for c in ft.ENRICHED if c != "splling_err_num"]))


@query
def syllables_irregular(spark, sf):
    """Syllables and long words with a table of words that do not follow the rule."""
    words = word_values.word_table(irregular=b.irregular_syllables(spark, sf))
    answers = word_values.attach(b.summaries(spark, sf), words, "student_id", "text")
    counted = answers.select("student_id", rd.corrected(rd.counts(text()), known_words("text")).alias("c"))
    return counted.select("student_id", "c.syllables", "c.long_words")


@query
def feature_build(spark, sf):
    """The complete enriched table with dictionary, spell-fixed text and targets."""
    made = ft.build_features(
        b.scored_summaries(spark, sf), b.prompts(spark, sf), b.base_vocabulary(spark, sf), OPTIONS["enriched"]
    )
    return rounded(made.drop("prompt_question", "prompt_title", "prompt_text"))


def cleaned_build(mode: str) -> Query:
    """The complete enriched table with all texts cleaned, or only those that are spell-fixed."""

    def run(spark, sf):
        options = replace(OPTIONS["enriched"], clean=mode)
        made = ft.build_features(b.scored_summaries(spark, sf), b.prompts(spark, sf), b.base_vocabulary(spark, sf), options)
        return rounded(made.drop("prompt_question", "prompt_title", "prompt_text"))

    return run


QUERIES["feature_build_clean_all"] = cleaned_build(ft.CLEAN_ALL)
QUERIES["feature_build_clean_fixed"] = cleaned_build(ft.CLEAN_FIXED)


# ---- models ------------------------------------------------------------------------------------


def both_tables(spark, sf, clean: str = ft.CLEAN_NONE) -> tuple[DataFrame, DataFrame]:
    """The complete enriched features of scored answers, with folds, and of the others; built once for all model queries."""
    made, _ = b.feature_table(spark, sf, replace(OPTIONS["enriched"], clean=clean), MODEL_RUN.n_splits)
    return made.where("fold IS NOT NULL"), made.where("fold IS NULL").drop("fold", *schemas.TARGETS)


def train_table(spark, sf) -> DataFrame:
    """The scored answers alone, for queries that predict no others; the same rows as in ``both_tables``."""
    return b.feature_table(spark, sf, OPTIONS["enriched"], MODEL_RUN.n_splits, parts=[b.SCORED])[0]


def held_out_flags(held_out: DataFrame, table: DataFrame, fitted) -> DataFrame:
    """What any engine can derive of held-out predictions, and what must hold of them.

    Each is a number, predictions of a fold and target differ, and over the rows that a model learnt from its error is below
    that of their mean, which is the best that a model without features can do.
    """
    finite = F.coalesce(F.abs("pred") < float("inf"), F.lit(False)) & ~F.isnan("pred")
    varied = held_out.groupBy("target", "fold").agg((F.max("pred") > F.min("pred")).alias("varied"))
    pairs = sorted(fitted)
    scored = models.score_all(table, fitted, pairs)

    def learnt(target: str, fold: int) -> Column:
        seen = F.col("fold") != fold
        error = F.avg(F.when(seen, (F.col(f"{target}_pred_{fold}") - F.col(target)) ** 2))
        return (error < F.var_pop(F.when(seen, F.col(target)))).alias(f"{target}_{fold}")

    flags = scored.agg(*[learnt(t, k) for t, k in pairs])
    entries = [F.struct(F.lit(t).alias("target"), F.lit(k).alias("fold"), F.col(f"{t}_{k}").alias("learnt")) for t, k in pairs]
    each = flags.select(F.inline(F.array(*entries)))
    out = held_out.select("student_id", "target", "fold", "y", finite.alias("is_number"))
    return out.join(F.broadcast(varied.join(each, ["target", "fold"])), ["target", "fold"])  # a row per model


def beats_means(held_out: DataFrame) -> DataFrame:
    """One row: the pooled error over both targets is below that of each fold's mean from the other folds."""
    sums = held_out.groupBy("target", "fold").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    others = W.partitionBy("target")
    means = sums.select("target", "fold", ((F.sum("s").over(others) - F.col("s")) / (F.sum("n").over(others) - F.col("n"))).alias("mean"))
    joined = held_out.join(F.broadcast(means), ["target", "fold"])  # a row per target and fold
    errors = joined.groupBy("target").agg(metrics.rmse(F.col("y"), F.col("pred")).alias("own"), metrics.rmse(F.col("y"), F.col("mean")).alias("plain"))
    return errors.agg((F.avg("own") < F.avg("plain")).alias("beats_means"))


def test_flags(predicted: DataFrame) -> DataFrame:
    flags = [(F.coalesce(F.abs(t) < float("inf"), F.lit(False)) & ~F.isnan(t)).alias(f"{t}_is_number") for t in schemas.TARGETS]
    return predicted.select("student_id", *flags)


def boosters(spark, sf):
    return training.boosted(train_table(spark, sf), MODEL_RUN, "enriched")


@query
def stage1_oof(spark, sf):
    table, fitted = training.stage1(train_table(spark, sf), MODEL_RUN)
    return held_out_flags(materialise(models.predict_held_out(table, fitted, MODEL_RUN), "held-out"), table, fitted)


@query
def stage1_test(spark, sf):
    train, test = both_tables(spark, sf)
    _, fitted = training.stage1(train, MODEL_RUN)
    return test_flags(models.predict_mean(training.stage1_table(test, MODEL_RUN, ["student_id"]), fitted, MODEL_RUN))


@query
def gbt_cv(spark, sf):
    """One line per fitted model: the trees kept, whether they end at the best round of its history, and learnt anything."""
    _, fitted = boosters(spark, sf)
    rows = []
    for (t, k), m in sorted(fitted.items()):
        errors = fitted.errors[(t, k)]
        stopped = len(errors) < MODEL_RUN.boost_rounds and len(errors) - 1 - errors.index(min(errors)) == MODEL_RUN.patience
        rows.append((t, k, m.n_trees == errors.index(min(errors)) + 1, stopped))
    return spark.createDataFrame(rows, "target string, fold int, best_round_kept boolean, stopped_by_patience boolean")


@query
def gbt_oof(spark, sf):
    table, fitted = boosters(spark, sf)
    held_out = materialise(models.predict_held_out(table, fitted, MODEL_RUN), "held-out")
    return held_out_flags(held_out, table, fitted).join(F.broadcast(beats_means(held_out)))  # one row


@query
def gbt_nested(spark, sf):
    """Per target and held-out fold: sizes of both sides, and what must hold of the rounds chosen by the inner folds.

    The score taken with an inner stop is not below the one with the stop on the judging fold, and the error of the rows
    scored anew by the cut booster is the error that was seen while it grew. No passage is on two sides.
    """
    train = train_table(spark, sf)
    vectors = models.assemble(train, ft.numeric_features(train, "enriched")).select("student_id", *schemas.TARGETS, "fold", "vector")
    table = models.by_fold(vectors, "nested")
    fitted, choices = nested.fit(table, MODEL_RUN)
    held_out = models.predict_held_out(table, fitted, MODEL_RUN)
    again = held_out.groupBy("target", "fold").agg(F.avg((F.col("y") - F.col("pred")) ** 2).alias("again"))
    sides = train.groupBy("prompt_id").agg(F.count_distinct("fold").alias("n")).agg((F.max("n") == 1).alias("groups_apart"))
    inner, own = nested.scores(choices)
    made = nested.choices_table(spark, choices).join(again, ["target", "fold"]).join(F.broadcast(sides))  # one row
    learnt = F.sum("held_rows").over(W.partitionBy("target")) - F.col("held_rows")
    return made.select(
        "target", "fold", "held_rows", learnt.alias("learnt_rows"), "groups_apart",
        (F.col("rounds") >= 1).alias("rounds_chosen"),
        ((F.col("mse") >= F.col("own_mse")) & F.lit(inner >= own)).alias("not_below_own_stop"),
        (F.abs(F.col("again") - F.col("mse")) < 1e-9).alias("recomputed"),
    )


@query
def gbt_test_mean(spark, sf):
    train, test = both_tables(spark, sf)
    _, fitted = training.boosted(train, MODEL_RUN, "enriched")
    vectors = models.assemble(test, ft.numeric_features(test, "enriched"))
    return test_flags(models.predict_mean(vectors.select("student_id", "vector"), fitted, MODEL_RUN))


@query
def eval_history(spark, sf):
    """Per model: the rounds are without gaps, all errors are numbers."""
    _, fitted = boosters(spark, sf)
    history = models.eval_history(spark, fitted)
    gapless = (F.min("round") == 1) & (F.max("round") == F.count_distinct("round"))
    return history.groupBy("fold", "target").agg(gapless.alias("gapless"), F.bool_and(F.col("mse") < float("inf")).alias("all_numbers"))


@query
def best_checkpoint(spark, sf):
    """Per model: the best round is the one whose trees are kept."""
    _, fitted = boosters(spark, sf)
    best = models.best_rounds(models.eval_history(spark, fitted))
    kept = spark.createDataFrame([(k, t, m.n_trees) for (t, k), m in fitted.items()], "fold int, target string, n_trees int")
    return best.join(kept, ["fold", "target"], "full").select("fold", "target", F.col("round").eqNullSafe(F.col("n_trees")).alias("kept"))


@query
def model_store(spark, sf):
    """Predictions of models that went through storage, next to those of the models as fitted."""
    table, fitted = training.stage1(train_table(spark, sf), MODEL_RUN)
    root = scratch_path(spark, "models")
    models.save_models(fitted, root, MODEL_RUN.run_name)
    again = models.predict_held_out(table, models.load_models(root, MODEL_RUN.run_name), MODEL_RUN)
    first = models.predict_held_out(table, fitted, MODEL_RUN).select("student_id", "target", F.col("pred").alias("fitted"))
    both = again.join(first, ["student_id", "target"], "full")
    return both.select("student_id", "target", (F.col("pred") == F.col("fitted")).alias("same"))


def answer_predictions(spark, sf) -> DataFrame:
    """The prediction rows keyed like the answers."""
    return b.predictions(spark, sf).select(F.col("row_id").cast("string").alias("student_id"), "model", "target", "pred")


@query
def stack_features(spark, sf):
    made = ft.text_features(b.summaries(spark, sf), b.prompts(spark, sf), OPTIONS["basic"])
    blended = blend.weighted_blend(answer_predictions(spark, sf), formula_weights(spark), row_id="student_id")
    stacked = models.stack(made.select("student_id", "summary_length", "quotes_count"), blended)
    return rounded(stacked)


def formula_trials(spark) -> DataFrame:
    """70 trials on the grid -0.5, -0.49, ..., 1 from a formula that any engine can repeat."""
    trial = F.col("trial")
    weight = (F.pmod(trial * 7 + F.col("m") * 3, F.lit(151)) - 50) / 100.0
    names = F.array(*[F.lit(m) for m in b.MODELS])
    base = spark.range(70).select(F.col("id").cast("int").alias("trial"), F.posexplode(names).alias("p", "model"))
    return base.withColumn("m", F.col("p") + 1).select("trial", "model", weight.cast("double").alias("weight"))


def gram_cells(spark, sf) -> DataFrame:
    """The array of residuals comes straight from the row, so nothing is grouped by row."""
    per_target = [
        F.struct(
            F.lit(target).alias("target"),
            truth.cast("double").alias("y"),
            F.transform(F.slice("embedding", first, b.N_MODELS), lambda x: x.cast("double")).alias("preds"),
        )
        for target, truth, first in (("content", F.col("label"), 1), ("wording", F.get("embedding", F.lit(63)), b.N_MODELS + 1))
    ]
    matrix = b.table(spark, sf, "embeddings").select(F.inline(F.array(*per_target)))
    return blend.gram(matrix, b.MODELS)


@query
def weight_search(spark, sf):
    return rounded(blend.search_weights(gram_cells(spark, sf), formula_trials(spark)))


@query
def sampled_trials(spark, sf):
    """500 draws of 17 weights in [-0.5, 1] by steps of 0.01."""
    return rounded(blend.sampled_trials(spark, [f"model_{m:02d}" for m in range(1, 18)], 500))


@query
def best_trial(spark, sf):
    return rounded(blend.best_trials(weight_search(spark, sf)))


@query
def weight_search_stacked(spark, sf):
    """All 70 trials with their blend score, raced through stage two.

    A trial that left the race must not have scored better, at its last rung, than any that stayed; a later rung of a
    trial is never worse than an earlier one, as it goes on from there.
    """
    made = training.race(train_table(spark, sf), gram_cells(spark, sf), answer_predictions(spark, sf), formula_trials(spark), MODEL_RUN, "enriched")
    last = W.partitionBy("trial")
    lines = materialise(made, "race").withColumns({"last": F.max("rung").over(last), "before": F.lag("mcrmse").over(last.orderBy("rung"))})
    rung = W.partitionBy("rung")
    stayed = F.max(F.when(F.col("last") > F.col("rung"), F.col("mcrmse"))).over(rung)
    lines = lines.withColumn("worst_stayed", stayed)
    return lines.groupBy("trial").agg(
        F.round(F.max("blend_mcrmse"), 6).alias("blend_mcrmse"),
        F.bool_and(F.coalesce(F.col("mcrmse") < float("inf"), F.lit(False))).alias("scored"),
        F.bool_and(F.coalesce(F.col("mcrmse") <= F.col("before"), F.lit(True))).alias("never_worse"),
        F.bool_and((F.col("last") > F.col("rung")) | F.coalesce(F.col("mcrmse") >= F.col("worst_stayed"), F.lit(True))).alias("left_as_worse"),
        (F.count("*") == F.max("rung") + 1).alias("every_rung"),
    )


@query
def param_sweep(spark, sf):
    """Five regularisation strengths, each all folds and targets of stage one, from one pass over the rows.

    """
    base = train_table(spark, sf)
    table = models.by_fold(training.stage1_table(base, MODEL_RUN, ["student_id", *schemas.TARGETS, "fold"]), "sweep")
    tried = models.sweep_strengths(table, MODEL_RUN, [0.01, 0.03, 0.1, 0.3, 1.0])
    return tried.select("trial", "value", (F.coalesce(F.col("mcrmse") < float("inf"), F.lit(False)) & (F.col("mcrmse") > 0)).alias("scored"))


@query
def run_report(spark, sf):
    return rounded(metrics.run_report(oof(spark, sf), RunConfig().to_frame(spark)))


@query
def runs_table(spark, sf):
    """Runs kept in one table: a rerun replaces its own line, another name adds one."""
    path = scratch_path(spark, "runs")
    scored = oof(spark, sf)
    first, again = RunConfig(), RunConfig(run_name="again")
    for config in (first, again, first):
        metrics.keep_run(metrics.run_report(scored, config.to_frame(spark)), path)
    return rounded(spark.read.parquet(path).select("run_name", "content_rmse", "wording_rmse", "mcrmse", "patience"))


@query
def expand_targets(spark, sf):
    return b.truth_wide(spark, sf).unpivot("student_id", list(schemas.TARGETS), "target", "y")


@query
def score_partitions(spark, sf):
    """A user's own linear model over vectors, loaded once per task."""
    import numpy as np

    def load():
        return np.array([((i * 7) % 11 - 5) / 10.0 for i in range(64)])

    def predict(weights, batch):
        return np.vstack(batch["embedding"].to_numpy()).astype("float64") @ weights

    scored = scoring.score_partitions(b.table(spark, sf, "embeddings"), load, predict, ["embedding"], ["vec_id"])
    return rounded(scored)


@query
def score_models(spark, sf):
    """Three models with their own lengths and batch sizes over every answer, in one pass."""
    rows = [("short", 8, 16, 0.5), ("middle", 64, 100, 1.0), ("whole", 0, None, 2.0)]
    settings = spark.createDataFrame(rows, "model string, max_length int, batch_size int, factor double")

    def load(setting):
        return setting["factor"]

    def predict(factor, batch):
        return [factor * sum(map(len, tokens)) / len(tokens) if tokens else 0.0 for tokens in batch]

    return rounded(scoring.score_models(b.summaries(spark, sf), settings, load, predict, "text", ["student_id"]))


@query
def full_run(spark, sf):
    """Folds, stage one, stacking, stage two and the averaged predictions for unscored answers."""
    train, test = both_tables(spark, sf)
    return test_flags(training.run(train.drop("fold"), test, MODEL_RUN, "enriched")["submission"])


@query
def blend_run(spark, sf):
    """Three text models, one of them on cleaned texts, their best blend, stage two on it and its predictions.

    The chosen blend is no worse than any model alone, its error over the blended rows is the one that the search gave it, and
    a line of each model and of the stacked run is kept.
    """
    settings = [RunConfig(run_name="base"), RunConfig(run_name="strong", regularisation=3.0), RunConfig(run_name="short_clean_text", max_length=256)]
    pairs_ = {"": both_tables(spark, sf), "clean_text": both_tables(spark, sf, ft.CLEAN_ALL)}
    given = {mark: (train.drop("fold"), test) for mark, (train, test) in pairs_.items()}
    runs = scratch_path(spark, "blend-runs")
    made = training.blend_run(given, settings, runs=runs)
    best, alone = made["search"].agg(F.min("mcrmse").alias("best")), made["leaderboard"].agg(F.min("mcrmse").alias("alone"))
    blended = metrics.mcrmse(made["blend_oof"]).select(F.col("mcrmse").alias("blended"))
    kept = spark.read.parquet(runs).agg(F.count("*").alias("runs_kept"))
    line = best.join(alone).join(blended).join(kept)  # one row each
    flags = line.select((F.col("best") <= F.col("alone") + 1e-9).alias("not_worse"), (F.abs(F.col("best") - F.col("blended")) < 1e-9).alias("as_searched"), "runs_kept")
    return test_flags(made["submission"]).join(F.broadcast(flags))
