"""The basic (9) and enriched (43) feature sets of answer-passage pairs.

Everything except spelling is one narrow pass: scan, project, join the passage
side (derived once per passage), project. Answers are not shuffled while the
passage table is small enough to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import overlap as ov
from ..functions import readability as rd
from ..functions import tagging
from ..functions import tokens as tk
from ..functions.cleaning import clean_text
from ..functions.lets import long_size, ratio
from ..functions.lexicons import SCORED, Lexicon, RowLexicon, known_words
from ..operators import spelling, word_values
from ..operators.joins import join_prompt

BASIC, ENRICHED, ID_COLUMNS = list(fv.BASIC_FEATURES), list(fv.ENRICHED_FEATURES), fv.ID_COLUMNS
FEATURE_SETS = {"basic": BASIC, "enriched": ENRICHED}

CLEAN_NONE, CLEAN_FIXED, CLEAN_ALL = "none", "fixed_only", "all"


@dataclass(frozen=True)
class FeatureOptions:
    """``clean``: leave texts alone, clean only the text that is spell-fixed, or clean all answers."""

    feature_set: str = "enriched"
    clean: str = CLEAN_NONE
    keep: str = ov.STOP
    max_distance: int = 2
    lexicon: Lexicon = Lexicon()

    def __post_init__(self):
        if self.feature_set not in FEATURE_SETS:
            raise ValueError(f"feature_set must be one of {sorted(FEATURE_SETS)}")
        if self.clean not in (CLEAN_NONE, CLEAN_FIXED, CLEAN_ALL):
            raise ValueError("clean must be none, fixed_only or all")


def passage_side(prompts: DataFrame, options: FeatureOptions, irregular: bool = False) -> DataFrame:
    """Everything about a passage, once per passage and before the join."""
    text = F.col("prompt_text")
    tokens, terms = F.col("_p_tokens"), F.col("_p_terms_list")
    base = prompts.select(
        "*", tk.tokens(text).alias("_p_tokens"), tk.terms(text).alias("_p_terms_list"), tk.lowered_words(text).alias("_p_all_words")
    )
    columns = [
        "*",
        long_size(tokens).alias("prompt_length"),
        F.array_distinct(tokens).alias("_p_unigrams"),
        F.array_distinct(tk.ngrams(tokens, 2)).alias("_p_bigrams"),
        F.array_distinct(tk.ngrams(tokens, 3)).alias("_p_trigrams"),
    ]
    if options.feature_set == "basic":
        return base.select(*columns).drop("_p_tokens", "_p_terms_list", "_p_all_words")
    counts = rd.corrected(rd.counts(text), known_words("_p_all_words")) if irregular else rd.counts(text)
    base = base.select(
        "*", counts.alias("_p_counts"), options.lexicon.valence(options.lexicon.known("_p_all_words"), F.size("_p_all_words")).alias("_p_valence")
    )
    columns += [
        F.array_distinct(tk.spaced_words(text)).alias("_p_words"),
        ov.bag(terms).alias("_p_terms"),
        rd.fog_index(F.col("_p_counts")).alias("gunning_fog_prompt"),
        rd.grade_level(F.col("_p_counts")).alias("flesch_kincaid_grade_level_prompt"),
        rd.reading_ease(F.col("_p_counts")).alias("flesch_reading_ease_prompt"),
        *[F.col(f"_p_valence.{f}").alias(f"{f}_prompt") for f in ("neg", "neu", "pos", "compound")],
    ]
    return base.select(*columns).drop("_p_tokens", "_p_terms_list", "_p_all_words", "_p_counts", "_p_valence", SCORED)


def answer_side(summaries: DataFrame, options: FeatureOptions, irregular: bool = False) -> DataFrame:
    """Features of the answer alone. Arrays are projected first and then only referenced."""
    text = F.col("text")
    tokens, words, terms = F.col("_tokens"), F.col("_words"), F.col("_terms_list")
    base = summaries.select("*", tk.tokens(text).alias("_tokens"))
    columns = ["*", long_size(tokens).alias("summary_length"), tk.ngrams(tokens, 2).alias("_bigrams")]
    base = base.select("*", F.array_distinct(tokens).alias("_unigrams"))
    if options.feature_set == "basic":
        return base.select(*columns)
    base = base.select(
        "*",
        tk.spaced_words(text).alias("_words"),
        tk.terms(text).alias("_terms_list"),
        tk.lowered_words(text).alias("_all_words"),
        rd.counts(text).alias("_counts"),
    )
    extra = [rd.corrected(F.col("_counts"), known_words("_all_words")).alias("_corrected")] if irregular else []
    base = base.select(
        "*",
        long_size(words).alias("word_count"),
        options.lexicon.known("_all_words").alias("_known"),
        *extra,
    )
    base = base.select(
        "*",
        options.lexicon.polarity(F.col("_known")).alias("_polarity"),
        options.lexicon.valence(F.col("_known"), F.size("_all_words")).alias("_valence"),
    )
    counts = F.col("_corrected" if irregular else "_counts")
    columns += [
        rd.reading_ease(counts).alias("flesch_reading_ease"),
        tk.sentence_pieces(text).alias("sentence_length"),
        ov.bag(terms).alias("_terms"),
        tk.distinct_count(words).alias("vocabulary_richness"),
        tk.space_pieces(text).alias("word_count2"),
        tk.distinct_space_pieces(text).alias("num_unq_words"),
        tk.num_chars(text).alias("num_chars"),
        tk.average_word_length(words).alias("avg_word_length"),
        tk.count_char(text, ",").alias("comma_count"),
        tk.count_char(text, ";").alias("semicolon_count"),
        tk.count_char(text, "!").alias("exclamation_count"),
        tk.count_char(text, "?").alias("question_count"),
        tagging.mean_tag_share(tagging.distinct_tags("_unigrams")).alias("pos_mean"),
        tk.punctuation_share(text).alias("punctuation_sum"),
        F.col("_polarity.polarity").alias("sentiment_polarity"),
        F.col("_polarity.subjectivity").alias("sentiment_subjectivity"),
        rd.fog_index(counts).alias("gunning_fog"),
        rd.grade_level(counts).alias("flesch_kincaid_grade_level"),
        counts["long_words"].alias("count_difficult_words"),
        *[F.col(f"_valence.{f}").alias(f) for f in ("neg", "neu", "pos", "compound")],
    ]
    return base.select(*columns)


def pair_side(joined: DataFrame, options: FeatureOptions) -> DataFrame:
    """Features of answer and passage together."""
    length, tokens, bigrams = F.col("summary_length"), F.col("_tokens"), F.col("_bigrams")
    stage = joined.select(
        "*",
        F.array_intersect(F.col("_unigrams"), F.col("_p_unigrams")).alias("_common"),
        F.array_intersect(bigrams, F.col("_p_bigrams")).alias("_common_bigrams"),
    )
    # tokens hold no space, so a common trigram begins with a common bigram: without one no trigram is made
    trigrams = ov.common_count(tk.widen(bigrams, tokens, 3), F.col("_p_trigrams"))
    stage = stage.select(
        "*",
        ov.stop_word_overlap("_common", options.keep).alias("word_overlap_count"),
        long_size(F.col("_common_bigrams")).alias("bigram_overlap_count"),
        F.when(F.size("_common_bigrams") == 0, F.lit(0).cast("bigint")).otherwise(trigrams).alias("trigram_overlap_count"),
        ov.quoted_in(F.col("text"), F.col("prompt_text")).alias("quotes_count"),
    )
    columns = [
        "*",
        ov.overlap_ratio(F.col("bigram_overlap_count"), length, 2).alias("bigram_overlap_ratio"),
        ov.overlap_ratio(F.col("trigram_overlap_count"), length, 3).alias("trigram_overlap_ratio"),
    ]
    if options.feature_set == "basic":
        return stage.select(*columns)
    stage = stage.select(
        "*",
        ov.covered_words(F.col("_words"), F.col("_p_words")).alias("_covered"),
        ov.common_terms(F.col("_terms"), F.col("_p_terms")).alias("_common_terms"),
    )
    columns += [
        ratio(length, F.col("prompt_length")).alias("length_ratio"),
        ov.keyword_density(F.col("_covered"), F.col("word_count")).alias("keyword_density"),
        ov.jaccard(F.col("_common"), F.col("_unigrams"), F.col("_p_unigrams")).alias("jaccard_similarity"),
        ov.tfidf_cosine(F.col("_terms"), F.col("_p_terms"), F.col("_common_terms")).alias("text_similarity"),
    ]
    return stage.select(*columns)


def text_features(
    summaries: DataFrame,
    prompts: DataFrame,
    options: FeatureOptions = FeatureOptions(),
    lexicon: DataFrame | None = None,
    irregular: DataFrame | None = None,
) -> DataFrame:
    """All features that need no dictionary: a narrow pass plus the passage join.

    Works on static tables and on a stream of answers. ``lexicon`` (word, polarity, subjectivity, valence) of any size takes
    the place of the options' lexicon, ``irregular`` (word, syllables) that of the syllable rule for its words; both are
    looked up ahead of the narrow pass and need static tables.
    """
    if options.feature_set != "basic" and (lexicon is not None or irregular is not None):
        words = word_values.word_table(lexicon, irregular)
        summaries = word_values.attach(summaries, words, "student_id", "text")
        prompts = word_values.attach(prompts, words, "prompt_id", "prompt_text")
        options = options if lexicon is None else replace(options, lexicon=RowLexicon())
    corrected = options.feature_set != "basic" and irregular is not None
    answers = answer_side(summaries, options, corrected)
    features = pair_side(join_prompt(answers, passage_side(prompts, options, corrected)), options)
    return features.drop(*[c for c in features.columns if c.startswith("_")])


def build_features(
    summaries: DataFrame,
    prompts: DataFrame,
    vocabulary: DataFrame,
    options: FeatureOptions = FeatureOptions(),
    lexicon: DataFrame | None = None,
    irregular: DataFrame | None = None,
) -> DataFrame:
    """The complete feature table: ids, texts, features and, if present, the targets.

    ``vocabulary`` is the dictionary *before* the passages are added to it; ``lexicon`` and ``irregular`` are those of
    ``text_features``.
    """
    if options.clean == CLEAN_ALL:
        summaries = summaries.withColumn("text", clean_text(F.col("text")))
    dictionary = spelling.dictionary(vocabulary, prompts)
    source = summaries
    if options.clean == CLEAN_FIXED:
        source = summaries.withColumn("_fix_source", clean_text(F.col("text")))
    else:
        source = summaries.withColumn("_fix_source", F.col("text"))
    fixed = spelling.autocorrect(
        source, dictionary, text="_fix_source", max_distance=options.max_distance
    ).drop("_fix_source")
    errors = spelling.spelling_errors(summaries, dictionary).withColumnRenamed("spelling_errors", "splling_err_num")
    features = text_features(fixed, prompts, options, lexicon, irregular).join(errors, "student_id", "left")
    numeric = FEATURE_SETS[options.feature_set]
    extra = [c for c in summaries.columns if c not in ID_COLUMNS]
    return features.select(*ID_COLUMNS, *numeric, *extra)


def numeric_features(df: DataFrame, feature_set: str = "enriched", stacked: tuple[str, ...] = ()) -> list[str]:
    """Feature columns by name, so that train and test can never drift apart."""
    missing = [c for c in (*FEATURE_SETS[feature_set], *stacked) if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return sorted([*FEATURE_SETS[feature_set], *stacked])


def drop_non_features(df: DataFrame, targets: tuple[str, ...] = ("content", "wording")) -> DataFrame:
    """Only what a model may see; names that are absent are ignored."""
    return df.drop("fold", "input", *ID_COLUMNS, *targets)


def model_input(separator: str, title: str = "prompt_title", question: str = "prompt_question", fixed: str = "fixed_summary_text") -> Column:
    """Title, question and fixed text in one string; NULL if any part is NULL."""
    return F.concat(F.col(title), F.lit(separator), F.col(question), F.lit(separator), F.col(fixed))
