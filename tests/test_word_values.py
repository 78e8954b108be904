"""Word tables read inside the row, and spelling counts of a stream with repeated batches."""

import random
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from inkscore.functions import readability as rd
from inkscore.functions.lexicons import RowLexicon, known_words
from inkscore.functions.tokens import lowered_words
from inkscore.operators import lexicon_join, spelling, word_values
from inkscore.plans import features as ft
from inkscore.session import materialise, scratch_path
from inkscore.streaming import spelling_counts
from inkscore.streaming.answers import read_answer_stream

VOCABULARY = [f"{a}{b}{c}{d}" for a in "bdfgklmnpr" for b in "aeiou" for c in "stvxzw" for d in ("", "e", "ia", "or")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(str(n), "p1", " ".join(rng.choice(VOCABULARY).title() for _ in range(rng.randint(0, 60)))) for n in range(60)]
    rows += [("none", "p1", None), ("empty", "p1", ""), ("strange", "p1", "?! -- ..."), ("same", "p1", "baso Baso BASO other")]
    return materialise(spark.createDataFrame(rows, "student_id string, prompt_id string, text string"), "word-docs")


@pytest.fixture(scope="module")
def lexicon(spark):
    """10,000 words, of which the texts use some."""
    rng = random.Random(4)
    words = rng.sample(VOCABULARY, 700) + ["baso"] + [f"word{n}" for n in range(10_000 - 701)]
    rows = [(w, rng.randint(-8, 8) / 8, rng.randint(0, 8) / 8, rng.randint(-4, 4) / 2) for w in dict.fromkeys(words)]
    return materialise(spark.createDataFrame(rows, "word string, polarity double, subjectivity double, valence double"), "word-lexicon")


def in_row(docs, table, table_bytes):
    lex = RowLexicon()
    rows = word_values.attach(docs, table, "student_id", "text", table_bytes).withColumn("words", lowered_words(F.col("text")))
    rows = rows.withColumn("known", lex.known("words"))
    return {
        r["student_id"]: r
        for r in rows.select("student_id", lex.polarity(F.col("known")).alias("p"), lex.valence(F.col("known"), F.size("words")).alias("v")).collect()
    }


@pytest.mark.parametrize("table_bytes", [1 << 28, 0])
def test_in_row_scores_equal_the_lexicon_join(docs, lexicon, table_bytes):
    got = in_row(docs, word_values.word_table(lexicon), table_bytes)
    polarity = {r["student_id"]: r for r in lexicon_join.polarity_scores(docs, lexicon).collect()}
    valence = {r["student_id"]: r["scores"] for r in lexicon_join.valence_scores(docs, lexicon).collect()}
    assert set(got) == set(polarity) and len(got) == 64
    for key, row in got.items():
        if key == "none":  # no text, no score; the join has a row of zeros
            assert row["p"]["polarity"] is None and row["v"]["neu"] is None
            continue
        assert (row["p"]["polarity"], row["p"]["subjectivity"]) == pytest.approx((polarity[key]["polarity"], polarity[key]["subjectivity"]))
        assert tuple(row["v"]) == pytest.approx(tuple(valence[key]))


def test_features_take_both_tables(spark, docs, lexicon):
    prompts = spark.createDataFrame([("p1", "Q", "T", "Baso is other.")], "prompt_id string, prompt_question string, prompt_title string, prompt_text string")
    irregular = spark.createDataFrame([("baso", 7), ("absent", 3)], "word string, syllables int")
    plain = {r["student_id"]: r for r in ft.text_features(docs, prompts).collect()}
    rows = ft.text_features(docs, prompts, lexicon=lexicon, irregular=irregular)
    assert not [c for c in rows.columns if c.startswith("_")]
    made = {r["student_id"]: r for r in rows.collect()}
    want = next(r for r in lexicon.where("word = 'baso'").collect())
    assert made["same"]["sentiment_polarity"] == want["polarity"]
    assert made["same"]["count_difficult_words"] == plain["same"]["count_difficult_words"] + 3
    assert made["same"]["flesch_reading_ease_prompt"] < plain["same"]["flesch_reading_ease_prompt"]
    only = {r["student_id"]: r for r in ft.text_features(docs, prompts, irregular=irregular).collect()}
    assert only["same"]["sentiment_polarity"] == plain["same"]["sentiment_polarity"]
    assert only["same"]["gunning_fog"] == made["same"]["gunning_fog"]


def test_irregular_syllables(spark, docs):
    rng = random.Random(5)
    table = {w: rng.randint(1, 6) for w in rng.sample(VOCABULARY, 200)}
    rows = [*table.items(), ("baso", 5), ("baso", 2), (None, 4)]  # of repeated words the greatest value counts
    table["baso"] = max(5, 2)
    words = word_values.word_table(irregular=spark.createDataFrame(rows, "word string, syllables int"))
    made = word_values.attach(docs, words, "student_id", "text")
    got = {r["student_id"]: r["c"] for r in made.select("student_id", rd.corrected(rd.counts(F.col("text")), known_words("text")).alias("c")).collect()}
    for r in docs.collect():
        if r["text"] is None:
            assert got["none"]["syllables"] is None
            continue
        each = [table.get(w, max(1, len(re.findall("[aeiouy]+", w)))) for w in re.findall(r"\w+", r["text"].lower())]
        assert got[r["student_id"]]["syllables"] == sum(each)
        assert got[r["student_id"]]["long_words"] == sum(n >= 3 for n in each)


def test_no_table_is_an_error():
    with pytest.raises(ValueError):
        word_values.word_table()


def test_stream_with_a_repeated_batch(spark, docs):
    source, sink, state = (scratch_path(spark, f"spell-{part}") for part in ("in", "out", "state"))
    docs.repartition(6).write.parquet(source)
    dictionary = spark.createDataFrame([(w, 1) for w in VOCABULARY[:600]], "word string, freq bigint")
    answers = read_answer_stream(spark, source, files_per_batch=2)
    write, seen = spelling_counts.batch_writer(dictionary, sink), []
    assert spelling_counts.read_counts(spark, sink).count() == 0

    def lost(batch, number):
        seen.append(number)
        write(batch, number)
        if number == 1:
            raise RuntimeError("lost")

    def goes_on(batch, number):
        seen.append(number)
        write(batch, number)

    with pytest.raises(StreamingQueryException):
        spelling_counts.start(answers, lost, state).awaitTermination()
    spelling_counts.start(answers, goes_on, state).awaitTermination()
    assert seen[:3] == [0, 1, 1] and seen[3:] == list(range(2, 2 + len(seen) - 3)) and len(seen) > 3
    got = sorted(map(tuple, spelling_counts.read_counts(spark, sink).collect()), key=str)
    want = sorted(map(tuple, spelling.spelling_errors(docs, dictionary).collect()), key=str)
    assert got == want and len(got) == 64

    again = [("same", "p1", "bas unheard")]  # a later answer takes the place of the earlier one
    spark.createDataFrame(again, "student_id string, prompt_id string, text string").write.mode("append").parquet(source)
    spelling_counts.start(answers, goes_on, state).awaitTermination()
    latest = {r["student_id"]: r["spelling_errors"] for r in spelling_counts.read_counts(spark, sink).collect()}
    assert len(latest) == 64 and latest["same"] == 1


def test_a_batch_is_dealt_to_all_slots(spark, tmp_path):
    answers = spark.range(400).select(F.col("id").cast("string").alias("student_id"), F.concat(F.lit("known 12 , word"), "id").alias("text")).coalesce(1)
    spelling_counts.batch_writer(spark.createDataFrame([("known", 5)], "word string, freq bigint"), str(tmp_path))(answers, 0)
    made = spark.read.parquet(f"{tmp_path}/batch=0")
    assert made.count() == 400 and made.filter("spelling_errors != 1").isEmpty()
    assert made.select(F.input_file_name()).distinct().count() == spark.sparkContext.defaultParallelism
