"""Spelling operators against brute force over small vocabularies."""

import random

import pytest
from pyspark.sql import functions as F

from inkscore.operators import spelling as sp
from inkscore.session import materialise

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edits1(word):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return (
        {a + c[1:] for a, c in cuts if c}
        | {a + c[1] + c[0] + c[2:] for a, c in cuts if len(c) > 1}
        | {a + x + c[1:] for a, c in cuts if c for x in LETTERS}
        | {a + x + c for a, c in cuts for x in LETTERS}
    ) - {word}


def near(word, vocabulary, distance):
    reach = edits1(word)
    if distance == 2:
        reach = reach | {w for e in edits1(word) for w in edits1(e)}
    return {v for v in vocabulary if v in reach and v != word}


def vocabulary_frame(spark, freqs):
    return spark.createDataFrame(list(freqs.items()), "word string, freq bigint")


def test_heavy_keys_are_split(spark, monkeypatch):
    """Many short unknown words meet at few keys; split into shares they give the same pairs, each once."""
    rng = random.Random(5)
    unknown = {"".join(rng.choice(LETTERS) for _ in range(2)) for _ in range(300)} | {"".join(rng.choice("abc") for _ in range(5)) for _ in range(60)}
    known = {"".join(rng.choice(LETTERS) for _ in range(2)) for _ in range(60)} - unknown
    oov = spark.createDataFrame([(w,) for w in sorted(unknown)], "word string")
    vocabulary = vocabulary_frame(spark, {w: 5 for w in known})
    whole = sorted(map(tuple, sp.correction_candidates(oov, vocabulary, 2).collect()))
    monkeypatch.setattr(sp, "PAIRS_OF_A_KEY", 50)
    assert sorted(map(tuple, sp.correction_candidates(oov, vocabulary, 2).collect())) == whole and len(whole) > 1000
    left = spark.createDataFrame([(f"w{k}", "hot") for k in range(400)] + [("v", "cold")], "word string, key string")
    right = spark.createDataFrame([(f"c{k}", 1, key) for k in range(10) for key in ("hot", "cold")], "candidate string, freq int, key string")
    assert [tuple(r) for r in sp.heavy_keys(left, right, 500).collect()] == [("hot", 8)]
    pairs = sp._keyed_pairs(left, right, 400, 500)
    assert pairs.count() == pairs.distinct().count() == 4010


@pytest.mark.parametrize("distance", [1, 2])
def test_candidates_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)}
    unknown = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(50)} - vocabulary
    freqs = {w: rng.randint(1, 9) for w in sorted(vocabulary)}
    oov = spark.createDataFrame([(w,) for w in sorted(unknown)], "word string")
    got = {(r["word"], r["candidate"]) for r in sp.correction_candidates(oov, vocabulary_frame(spark, freqs), distance).collect()}
    assert got == {(u, v) for u in unknown for v in near(u, vocabulary, distance)}


@pytest.mark.parametrize("distance", [1, 2])
def test_long_words_are_found_by_segments(spark, distance):
    rng = random.Random(3)
    length = sp.LONG_WORD
    vocabulary = ["".join(rng.choice("abcd") for _ in range(length + d)) for d in (-1, 0, 1, 2, 9, 200) for _ in range(4)]
    unknown = set()
    for word in vocabulary:
        for _ in range(6):
            w = word
            for _ in range(rng.randint(1, distance)):
                i = rng.randrange(len(w) - 1)
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
            unknown.add(w)
    unknown -= set(vocabulary)
    oov = spark.createDataFrame([(w,) for w in sorted(unknown)], "word string")
    found = sp.correction_candidates(oov, vocabulary_frame(spark, {w: 1 for w in vocabulary}), distance)
    assert {r["word"] for r in found.collect()} == unknown


def test_an_enormous_unknown_word_is_no_burden(spark):
    oov = spark.createDataFrame([("x" * 200_000,), ("helo",)], "word string")
    found = sp.correction_candidates(oov, vocabulary_frame(spark, {"hello": 3}), 2).collect()
    assert [(r["word"], r["candidate"]) for r in found] == [("helo", "hello")]


def test_nearest_first_then_frequency_then_word(spark):
    known = vocabulary_frame(spark, {"cart": 5, "care": 5, "cares": 90, "house": 2})
    oov = spark.createDataFrame([("carx",), ("caxyt",), ("huose",), ("zzzzzz",)], "word string")
    got = {r["word"]: r["correction"] for r in sp.corrections(oov, known).collect()}
    assert got == {"carx": "cart", "caxyt": "cart", "huose": "house"}


def test_autocorrect_keeps_everything_else(spark):
    known = vocabulary_frame(spark, {"hello": 9, "world": 9, "the": 50})
    docs = spark.createDataFrame(
        [("1", "Helo,  wrold! teh\n42 été"), ("2", "hello world"), ("3", ""), ("4", None)], "student_id string, text string"
    )
    fixed = {r["student_id"]: r["fixed_summary_text"] for r in sp.autocorrect(docs, known).collect()}
    assert fixed["1"].startswith("Hello,  world! the\n42 ")
    assert (fixed["2"], fixed["3"], fixed["4"]) == ("hello world", "", None)


def test_parts_of_accented_words_are_no_words(spark):
    known = vocabulary_frame(spark, {w: 9 for w in ("café", "calf", "élève", "eve")})
    docs = spark.createDataFrame([("1", "un café élève cald x2calx")], "student_id string, text string")
    assert sp.autocorrect(docs, known).first()["fixed_summary_text"] == "un café élève calf x2calx"


def test_spelling_errors_keep_punctuation_and_use_one_dictionary(spark):
    base = vocabulary_frame(spark, {"the": 10, "dog": 5_000_000})
    prompts = spark.createDataFrame([("p", "Zebra dog"), ("q", "yak")], "prompt_id string, prompt_text string")
    known = sp.augment_vocabulary(base, prompts)
    assert {r["word"]: r["freq"] for r in known.collect()} == {"the": 10, "dog": 1000, "zebra": 1000, "yak": 1000}
    docs = spark.createDataFrame(
        [("1", "The dog. dog. DOG"), ("2", "yak zebra 3.5 - qqq qqq"), ("3", "")], "student_id string, text string"
    )
    errors = {r["student_id"]: r["spelling_errors"] for r in sp.spelling_errors(docs, known).collect()}
    assert errors == {"1": 1, "2": 1, "3": 0}
    wide = sp.spelling_errors(docs, known.withColumn("pad", F.lit("x")))
    assert {r["student_id"]: r["spelling_errors"] for r in wide.collect()} == errors


def test_texts_are_rewritten_by_many_tasks(spark):
    """Small texts are not merged into one task ahead of the rewriting and the features, which cost more than their bytes."""
    docs = spark.createDataFrame([(str(k), "teh cat") for k in range(400)], "student_id string, text string").coalesce(1)
    table = spark.createDataFrame([("teh", "the")], "word string, correction string")
    fixed = materialise(sp.apply_corrections(docs, table).withColumn("task", F.spark_partition_id()), "fixed")
    assert fixed.where("fixed_summary_text = 'the cat'").count() == 400 and fixed.select("task").distinct().count() >= 4
