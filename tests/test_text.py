"""Functions of one text and of text pairs, against values worked out by hand or in plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkscore.functions import fixed_values as fv
from inkscore.functions import overlap as ov
from inkscore.functions import readability as rd
from inkscore.functions import tagging
from inkscore.functions import tokens as tk
from inkscore.functions.cleaning import clean_text
from inkscore.functions.lexicons import Lexicon

T, P = F.col("t"), F.col("p")


def test_tokens_split_words_and_marks(value):
    assert value(tk.tokens(T), t="Don't stop: 3.5 naïve!") == ["Don", "'", "t", "stop", ":", "3", ".", "5", "naïve", "!"]
    assert value(tk.tokens(T), t="") == []
    assert value(tk.token_length(T), t="a, b") == 3


@pytest.mark.parametrize("text", ["", " ", "one", "a  b\tc.\n d ", "x y z\x85w", "dots. and. more.."])
def test_counts_follow_python(value, text):
    assert value(tk.spaced_words(T), t=text) == text.split()
    assert value(tk.sentence_pieces(T), t=text) == len(text.split("."))
    assert value(tk.space_pieces(T), t=text) == len(text.split(" "))
    assert value(tk.distinct_space_pieces(T), t=text) == len(set(text.lower().split(" ")))
    assert value(tk.num_chars(T), t=text) == len(text)
    words = text.split()
    expected = sum(map(len, words)) / len(words) if words else None
    assert value(tk.average_word_length(tk.spaced_words(T)), t=text) == expected


def test_punctuation(value):
    text = 'He said: "no" (twice)!'
    count = sum(text.count(c) for c in fv.PUNCTUATION_MARKS)
    assert value(tk.punctuation_share(T), t=text) == pytest.approx(count / len(text))
    assert value(tk.punctuation_share(T), t="") == 0.0
    assert value(tk.char_ratios(T), t="a,b,") == {",": 0.5}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("words", [[], ["a"], ["a", "b"], ["a", "b", "c"], list("abcab")])
def test_ngrams(value, words, n):
    expected = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    assert value(tk.ngrams(T, n), t=words) == expected


def test_clean_text_order_of_steps(value):
    text = "See https://x.org/a?b=1 <b>bold</b>\U0001f600 café &amp; www.y.z 42!!  end"
    assert value(clean_text(T), t=text) == "See bold caf 42 end"
    assert value(clean_text(T), t="a<!-- x > y --><script>var i = 1 < 2;</script>b") == "ab"
    assert value(clean_text(T), t="2 < 3 and 5 > 4") == "2 3 and 5 4"


def test_stop_words_are_kept_by_default_and_case_matters(value):
    left, right = ["The", "the", "dog", "of"], ["the", "dog", "THE"]
    common = sorted(set(left) & set(right))
    assert value(ov.stop_word_overlap("t"), t=common) == 1
    assert value(ov.stop_word_overlap("t", "content"), t=common) == 1
    assert value(ov.stop_word_overlap("t"), t=["don't", "dont", "The"]) == 1
    with pytest.raises(ValueError):
        ov.stop_word_overlap("t", "other")


@pytest.mark.parametrize("length,n,expected", [(0, 2, 0.0), (1, 2, None), (2, 3, None), (5, 2, 0.0)])
def test_overlap_ratio_denominators(value, length, n, expected):
    got = value(ov.overlap_ratio(F.col("c"), F.col("l"), n), c=0, l=length)
    assert got == expected


def test_quotes(value):
    passage = "to be or not"
    q = ov.quoted_in(T, P)
    assert value(q, t="none", p=passage) == 0
    assert value(q, t='open " only', p=passage) == 0
    assert value(q, t='""', p=passage) == 1
    assert value(q, t='"be" and "be" and "bee"', p=passage) == 2


def test_bag_and_common_terms(value):
    left = ["b", "a", "b", "c"]
    assert [(e["term"], e["n"]) for e in value(ov.bag(T), t=left)] == [("a", 1), ("b", 2), ("c", 1)]
    assert value(ov.bag(T), t=[]) == []


@pytest.mark.parametrize("distinct", [3, ov._SCAN_LIMIT + 40])
def test_both_merge_strategies_agree_with_counting(value, distinct):
    left = [f"w{i % distinct}" for i in range(3 * distinct)] + ["only-left"]
    right = [f"w{i}" for i in range(0, distinct)] + ["only-right"] * 2
    a, c = Counter(left), Counter(right)
    common = value(ov.common_terms(ov.bag(T), ov.bag(P)), t=left, p=right)
    assert sorted((e["left"], e["right"]) for e in common) == sorted((a[w], c[w]) for w in a.keys() & c.keys())
    assert value(ov.covered_words(T, P), t=left, p=right) == sum(a[w] for w in a.keys() & c.keys())


def test_tfidf_of_two_texts(value):
    x, y = "the cat sat on the mat", "the dog sat"
    lt, rt = ov.bag(tk.terms(T)), ov.bag(tk.terms(P))
    got = value(ov.tfidf_cosine(lt, rt, ov.common_terms(lt, rt)), t=x, p=y)
    a, c = (Counter(re.findall(r"\w\w+", s)) for s in (x, y))
    idf = {w: 1.0 if w in a and w in c else 1.0 + math.log(1.5) for w in a | c}
    dot = sum(a[w] * c[w] * idf[w] ** 2 for w in a)
    norm = lambda m: math.sqrt(sum((n * idf[w]) ** 2 for w, n in m.items()))
    assert got == pytest.approx(dot / norm(a) / norm(c))
    assert value(ov.tfidf_cosine(lt, rt, ov.common_terms(lt, rt)), t="", p=y) == 0.0


def _syllables(word):
    return max(1, len(re.findall("[aeiouy]+", word.lower())))


@pytest.mark.parametrize(
    "text",
    ["", "  ", "Hi", "No end mark", "One. Two! Three?", "Beautiful education is an idea.\nRhythms: hmm, tsk 42 é.", "A.B. c"],
)
def test_readability_counts(value, text):
    words = re.findall(r"[^\W_]+", text)
    counts = value(rd.counts(T), t=text)
    assert counts["words"] == len(words)
    assert counts["syllables"] == sum(map(_syllables, words))
    assert counts["long_words"] == sum(_syllables(w) >= 3 for w in words)
    assert counts["sentences"] == (max(1, len(re.findall(r"[.!?]+(?:\s|\Z)", text))) if text.strip() else 0)
    for formula in (rd.reading_ease, rd.grade_level, rd.fog_index):
        got = value(formula(rd.counts(T)), t=text)
        assert got == 0.0 if not words else got != 0.0


def test_tags_first_rule_wins(value):
    tokens = ["The", "quickly", "running", "Dogs", "dogs", "glass", "42", "!", "must", "Paris", "help"]
    expected = ["DT", "RB", "VBG", "NNP", "NNS", "NN", "CD", "PUNCT", "MD", "NNP", "NN"]
    assert value(tagging.tags("t"), t=tokens) == expected
    assert value(tagging.mean_tag_share(tagging.distinct_tags("t")), t=tokens) == pytest.approx(1 / len(set(expected)))
    assert value(tagging.mean_tag_share(tagging.distinct_tags("t")), t=[]) is None


def test_lexicon_scores(value):
    lexicon = Lexicon()
    words = ["a", "good", "day", "not", "bad", "good"]
    known = lexicon.known("t")
    p = value(lexicon.polarity(known), t=words)
    assert (p["polarity"], p["subjectivity"]) == (pytest.approx((0.7 - 0.7 + 0.7) / 3), pytest.approx((0.6 + 0.667 + 0.6) / 3))
    v = value(lexicon.valence(known, F.size(T)), t=words)
    pos, neg, neu, x = 2 * 2.9, 3.5, 3, 1.9 * 2 - 2.5
    assert v["pos"] == pytest.approx(pos / (pos + neg + neu))
    assert v["neg"] == pytest.approx(neg / (pos + neg + neu))
    assert v["compound"] == pytest.approx(x / math.sqrt(x * x + 15))
    assert tuple(value(lexicon.valence(known, F.size(T)), t=[])) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(value(lexicon.polarity(known), t=["zzz"])) == (0.0, 0.0)
