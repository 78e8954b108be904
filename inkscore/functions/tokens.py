"""Tokens, counts and n-grams of one text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .lets import let, long_size, ratio


def tokens(text: Column) -> Column:
    """Words (letters, marks, digits) and single other characters, in order."""
    return F.regexp_extract_all(text, F.lit(fv.TOKEN_PATTERN), F.lit(0))


def token_length(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fv.TOKEN_PATTERN)).cast("bigint")


def spaced_words(text: Column) -> Column:
    """Pieces between whitespace runs; never contains the empty string."""
    return F.regexp_extract_all(text, F.lit(fv.SPACED_WORD_PATTERN), F.lit(0))


def lowered_words(text: Column) -> Column:
    """All lower-cased words, the unit of the lexicon scores and of the dictionary."""
    return F.regexp_extract_all(F.lower(text), F.lit(fv.WORD_PATTERN), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased words of at least two characters, the unit of tf-idf."""
    return F.regexp_extract_all(F.lower(text), F.lit(fv.TERM_PATTERN), F.lit(0))


def truncate(token_array: Column, max_length: int) -> Column:
    return F.slice(token_array, 1, max_length)


def distinct_count(array: Column) -> Column:
    return long_size(F.array_distinct(array))


def count_char(text: Column, char: str) -> Column:
    """Occurrences of one character, without a regular expression."""
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("bigint")


def count_any(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def sentence_pieces(text: Column) -> Column:
    """Number of pieces when the text is cut at every full stop."""
    return count_char(text, ".") + 1


def space_pieces(text: Column) -> Column:
    """Number of pieces when the text is cut at every single space."""
    return count_char(text, " ") + 1


def distinct_space_pieces(text: Column) -> Column:
    """Distinct lower-cased pieces between single spaces, the empty one included."""
    return distinct_count(F.split(F.lower(text), F.lit(" ")))


def num_chars(text: Column) -> Column:
    return F.length(text).cast("bigint")


def average_word_length(words: Column) -> Column:
    """Characters per word of an array of words; NULL for a text without words."""
    return ratio(F.length(F.array_join(words, "")), F.size(words))


def punctuation_share(text: Column) -> Column:
    """Share of the characters that are punctuation marks; 0 for an empty text."""
    return F.coalesce(ratio(count_any(text, fv.PUNCTUATION_MARKS), F.length(text)), F.when(text.isNotNull(), F.lit(0.0)))


def char_ratios(text: Column, chars: str = fv.PUNCTUATION_MARKS) -> Column:
    """Map from every mark that occurs in the text to its share of the characters."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("mark"), ratio(count_char(text, c), F.length(text)).alias("share"))
            for c in chars
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["share"] > 0))


def widen(grams: Column, token_array: Column, n: int) -> Column:
    """n-grams from the (n-1)-grams of the same tokens: each takes its next token."""
    width = F.greatest(F.size(token_array) - F.lit(n - 1), F.lit(0))
    return F.zip_with(
        F.slice(grams, F.lit(1), width),
        F.slice(token_array, F.lit(n), width),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )


def ngrams(token_array: Column, n: int) -> Column:
    """Space-joined n-grams, built by zipping shifted copies; empty for short arrays."""

    def build(t: Column) -> Column:
        grams = t
        for k in range(2, n + 1):
            grams = widen(grams, t, k)
        return grams

    return let(token_array, build)
