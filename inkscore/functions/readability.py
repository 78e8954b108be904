"""Sentence, word and syllable counts and the formulas on top of them.

A word is a run of letters, marks and digits. It has one syllable per group of
vowels and at least one. All counts come from the whole text in a few regular
expression passes; words are not looked at one by one. Words whose syllables do not
follow the rule are corrected by the difference (``corrected``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .lets import ratio, total

VOWELS = "aeiouyAEIOUY"
_OTHER = rf"[{fv.WORD_CHARS}&&[^{VOWELS}]]"
_START = rf"(?<![{fv.WORD_CHARS}])"
VOWEL_GROUP = rf"[{VOWELS}]+"
VOWELLESS_WORD = rf"{_START}{_OTHER}++(?![{VOWELS}])"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def words(text: Column) -> Column:
    return _count(text, fv.WORD_PATTERN)


def sentences(text: Column) -> Column:
    """Runs of closing marks before whitespace or the end; at least 1 unless blank."""
    blank = ~F.regexp_like(text, F.lit(fv.SPACED_WORD_PATTERN))
    return F.when(blank, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), _count(text, fv.SENTENCE_END_PATTERN))
    )


def syllables(text: Column) -> Column:
    return _count(text, VOWEL_GROUP) + _count(text, VOWELLESS_WORD)


def long_words(text: Column, at_least: int = fv.COMPLEX_WORD_SYLLABLES) -> Column:
    """Words with ``at_least`` or more syllables."""
    if at_least <= 1:
        return words(text)
    return _count(text, rf"{_START}(?:{_OTHER}*+[{VOWELS}]++){{{at_least}}}")


def counts(text: Column) -> Column:
    """All four counts as one struct, so that the formulas share them."""
    return F.struct(
        sentences(text).alias("sentences"),
        words(text).alias("words"),
        syllables(text).alias("syllables"),
        long_words(text).alias("long_words"),
    )


def corrected(c: Column, known: Column) -> Column:
    """The counts with the syllables that ``known`` words have by a table instead of by the rule."""
    own = F.filter(known, lambda e: e["syllables"].isNotNull())

    def long(n: Column) -> Column:
        return (n >= fv.COMPLEX_WORD_SYLLABLES).cast("bigint")

    return F.struct(
        c["sentences"].alias("sentences"),
        c["words"].alias("words"),
        (c["syllables"] + total(F.transform(own, lambda e: e["n"] * (e["syllables"] - e["rule"])))).alias("syllables"),
        (c["long_words"] + total(F.transform(own, lambda e: e["n"] * (long(e["syllables"]) - long(e["rule"]))))).alias("long_words"),
    )


def _guarded(c: Column, formula: Column) -> Column:
    empty = (c["sentences"] == 0) | (c["words"] == 0)
    return F.when(c.isNull(), None).when(empty, F.lit(0.0)).otherwise(formula)


def reading_ease(c: Column) -> Column:
    return _guarded(
        c,
        F.lit(fv.EASE_BASE)
        - fv.EASE_PER_SENTENCE * ratio(c["words"], c["sentences"])
        - fv.EASE_PER_WORD * ratio(c["syllables"], c["words"]),
    )


def grade_level(c: Column) -> Column:
    return _guarded(
        c,
        fv.GRADE_PER_SENTENCE * ratio(c["words"], c["sentences"])
        + fv.GRADE_PER_WORD * ratio(c["syllables"], c["words"])
        - fv.GRADE_BASE,
    )


def fog_index(c: Column) -> Column:
    return _guarded(
        c,
        fv.FOG_FACTOR * (ratio(c["words"], c["sentences"]) + 100.0 * ratio(c["long_words"], c["words"])),
    )
