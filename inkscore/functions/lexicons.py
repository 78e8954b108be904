"""Word-score lookups against a lexicon small enough to be part of the plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .lets import let, ratio, sql_list, total

Entry = tuple[str, float, float, float]

#: The column that holds an answer's known words, and the values that each has (see ``operators.word_values``).
SCORED = "_scored"
ROW_VALUES = (("polarity", "double"), ("subjectivity", "double"), ("valence", "double"), ("syllables", "bigint"))
_KNOWN_TYPE = f"array<struct<word: string, n: bigint, {', '.join(f'{n}: {kind}' for n, kind in ROW_VALUES)}, rule: bigint>>"


class Lexicon:
    """Entries (word, polarity, subjectivity, valence) held as literals of the plan.

    Membership is a hashed set test on each word. Only the few words that are in
    the lexicon go on to the score lookup.
    """

    def __init__(self, entries: Iterable[Entry] = fv.BUILTIN_LEXICON):
        self.entries = {word: (float(p), float(s), float(v)) for word, p, s, v in entries}

    def __repr__(self) -> str:
        """All entries: what is made with one lexicon is not found under another (``sources.tables.fingerprint``)."""
        return f"Lexicon({sorted(self.entries.items())!r})"

    def known(self, word_column: str) -> Column:
        """The words of that array column that are in the lexicon, repeats kept."""
        return F.expr(f"filter({word_column}, w -> w IN ({sql_list(self.entries) or 'NULL'}))")

    def _score(self, word: Column, position: int) -> Column:
        """Score of a known word, from a constant map."""
        words = sql_list(self.entries)
        scores = ", ".join(f"{scores[position]!r}D" for scores in self.entries.values())
        table = f"map_from_arrays(array({words}), array({scores}))" if self.entries else "cast(map() AS map<string, double>)"
        return F.coalesce(F.try_element_at(F.expr(table), word), F.lit(0.0))

    def polarity(self, known: Column) -> Column:
        """Struct of mean polarity and mean subjectivity of the ``known`` words, 0 without any."""

        def mean(position: int) -> Column:
            scores = F.transform(known, lambda w: self._score(w, position))
            return F.when(known.isNotNull(), F.coalesce(ratio(total(scores, F.lit(0.0)), F.size(known)), F.lit(0.0)))

        return F.struct(mean(0).alias("polarity"), mean(1).alias("subjectivity"))

    def valence(self, known: Column, n_words: Column) -> Column:
        """Struct of negative, neutral and positive shares and the compound score.

        ``n_words`` counts all words of the text; those without a score are neutral.
        """
        scores = F.transform(known, lambda w: self._score(w, 2))

        def shares(hits: Column) -> Column:
            return valence_struct(
                positive=total(F.transform(F.filter(hits, lambda v: v > 0), lambda v: v + 1.0), F.lit(0.0)),
                negative=total(F.transform(F.filter(hits, lambda v: v < 0), lambda v: 1.0 - v), F.lit(0.0)),
                neutral=(n_words - F.size(F.filter(hits, lambda v: v != 0))).cast("double"),
                valence=total(hits, F.lit(0.0)),
            )

        return let(scores, shares)


def valence_struct(positive: Column, negative: Column, neutral: Column, valence: Column) -> Column:
    """Shares of three weights and x / sqrt(x^2 + alpha); zeros for a text without words."""
    weight = positive + negative + neutral

    def share(part: Column) -> Column:
        return F.when(weight.isNotNull(), F.coalesce(F.try_divide(part, weight), F.lit(0.0)))

    return F.struct(
        share(negative).alias("neg"),
        share(neutral).alias("neu"),
        share(positive).alias("pos"),
        (valence / F.sqrt(valence * valence + F.lit(fv.COMPOUND_ALPHA))).alias("compound"),
    )


def known_words(word_column: str) -> Column:
    """The array of known words and their values; empty where there are none, NULL where there is no text."""
    return F.when(F.col(word_column).isNotNull(), F.coalesce(F.col(SCORED), F.array().cast(_KNOWN_TYPE)))


class RowLexicon:
    """The scores of ``Lexicon`` from words and values that stand in the row already, for tables of any size."""

    def known(self, word_column: str) -> Column:
        return known_words(word_column)

    def polarity(self, known: Column) -> Column:
        """Struct of mean polarity and mean subjectivity over all known words, 0 without any."""

        def mean(name: str) -> Column:
            own = F.filter(known, lambda e: e[name].isNotNull())
            sums = total(F.transform(own, lambda e: e["n"] * e[name]), F.lit(0.0))
            return F.when(known.isNotNull(), F.coalesce(ratio(sums, total(F.transform(own, lambda e: e["n"]))), F.lit(0.0)))

        return F.struct(mean("polarity").alias("polarity"), mean("subjectivity").alias("subjectivity"))

    def valence(self, known: Column, n_words: Column) -> Column:
        """As ``Lexicon.valence``."""

        def weighed(keep, weight) -> Column:
            return total(F.transform(F.filter(known, lambda e: keep(e["valence"])), lambda e: e["n"] * weight(e["valence"])), F.lit(0.0))

        return valence_struct(
            positive=weighed(lambda v: v > 0, lambda v: v + 1.0),
            negative=weighed(lambda v: v < 0, lambda v: 1.0 - v),
            neutral=n_words - weighed(lambda v: v != 0, lambda v: F.lit(1.0)),
            valence=weighed(lambda v: v != 0, lambda v: v),
        )
