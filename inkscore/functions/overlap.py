"""What an answer shares with its passage: words, n-grams, quotes, weighted terms.

Everything is row-local. Word multisets are compared as *bags*: sorted arrays of
(term, n) structs, merged by one sort, so the cost is O(n log n) per pair even
for very long texts and no token ever leaves its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .lets import let, long_size, ratio, sql_list, total

STOP, CONTENT = "stop", "content"


def stop_word_overlap(common_column: str, keep: str = STOP) -> Column:
    """How many of the distinct common tokens in that column are stop words, or are not.

    The comparison is case-sensitive. ``keep='stop'`` is the default.
    """
    if keep not in (STOP, CONTENT):
        raise ValueError(f"keep must be {STOP!r} or {CONTENT!r}")
    test = "IN" if keep == STOP else "NOT IN"
    return long_size(F.expr(f"filter({common_column}, w -> w {test} ({sql_list(fv.STOP_WORDS)}))"))


def common_count(left: Column, right: Column) -> Column:
    """Number of distinct common elements of two arrays."""
    return long_size(F.array_intersect(left, right))


def overlap_ratio(common: Column, length: Column, n: int) -> Column:
    """Common n-grams per possible n-gram position of the answer."""
    return ratio(common, length - (n - 1))


def jaccard(common: Column, left: Column, right: Column) -> Column:
    """From the common elements of two arrays of distinct elements."""
    return ratio(F.size(common), F.size(left) + F.size(right) - F.size(common))


def quoted_in(text: Column, passage: Column) -> Column:
    """Quoted spans of the text that occur verbatim in the passage, repeats counted."""
    spans = F.regexp_extract_all(text, F.lit(fv.QUOTE_PATTERN), F.lit(1))
    return long_size(F.filter(spans, lambda q: F.contains(passage, q)))


def bag(items: Column) -> Column:
    """Sorted array of (term, n): the distinct items with their frequencies."""

    def runs(s: Column) -> Column:
        positions = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(
            positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0))))
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda p, k: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("bigint").alias("n"),
                ),
            ),
        )

    return let(F.sort_array(items), runs)


# Up to this many common terms a scan of the bags beats sorting them together.
_SCAN_LIMIT = 64


def _merged(left_bag: Column, right_bag: Column) -> Column:
    """Common terms by one sort of both bags: equal terms become neighbours."""

    def sided(entries: Column, side: int) -> Column:
        return F.transform(
            entries, lambda e: F.struct(e["term"].alias("term"), F.lit(side).alias("side"), e["n"].alias("n"))
        )

    def neighbours(m: Column) -> Column:
        width = F.greatest(F.size(m) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(m, F.lit(1), width),
            F.slice(m, F.lit(2), width),
            lambda a, b: F.when(a["term"] == b["term"], F.struct(a["n"].alias("left"), b["n"].alias("right"))),
        )
        return F.filter(pairs, lambda p: p.isNotNull())

    return let(F.sort_array(F.concat(sided(left_bag, 0), sided(right_bag, 1))), neighbours)


def common_terms(left_bag: Column, right_bag: Column) -> Column:
    """Array of (left, right) frequencies, one entry per term present in both bags."""
    common = F.array_intersect(
        F.transform(left_bag, lambda e: e["term"]), F.transform(right_bag, lambda e: e["term"])
    )

    def pick(shared: Column) -> Column:
        # Bags are sorted, so both filtered bags list the same terms in the same order.
        scanned = F.zip_with(
            F.filter(left_bag, lambda e: F.array_contains(shared, e["term"])),
            F.filter(right_bag, lambda e: F.array_contains(shared, e["term"])),
            lambda a, b: F.struct(a["n"].alias("left"), b["n"].alias("right")),
        )
        return F.when(F.size(shared) > _SCAN_LIMIT, _merged(left_bag, right_bag)).otherwise(scanned)

    return let(common, pick)


def covered_words(words: Column, passage_words: Column) -> Column:
    """Number of words (repeats counted) that occur in the passage."""

    def scan(shared: Column) -> Column:
        return long_size(F.filter(words, lambda w: F.array_contains(shared, w)))

    def sort(shared: Column) -> Column:
        return total(F.transform(_merged(bag(words), bag(shared)), lambda p: p["left"]))

    return let(
        F.array_intersect(words, passage_words),
        lambda shared: F.when(F.size(shared) > _SCAN_LIMIT, sort(shared)).otherwise(scan(shared)),
    )


def keyword_density(covered: Column, word_count: Column) -> Column:
    """Share of the answer's words (repeats counted) that occur in the passage."""
    return ratio(covered, word_count)


# With two documents and smoothing, a term in both has idf 1, a term in one 1 + ln(3/2).
_RARE_IDF_SQUARED = (1.0 + math.log(1.5)) ** 2


def _squared_norm(all_terms: Column, common: Column, side: str) -> Column:
    everything = total(F.transform(all_terms, lambda e: e["n"] * e["n"])).cast("double")
    shared = total(F.transform(common, lambda p: p[side] * p[side])).cast("double")
    return shared + _RARE_IDF_SQUARED * (everything - shared)


def tfidf_cosine(left_bag: Column, right_bag: Column, common: Column) -> Column:
    """Cosine of tf-idf vectors fitted on just the two texts; 0 without common terms."""
    dot = total(F.transform(common, lambda p: p["left"] * p["right"])).cast("double")
    norms = F.sqrt(_squared_norm(left_bag, common, "left") * _squared_norm(right_bag, common, "right"))
    return F.coalesce(F.try_divide(dot, norms), F.when(dot.isNotNull(), F.lit(0.0)))
