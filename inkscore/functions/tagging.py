"""Part-of-speech tags from an ordered rule table, as one native CASE expression."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby, takewhile

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import DEFAULT_TAG, TAG_RULES, WORD_CHARS
from .lets import long_size, ratio, sql_list, sql_text

# t is the token as written, w the lower-cased token.
_TESTS = {
    "word": lambda values: f"w IN ({sql_list(values)})",
    "suffix": lambda values: "(" + " OR ".join(f"endswith(w, {sql_text(v)})" for v in values) + ")",
    "capital": lambda _: "ascii(t) <> ascii(w)",
    # The first test is cheap and settles nearly every token.
    "number": lambda _: f"NOT ascii(t) BETWEEN 58 AND 127 AND t RLIKE {sql_text(r'^' + chr(92) + 'p{N}+$')}",
    "mark": lambda _: f"length(t) = 1 AND t RLIKE {sql_text('[^' + WORD_CHARS + ']')}",
}


def _case(rules: Sequence[tuple], otherwise: str) -> str:
    if not rules:
        return otherwise
    lines = " ".join(f"WHEN {_TESTS[kind](values)} THEN {sql_text(name)}" for kind, values, name in rules)
    return f"CASE {lines} ELSE {otherwise} END"


def _ends_like(suffixes: Sequence[str]) -> str:
    """Necessary condition for any of the suffixes: its last two letters (or its only one)."""
    short = sorted({s for s in suffixes if len(s) == 1})
    pairs = sorted({s[-2:] for s in suffixes if len(s) > 1 and s[-1] not in short})
    tests = [f"endswith(w, {sql_text(s)})" for s in short]
    return " OR ".join(([f"right(w, 2) IN ({sql_list(pairs)})"] if pairs else []) + tests)


def tag_expression(rules: Sequence[tuple] = TAG_RULES, default: str = DEFAULT_TAG) -> str:
    """SQL text of the tag of one token; the first matching rule decides.

    A leading block of word lists sits behind one hashed membership test, and each
    run of suffix rules behind a test of the last letters, so that most tokens skip
    them whole.
    """
    lists = list(takewhile(lambda rule: rule[0] == "word", rules))
    decided = sql_text(default)
    for kind, block in reversed([(k, list(g)) for k, g in groupby(rules[len(lists) :], key=lambda rule: rule[0])]):
        inner = _case(block, decided)
        if kind == "suffix":
            test = _ends_like([v for _, values, _ in block for v in values])
            inner = f"CASE WHEN {test} THEN {inner} ELSE {decided} END"
        decided = inner
    if not lists:
        return decided
    listed = sql_list([w for _, values, _ in lists for w in values])
    return f"CASE WHEN w IN ({listed}) THEN {_case(lists, sql_text(default))} ELSE {decided} END"


def tags(token_column: str, rules: Sequence[tuple] = TAG_RULES) -> Column:
    """Tags of the tokens in the array column of that name, in order."""
    lowered = f"transform({token_column}, t -> lower(t))"
    return F.expr(f"zip_with({token_column}, {lowered}, (t, w) -> {tag_expression(rules)})")


def distinct_tags(token_column: str, rules: Sequence[tuple] = TAG_RULES) -> Column:
    """The tags that occur. A tag depends on the token alone, so distinct tokens will do."""
    return F.array_distinct(tags(token_column, rules))


def mean_tag_share(tag_array: Column) -> Column:
    """Mean of the shares of the tags that occur; the shares add up to 1."""
    return ratio(F.lit(1.0), long_size(F.array_distinct(tag_array)))
