"""Dictionary, misspelling counts and autocorrection as corpus-level joins.

Words are corrected once per distinct word of the corpus. Documents only ever
exchange their distinct unknown words; the tokens of a text never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import tokens as tk
from ..session import materialise, spread
from .joins import lookup_join

# Correctable words: those that are nothing but plain letters. Accented words and their parts are left alone.
LETTER_RUN = r"[a-zA-Z]+"
# Words longer than this are matched by shared segments, shorter ones by deletions.
LONG_WORD = 24
# Pairs of words that one task compares at a key; a key with more is split.
PAIRS_OF_A_KEY = 200_000
NUMBER_PATTERN = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def corpus_vocabulary(texts: DataFrame, text: str = "text", *, min_count: int) -> DataFrame:
    """(word, freq): lower-cased words of a corpus seen at least ``min_count`` times; 1 keeps all."""
    words = texts.select(F.explode(tk.lowered_words(F.col(text))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return counted.where(F.col("freq") >= min_count)


def augment_vocabulary(base: DataFrame, prompts: DataFrame, text: str = "prompt_text") -> DataFrame:
    """Set every passage token, for all passages at once, to a fixed frequency, whatever the base says."""
    passage = (
        prompts.select(F.explode(tk.tokens(F.lower(text))).alias("word"))
        .distinct()
        .withColumn("fixed", F.lit(fv.PASSAGE_WORD_FREQUENCY).cast("bigint"))
    )
    merged = base.select("word", F.col("freq").cast("bigint").alias("freq")).unionByName(passage, allowMissingColumns=True)
    return merged.groupBy("word").agg(F.coalesce(F.max("fixed"), F.max("freq")).alias("freq"))


def dictionary(base: DataFrame, prompts: DataFrame) -> DataFrame:
    """The augmented dictionary, written once because every spelling step reads it."""
    return materialise(augment_vocabulary(base, prompts), "dictionary")


def is_checked(word: Column) -> Column:
    """Whether a lower-cased whitespace word is neither a number nor a lone ASCII mark."""
    return ~F.regexp_like(word, F.lit(NUMBER_PATTERN)) & ~F.regexp_like(word, F.lit(r"^[!-/:-@\[-`{-~]$"))


def spelling_errors(docs: DataFrame, vocabulary: DataFrame, key: str = "student_id", text: str = "text") -> DataFrame:
    """(key, spelling_errors): distinct words missing in the dictionary; punctuation stays attached.

    Only words that are missing are looked at for numbers and lone marks, which are never errors.
    """
    pairs = docs.select(key, F.explode_outer(F.array_distinct(tk.spaced_words(F.lower(F.col(text))))).alias("word"))
    known = vocabulary.select("word", F.lit(True).alias("known"))
    flagged = lookup_join(pairs, known, "word", "left", spread_by=key)
    missing = F.col("word").isNotNull() & F.col("known").isNull() & is_checked(F.col("word"))
    return flagged.groupBy(key).agg(F.count_if(missing).alias("spelling_errors"))


def letter_words(text: Column) -> Column:
    """Distinct words of a text that consist of plain letters only."""
    words = F.regexp_extract_all(text, F.lit(fv.WORD_PATTERN), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.regexp_like(w, F.lit(rf"^{LETTER_RUN}$"))))


def oov_words(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """Distinct lower-cased letter words of a corpus that the dictionary lacks."""
    words = docs.select(F.explode(letter_words(F.lower(text))).alias("word")).distinct()
    return lookup_join(words, vocabulary.select("word"), "word", "left_anti", spread_by=[])


def _deletions(word: Column, distance: int) -> Column:
    """The word and everything reachable by deleting one or (``distance`` 2) two letters."""
    n = F.length(word)

    def each(first: Column, body) -> Column:
        places = F.when(first <= n, F.sequence(first, n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, body)

    def drop_one(i: Column) -> Column:
        return F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n))

    def drop_two(i: Column) -> Column:
        # Letters i and j + 1 go; j = n stands for letter i alone.
        return each(
            i,
            lambda j: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, j - i), F.substr(word, j + 2, n)),
        )

    shorter = each(F.lit(1), drop_one) if distance == 1 else F.flatten(each(F.lit(1), drop_two))
    return F.array_distinct(F.concat(F.array(word), shorter))


def _segments(word: Column, distance: int, shifts: bool) -> Column:
    """Keys (length, number, segment) of a long word cut into 2 x distance + 1 parts.

    One edit, even a swap of neighbours, changes at most two parts, so two words
    within ``distance`` agree in at least one whole part, moved by at most
    ``distance`` places. The unknown word (``shifts``) looks for parts of all
    lengths and places in question.
    """
    parts = 2 * distance + 1
    moves = F.sequence(F.lit(-distance), F.lit(distance)) if shifts else F.array(F.lit(0))

    def key(length: Column, k: Column, shift: Column) -> Column:
        start = F.floor(length * k / parts).cast("int")
        stop = F.floor(length * (k + 1) / parts).cast("int")
        first = start + 1 + shift
        part = F.when(first >= 1, F.substr(word, first, stop - start)).otherwise(F.lit(""))
        return F.concat_ws(":", length.cast("string"), k.cast("string"), part)

    def of_length(length: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.transform(moves, lambda m: key(length, k, m))
            )
        )

    return F.array_distinct(F.flatten(F.transform(moves, lambda grow: of_length(F.length(word) + grow))))


def _swaps(word: Column) -> Column:
    """The word with each pair of neighbouring letters swapped."""
    places = F.when(F.length(word) > 1, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        places,
        lambda i: F.concat(
            F.substr(word, F.lit(1), i - 1),
            F.substr(word, i + 1, F.lit(1)),
            F.substr(word, i, F.lit(1)),
            F.substr(word, i + 2, F.length(word)),
        ),
    )


def _letters(word: Column) -> Column:
    """The word's letters in order; swaps leave it as it is."""
    return F.array_join(F.sort_array(F.split(word, "")), "")


def within(word: Column, candidate: Column, distance: int) -> Column:
    """At most ``distance`` inserted, deleted, replaced or swapped letters (1 or 2).

    Swaps are tried only where the letters of both words allow them: all equal for
    swaps alone, one exchanged, added or missing for a swap and another edit.
    """
    close = F.levenshtein(word, candidate, distance) >= 0
    same_letters = _letters(word) == _letters(candidate)
    if distance == 1:
        return close | (same_letters & F.array_contains(_swaps(word), candidate))
    alike = F.levenshtein(_letters(word), _letters(candidate), 2) >= 0
    swap_then_edit = F.exists(_swaps(word), lambda s: F.levenshtein(s, candidate, 1) >= 0)
    edit_then_swap = F.exists(_swaps(candidate), lambda s: F.levenshtein(word, s, 1) >= 0)
    two_swaps = F.arrays_overlap(_swaps(word), _swaps(candidate))
    return close | (alike & (swap_then_edit | edit_then_swap)) | (same_letters & two_swaps)


def correction_candidates(oov: DataFrame, vocabulary: DataFrame, distance: int = 1) -> DataFrame:
    """(word, candidate, freq): dictionary words within ``distance`` edits of each unknown word.

    Both sides are keyed by their deletion neighbourhoods and joined on equality,
    so no word is compared with the whole dictionary. Unknown words whose length
    is out of reach of every dictionary word are discarded before they are keyed.
    Both inputs are read several times and should be written tables.
    """
    rows = max(oov.count(), vocabulary.count())
    entries = vocabulary.where(F.regexp_like("word", F.lit(rf"^{LETTER_RUN}$"))).select(
        F.col("word").alias("candidate"), "freq"
    )
    entries = spread(entries, "candidate", rows=rows)
    reach = entries.select(
        F.explode(F.sequence(F.length("candidate") - distance, F.length("candidate") + distance)).alias("size")
    ).distinct()
    eligible = oov.select("word", F.length("word").alias("size")).join(reach, "size", "left_semi").select("word")
    eligible = spread(eligible, "word", rows=rows)

    pairs = _keyed_pairs(
        eligible.where(F.length("word") <= LONG_WORD + distance).select(
            "word", F.explode(_deletions(F.col("word"), distance)).alias("key")
        ),
        entries.where(F.length("candidate") <= LONG_WORD).select(
            "candidate", "freq", F.explode(_deletions(F.col("candidate"), distance)).alias("key")
        ),
        rows,
    ).unionByName(
        _keyed_pairs(
            eligible.where(F.length("word") > LONG_WORD - distance).select(
                "word", F.explode(_segments(F.col("word"), distance, True)).alias("key")
            ),
            entries.where(F.length("candidate") > LONG_WORD).select(
                "candidate", "freq", F.explode(_segments(F.col("candidate"), distance, False)).alias("key")
            ),
            rows,
        )
    )
    near = pairs.where(F.abs(F.length("word") - F.length("candidate")) <= distance).where(
        within(F.col("word"), F.col("candidate"), distance)
    )
    return near.groupBy("word", "candidate").agg(F.max("freq").alias("freq"))


def heavy_keys(left: DataFrame, right: DataFrame, pairs: int, buckets: int = 1 << 20) -> DataFrame:
    """(key, shares) of the keys at which more than ``pairs`` pairs meet: at most all pairs / ``pairs`` rows.

    Rows are counted by ``buckets`` hashes of the key first, which bounds the pairs of every key from above; keys themselves are
    counted in the buckets that may hold a heavy one.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")

    def counted(by, words: DataFrame, entries: DataFrame) -> DataFrame:
        words = words.groupBy(by).agg(F.count("*").alias("words"))
        entries = entries.groupBy(by).agg(F.count("*").alias("entries"))
        both = words.join(entries, words.columns[0])
        return both.withColumn("shares", F.ceil(F.col("words") * F.col("entries") / pairs).cast("int")).where("shares > 1")

    open_ = materialise(counted("bucket", left.select(bucket), right.select(bucket)).select("bucket"), "heavy-buckets")
    some = [lookup_join(side.select("key", bucket), open_, "bucket", "left_semi", spread_by="key") for side in (left, right)]
    return counted("key", *some).select("key", "shares")


def _keyed_pairs(left: DataFrame, right: DataFrame, rows: int, pairs: int | None = None) -> DataFrame:
    """Words and candidates of equal keys. Only a heavy key is split: its words are dealt to shares, its candidates go to all."""
    heavy = materialise(heavy_keys(left, right, PAIRS_OF_A_KEY if pairs is None else pairs), "heavy-keys")
    words = lookup_join(left, heavy, "key", "left", spread_by="word")
    entries = lookup_join(right, heavy, "key", "left", spread_by="candidate")
    share = F.pmod(F.xxhash64("word"), F.coalesce(F.col("shares"), F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1))
    words = words.select("word", "key", share.alias("share"))
    entries = entries.select("candidate", "freq", "key", copies.alias("share"))
    return spread(words, "key", "share", rows=rows).join(spread(entries, "key", "share", rows=rows), ["key", "share"]).select("word", "candidate", "freq")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """(word, correction): the most frequent candidate, ties to the greater word."""
    return candidates.groupBy("word").agg(
        F.max_by("candidate", F.struct("freq", "candidate")).alias("correction")
    )


def corrections(oov: DataFrame, vocabulary: DataFrame, max_distance: int = 2) -> DataFrame:
    """(word, correction): nearest distance first, then frequency.

    Words with a candidate one edit away never look further.
    """
    # Every table here is read more than once; none may reach back to the corpus.
    oov = materialise(oov, "oov")
    found = best_candidates(correction_candidates(oov, vocabulary, 1))
    if max_distance == 1:
        return found
    found = materialise(found, "corrections-1")
    rest = materialise(oov.join(found, "word", "left_anti"), "oov-2")
    return found.unionByName(best_candidates(correction_candidates(rest, vocabulary, max_distance)))


def _with_case_of(original: Column, replacement: Column) -> Column:
    first = F.substr(original, F.lit(1), F.lit(1))
    capital = F.regexp_like(first, F.lit("[A-Z]"))
    return F.when(
        capital, F.concat(F.upper(F.substr(replacement, F.lit(1), F.lit(1))), F.substr(replacement, F.lit(2)))
    ).otherwise(replacement)


def apply_corrections(
    docs: DataFrame, table: DataFrame, key: str = "student_id", text: str = "text", out: str = "fixed_summary_text"
) -> DataFrame:
    """``docs`` with ``out``: every misspelt word replaced, all other characters kept.

    Only a document's distinct misspelt words are joined and grouped. The rewrite
    itself walks the words inside the row. Rows are dealt to many tasks first, as what follows costs far more than moving them.
    """
    docs = spread(docs, key, rows=docs.count(), rows_per_task=1000)
    pairs = docs.select(key, F.explode(letter_words(F.lower(text))).alias("word"))
    hits = lookup_join(pairs, table, "word", "inner", spread_by=key)
    # Bounded by the distinct words of one document.
    per_doc = hits.groupBy(key).agg(F.collect_list(F.struct("word", "correction")).alias("_pairs"))
    pieces = F.regexp_extract_all(text, F.lit(rf"{fv.WORD_PATTERN}|[^{fv.WORD_CHARS}]+"), F.lit(0))
    fixes, misspelt = F.col("_fixes"), F.col("_misspelt")

    def fix(piece: Column) -> Column:
        # Cheap tests first: spaces and most marks sort before the letters.
        hit = (F.ascii(piece) > 64) & F.array_contains(misspelt, F.lower(piece))
        return F.when(hit, _with_case_of(piece, F.try_element_at(fixes, F.lower(piece)))).otherwise(piece)

    rewritten = F.when(fixes.isNull(), F.col(text)).otherwise(F.array_join(F.transform(pieces, fix), ""))
    return (
        docs.join(per_doc, key, "left")
        .withColumns({"_fixes": F.map_from_entries("_pairs"), "_misspelt": F.transform("_pairs", lambda p: p["word"])})
        .withColumn(out, rewritten)
        .drop("_pairs", "_fixes", "_misspelt")
    )


def autocorrect(
    docs: DataFrame,
    vocabulary: DataFrame,
    key: str = "student_id",
    text: str = "text",
    out: str = "fixed_summary_text",
    max_distance: int = 2,
) -> DataFrame:
    table = materialise(corrections(oov_words(docs, vocabulary, text), vocabulary, max_distance), "corrections")
    return apply_corrections(docs, table, key, text, out)
