"""Values of single words from tables of any size, brought into the row that the words stand in.

Lexicon scores and irregular syllables are looked up once per answer and distinct word: an answer's words travel as
(key, word, number), only those that the table knows come back, and they come back as one sorted array per answer. The
features then read that array inside the row (``functions.lexicons.RowLexicon``, ``functions.readability.corrected``), so
nothing in the feature plan grows with the table. A table of up to ``table_bytes`` is broadcast and the corpus is cut into
words once; of a larger one only the words that occur in the corpus are kept first.

Words are looked up in lower case and must stand so in the tables. A word that a table repeats has its greatest values; a
NULL word is ignored, a NULL value counts as none. Keys must be unique; rows without key get no values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import overlap as ov
from ..functions import readability as rd
from ..functions import tokens as tk
from ..functions.lexicons import ROW_VALUES, SCORED
from ..session import materialise, measured_bytes
from .joins import BROADCAST_BYTES, lookup_join


def word_table(lexicon: DataFrame | None = None, irregular: DataFrame | None = None) -> DataFrame:
    """Scores (word, polarity, subjectivity, valence) and syllables (word, syllables) side by side, a row per word."""
    parts = [t for t in (lexicon, irregular) if t is not None]
    if not parts:
        raise ValueError("a lexicon or irregular syllables are needed")

    def typed(table: DataFrame) -> DataFrame:
        return table.select("word", *[(F.col(n) if n in table.columns else F.lit(None)).cast(kind).alias(n) for n, kind in ROW_VALUES])

    rows = typed(parts[0]) if len(parts) == 1 else typed(parts[0]).unionByName(typed(parts[1]))
    merged = rows.where("word IS NOT NULL").groupBy("word").agg(*[F.max(n).alias(n) for n, _ in ROW_VALUES])
    return materialise(merged.withColumn("rule", rd.syllables(F.col("word"))), "word-values")


def scored_words(docs: DataFrame, table: DataFrame, key: str, text: str, table_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, _scored): the answer's words that the table knows, with how often they stand there and their values."""
    bags = docs.select(key, F.inline(ov.bag(tk.lowered_words(F.col(text))))).withColumnRenamed("term", "word")
    if measured_bytes(table) > table_bytes:
        table = materialise(table.join(bags.select("word").distinct(), "word", "left_semi"), "corpus-word-values")
    found = lookup_join(bags, table, "word", "inner", spread_by=key, broadcast_bytes=table_bytes)
    entry = F.struct("word", "n", *[n for n, _ in ROW_VALUES], "rule")
    return found.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias(SCORED))


def attach(docs: DataFrame, table: DataFrame, key: str, text: str, table_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``_scored``. Raw texts are what the join moves; everything derived of them is made afterwards."""
    return docs.join(scored_words(docs, table, key, text, table_bytes), key, "left")
