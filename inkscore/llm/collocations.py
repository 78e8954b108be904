"""Phrase collocations counted over a prefix-free parse.

Texts are cut into pieces at punctuation and line ends, pieces into words. A parse cuts each piece into overlapping chunks:
a chunk begins with the piece or with a trigger word (one in ``TRIGGER``, by fingerprint, the same everywhere), at the latest
``LONGEST`` words after the last chunk began, and holds all words up to the next beginning and ``MOST - 1`` more. Since a
chunk ends at a place told by its own words, its text alone says how many of its words are its own. Distinct chunks with the
number of times they were parsed are the dictionary, one per language; a repeated passage gives its chunks once, however
many documents hold it. Phrases are counted inside the dictionary's chunks, weighted, each in the chunk that owns its first
word: so overlaps are counted once, and no phrase is lost, as a chunk reaches ``MOST - 1`` words beyond its own.

A phrase is as frequent as ``at_least`` only if all its parts are. Words are counted first; then pairs of frequent words;
then triples of two frequent pairs; then fours of two frequent triples. Each is counted once, as the numbers of its words: a
word's number is its fingerprint with its language, and another fingerprint is taken for all if any two words agree in one, so
counts are exact. No phrase's text is made until it is known to be frequent. What was frequent reaches the next count as a
bitmap of ``1 << bits`` places (4 MB as set, whatever the corpus): places may agree there and let a rare phrase through to be
counted, but none is lost.

Scores are quotients of decimals of 38 digits. Null languages are ``und``, null texts empty; repeated rows count as often as
they stand; an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkscore.llm.arrays import SLICE, flat, mix, slices, span_prints, stream, words
from inkscore.llm.bpe import ragged
from inkscore.operators.joins import lookup_join
from inkscore.session import materialise

MOST = 4  # words of the longest phrase
TRIGGER = 16
LONGEST = 64
PLACES = ["w1", "w2", "w3", "w4"][:MOST]
TURN = 21
U = np.uint64
TABLES = tuple(stream(k, 256) for k in (1, 51, 52, 53))  # values of bytes in the words' numbers, the next if two words agree
_LANG = stream(54, 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PIECE_ENDS = np.zeros(256, dtype=bool)
_PIECE_ENDS[[10, 11, 12, 13, *b".,;:!?"]] = True
_WORD_ENDS = _PIECE_ENDS.copy()
_WORD_ENDS[[9, 32]] = True
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[32] = True
_KEEP_ROWS = 1 << 20


def _texts(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The given spans of bytes as strings."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    content = data[ragged(begin, size)]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(content))).cast(pa.string())


class Tally:
    """Sums of ``n`` by the other columns, over batches until ``_KEEP_ROWS`` distinct rows are held."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.rows = names, [], 0

    def add(self, columns: list) -> Iterator[pa.RecordBatch]:
        self.parts.append(self._summed(pa.table(columns, names=self.names)))
        self.rows += self.parts[-1].num_rows
        if self.rows >= _KEEP_ROWS:
            whole = self._summed(pa.concat_tables(self.parts))
            self.parts, self.rows = [whole], whole.num_rows
            if self.rows >= _KEEP_ROWS // 2:  # little repeats: let them go
                yield from self.drain()

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            whole = self._summed(pa.concat_tables(self.parts))
            self.parts, self.rows = [], 0
            yield from whole.to_batches(max_chunksize=1 << 16)

    def _summed(self, table: pa.Table) -> pa.Table:
        keys = [c for c in self.names if c not in ("n", "print")]
        more = [("print", "min")] if "print" in self.names else []
        made = table.group_by(keys, use_threads=False).aggregate([("n", "sum"), *more])
        made = made.rename_columns([c.removesuffix("_sum").removesuffix("_min") for c in made.column_names])
        return made.select(self.names)


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: (lang, chunk, n), words in lower case with one space between; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(["lang", "chunk", "n"])
        for batch in slices(batches):
            data, offsets = flat(batch.column(1))
            if not len(data):
                continue
            data = _FOLD[data]
            starts, ends, first = words(data, offsets, _WORD_ENDS)
            if not len(starts):
                continue
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            breaks = np.cumsum(_PIECE_ENDS[data])[starts]
            opens = np.ones(len(starts), dtype=bool)
            opens[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
            prints = span_prints(data, starts, ends)
            begin = np.flatnonzero(opens | (prints % U(TRIGGER) == 0))
            long = np.diff(begin, append=len(starts))
            if (long > LONGEST).any():
                more = -(-long // LONGEST)
                begin = np.repeat(begin, more) + LONGEST * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more))
            piece_end = np.append(np.flatnonzero(opens)[1:], len(starts))[np.cumsum(opens) - 1]
            own = np.append(begin[1:], len(starts))
            end = np.minimum(own + MOST - 1, piece_end[begin])
            # words one after the other with a space behind each
            size = ends - starts + 1
            at = np.cumsum(size) - size
            spaced = np.full(int(size.sum()), 32, dtype=np.uint8)
            spaced[ragged(at, size - 1)] = data[ragged(starts, size - 1)]
            chunk = _texts(spaced, at[begin], at[end - 1] + size[end - 1] - 1 - at[begin])
            yield from tally.add([batch.column(0).take(pa.array(text[begin])), chunk, pa.array(np.ones(len(begin), np.int64))])
        yield from tally.drain()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(run, "lang string, chunk string, n bigint")
    return materialise(made.groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "chunks")


class Chunks:
    """A batch of the dictionary as words: where each stands, whether a chunk owns it, and its number."""

    def __init__(self, batch: pa.RecordBatch, values: np.ndarray):
        self.lang = batch.column(0)
        self.data, offsets = flat(batch.column(1))
        self.starts, self.ends, first = words(self.data, offsets, _BLANKS)
        number = np.diff(first)
        self.chunk = np.repeat(np.arange(batch.num_rows), number)
        self.left = np.repeat(first[1:], number) - np.arange(len(self.starts))  # words to the end of the chunk
        prints = span_prints(self.data, self.starts, self.ends)
        place = np.arange(len(self.starts)) - np.repeat(first[:-1], number)
        stops = ((prints % U(TRIGGER) == 0) | (place == LONGEST)) & (place > 0)
        before = np.cumsum(stops)
        self.owned = before == np.repeat(np.append(0, before)[first[:-1]], number)  # no later chunk began yet
        kinds = self.lang.dictionary_encode()
        data, offsets = flat(kinds.dictionary)
        of_lang = span_prints(data, offsets[:-1], offsets[1:]) if len(data) else np.zeros(len(offsets) - 1, U)
        of_lang = mix(of_lang + _LANG)  # a language's number is not that of the word of its name
        self.ids = mix(span_prints(self.data, self.starts, self.ends, values) ^ of_lang[np.asarray(kinds.indices)[self.chunk]])
        self.n = np.asarray(batch.column(2))

    def phrase_prints(self, n: int) -> np.ndarray:
        """What ``joint`` makes of the numbers of the ``n`` words from each word on; too few words give anything."""
        made = self.ids.copy()
        for k in range(1, n):
            made[: max(0, len(made) - k)] ^= self.ids[k:] << U(TURN * k) | self.ids[k:] >> U(64 - TURN * k)
        return made

    def standing(self, n: int) -> np.ndarray:
        """Words that ``n`` words of their chunk begin with, owned or not."""
        return self.left >= n

    def numbers(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.ids[at].view(np.int64))

    def weights(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.n[self.chunk[at]])


def _over(chunks: DataFrame, made: Callable[[Chunks], list], schema: str, values: np.ndarray) -> DataFrame:
    """Rows that ``made`` gives for each batch of the dictionary, summed within a task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(names)
        for batch in slices(batches, "chunk"):
            yield from tally.add(made(Chunks(batch, values)))
        yield from tally.drain()

    return chunks.mapInArrow(run, schema)


def word_counts(chunks: DataFrame, values: np.ndarray = TABLES[0]) -> DataFrame:
    """(lang, phrase, f, print) of all words; ``print`` is the word's number by a table of ``values``."""

    def made(c: Chunks) -> list:
        at = np.flatnonzero(c.owned)
        text = _texts(c.data, c.starts[at], c.ends[at] - c.starts[at])
        return [c.lang.take(pa.array(c.chunk[at])), text, c.numbers(at), c.weights(at)]

    rows = _over(chunks, made, "lang string, phrase string, print bigint, n bigint", values)
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("print").alias("print"))


def numbered(chunks: DataFrame, tables: Sequence[np.ndarray] = TABLES) -> tuple[DataFrame, np.ndarray]:
    """The word counts, written once, and the first of the tables by which all words have different numbers."""
    for values in tables:
        counted = materialise(word_counts(chunks, values), "words")
        if counted.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return counted, values
    raise ValueError("two words have one number by each table of values")


def joint(columns: Sequence[str]) -> Column:
    """The numbers of a phrase's words as one, each turned by its place; different phrases may agree."""
    made = F.col(columns[0])
    for k, c in enumerate(columns[1:], 1):
        made = made.bitwiseXOR(F.shiftleft(c, TURN * k).bitwiseOR(F.shiftrightunsigned(c, 64 - TURN * k)))
    return made


def bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """The places of the fingerprints ``print`` among ``1 << bits``, as bits; at most (1 << bits) / 64 rows reach the driver."""
    slot = F.shiftrightunsigned("print", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - bits}) & 63 as int))")
    rows = prints.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    made = np.zeros(1 << bits >> 6, dtype=np.int64)
    made[np.asarray(rows.column("word").combine_chunks())] = np.asarray(rows.column("bits").combine_chunks())
    return made.view(np.uint8)


def _among(prints: np.ndarray, known: np.ndarray, bits: int) -> np.ndarray:
    slot = (prints >> U(64 - bits)).astype(np.int64)
    return known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1


def frequent(spark: SparkSession, chunks: DataFrame, counted: DataFrame, values: np.ndarray, at_least: int, bits: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to ``MOST`` words that occur at least ``at_least`` times; written once."""
    often = F.col("f") >= at_least
    known = materialise(counted.filter(often), "frequent-words")
    parts, sent = known.select("print"), []
    whole = None
    for size in range(2, MOST + 1):
        sent.append(spark.sparkContext.broadcast(bitmap(parts, bits)))
        columns = PLACES[:size]

        def made(c: Chunks, size: int = size, shorter=sent[-1]) -> list:
            """Phrases of which both parts of one word less are known."""
            known = _among(c.phrase_prints(size - 1), shorter.value, bits) & c.standing(size - 1)
            at = np.flatnonzero(c.owned & c.standing(size) & known & np.append(known[1:], False))
            return [*(c.numbers(at + k) for k in range(size)), c.weights(at)]

        rows = _over(chunks, made, ", ".join(f"{c} bigint" for c in [*columns, "n"]), values)
        # most rows are the only one of their phrase in their task: they are dealt out before they are summed
        found = materialise(rows.repartition(*columns).groupBy(*columns).agg(F.sum("n").alias("f")).filter(often), "phrases")
        parts = found.select(joint(columns).alias("print"))
        found = found.withColumn("words", F.lit(size))
        whole = found if whole is None else whole.unionByName(found, allowMissingColumns=True)
    for c in PLACES:  # frequent words stand in many phrases: the lookup spreads them
        of = known.select(F.col("print").alias(c), F.col("phrase").alias(f"{c}_word"), *([F.col("lang")] if c == PLACES[0] else []))
        whole = lookup_join(whole, of, c, "left", spread_by=[x for x in PLACES if x != c])
    names = ["lang", "phrase", "words", "f"]
    whole = whole.withColumn("phrase", F.concat_ws(" ", *[f"{c}_word" for c in PLACES]))
    ones = known.withColumn("words", F.lit(1))
    made = materialise(ones.select(names).unionByName(whole.select(names)), "frequent")
    for x in sent:
        x.destroy()
    return made


def _exact(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def ranked(known: DataFrame, totals: DataFrame, subsumed_percent: int, best: int) -> DataFrame:
    """The ``best`` phrases of each language, from all frequent phrases and the words of each language."""
    space = F.split("phrase", " ")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice(space, F.lit(1), k), " ").alias("l"), F.array_join(F.slice(space, k + 1, F.col("words") - k), " ").alias("r")
        ),
    )
    whole = known.filter("words > 1")
    parts = whole.select("lang", "phrase", "f", F.inline(cuts))
    for side in ("l", "r"):
        # frequent parts repeat as often as there are phrases with them: the lookup spreads them
        of = known.select("lang", F.col("phrase").alias(side), F.col("f").alias(f"f_{side}"))
        parts = lookup_join(parts, of, ["lang", side], "inner", spread_by=["phrase", "k"])
    score = F.expr("cast(f as decimal(20,0)) * 2000000 div (cast(f_l as decimal(20,0)) + cast(f_r as decimal(20,0)))")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "f_l", "f_r", "f")).alias("cut"))

    def inside(n: int, longer: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(longer - n + 1)), lambda k: F.array_join(F.slice(space, k, F.lit(n)), " "))

    sizes = range(3, MOST + 1)
    covered = [
        whole.filter(F.col("words") == longer).select("lang", F.explode(F.array_distinct(F.concat(*[inside(n, longer) for n in range(2, longer)]))).alias("phrase"), "f")
        for longer in sizes
    ]
    longest = covered[0]
    for more in covered[1:]:
        longest = longest.unionByName(more)
    longest = longest.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    gone = F.coalesce(_exact(F.col("longer")) * 100 >= _exact(F.col("cut.f")) * subsumed_percent, F.lit(False))
    left = scored.join(longest, ["lang", "phrase"], "left").filter(~gone)

    order = [F.col("cut.score").desc(), F.col("cut.f").desc(), "phrase"]
    # the best of each of 64 shares of a language first, so that a language with all rows is not sorted by one task
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = left.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= best)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= best)
    return top.join(F.broadcast(totals), "lang").select(
        "lang",
        "rank",
        "phrase",
        F.col("cut.f").alias("a"),
        F.col("cut.f_l").alias("l"),
        F.col("cut.f_r").alias("r"),
        "n",
        F.col("cut.score").alias("score"),
    )


def phrases(docs: DataFrame, at_least: int = 30, subsumed_percent: int = 80, best: int = 2000, bits: int = 25) -> DataFrame:
    """The ``best`` collocations of each language with their counts, those of the parts of their worst cut, and score."""
    spark = docs.sparkSession
    chunks = parse(docs)
    counted, values = numbered(chunks)
    known = frequent(spark, chunks, counted, values, at_least, bits)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked(known, totals, subsumed_percent, best)
