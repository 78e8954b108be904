"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of ``size`` item words (a shorter item is one window). A document contains a window only if it
contains each of its shingles, so one shingle is a sufficient prefix: the rarest in the corpus, by counts over all
documents. Documents are probed for these prefix shingles alone; a match fixes where the window would have to begin
(positional bound), must leave it room inside the document (length bound), and is then compared word by word.

The benchmark is worked off in blocks of at most ``block`` (window, item) pairs, so what reaches the tasks is bounded
by that number whatever the size of the benchmark; each block passes over the documents twice. Documents are never
shuffled, and no key gathers documents.

Null texts and texts without words have no windows and no hits. Repeated document rows each get their row. Items of
equal id are one item; an item without an id counts under the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.llm.arrays import SYMBOLS, flat, runs, slices, span_prints, words, _LOWER
from inkscore.llm.bpe import ragged
from inkscore.session import text_once

SEPARATED = bytes(32 if SYMBOLS[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLE = 5


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: everything but ASCII letters, digits and non-ASCII characters separates."""
    return text.translate(SEPARATED).split()


def item_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Distinct (item, window) with the window's words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words_of((text or "").encode())
                for k in range(max(1, len(own) - size + 1) if own else 0):
                    items.append(item)
                    found.append(b" ".join(own[k : k + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], ["item", "window"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, window string").distinct()


class Finder:
    """Looks up sorted 64-bit values; a bit table rejects most others first."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        bits = max(10, int(16 * len(values)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[values >> self.shift] = True

    def places(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``probes`` whose value is there, and its first index among the sorted values."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[probes >> self.shift])
        k = np.searchsorted(self.values, probes[at])
        ok = self.values[np.minimum(k, len(self.values) - 1)] == probes[at]
        return at[ok], k[ok]


def _prints(own: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in own])
    return span_prints(np.frombuffer(b"".join(own), np.uint8), ends - np.diff(ends, prepend=0), ends, _LOWER)


class Block:
    """The windows of one block: words, items, shingles by length, and after counting the prefix of each window."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.windows = [w.encode().split() for w, _ in rows]
        self.items = [items for _, items in rows]
        self.size = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.shingles = []  # by window, at each offset
        for own in self.windows:
            self.shingles.append(runs(_prints(own), min(SHINGLE, len(own))))

    def by_length(self) -> dict[int, np.ndarray]:
        out: dict[int, list[np.ndarray]] = {}
        for n, own in zip(self.size.tolist(), self.shingles, strict=True):
            out.setdefault(min(SHINGLE, n), []).append(own)
        return {n: np.unique(np.concatenate(v)) for n, v in out.items()}

    def prefixes(self, counts: dict[int, int]) -> dict[int, tuple[Finder, np.ndarray, np.ndarray]]:
        """By shingle length: the rarest shingle of each window (ties: the first), sorted; its window and offset."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, own in enumerate(self.shingles):
            number = [counts.get(h, 0) for h in own.tolist()]
            place = number.index(min(number))
            if number[place]:  # a shingle that the corpus lacks rules its window out
                out.setdefault(min(SHINGLE, len(self.windows[k])), []).append((int(own[place]), k, place))
        made = {}
        for n, rows in out.items():
            rows.sort()
            values = np.array([r[0] for r in rows], dtype=np.uint64)
            made[n] = (Finder(values), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        return made


def _count(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, int]:
    """How often each wanted shingle occurs in all documents."""
    given = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {n: (Finder(v), np.zeros(len(v), dtype=np.int64)) for n, v in given.value.items()}
        for batch in slices(batches):
            data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
            starts, ends, first = words(data, offsets, SYMBOLS)
            prints = span_prints(data, starts, ends, _LOWER)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for n, (finder, counts) in finders.items():
                at, k = finder.places(runs(prints, n))
                k = k[row[at] == row[at + n - 1]]
                np.add.at(counts, k, 1)
        for finder, counts in finders.values():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(finder.values[seen].view(np.int64)), pa.array(counts[seen])], ["shingle", "n"])

    found = docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"] & (2**64 - 1): r["n"] for r in found.collect()}  # at most the shingles of one block


def _probe(docs: DataFrame, block: Block, counts: dict[int, int]) -> DataFrame:
    """Adds what this block's windows hit to ``hits`` (begin and end of runs of words) and ``items``."""
    given = docs.sparkSession.sparkContext.broadcast((block, block.prefixes(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, finders = given.value
        for batch in slices(batches):
            data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
            starts, ends, first = words(data, offsets, SYMBOLS)
            prints = span_prints(data, starts, ends, _LOWER)
            rows = len(first) - 1
            row = np.repeat(np.arange(rows), np.diff(first))
            items = [set(x) for x in batch.column(batch.schema.get_field_index("items")).to_pylist()]
            edge = np.zeros(len(prints) + 1, dtype=np.int64)
            for r, runs_before in enumerate(batch.column(batch.schema.get_field_index("hits")).to_pylist()):
                for a, b in zip(runs_before[::2], runs_before[1::2], strict=True):
                    edge[first[r] + a] += 1
                    edge[first[r] + b] -= 1
            for n, (finder, window, place) in finders.items():
                at, k = finder.places(runs(prints, n))
                last = np.searchsorted(finder.values, finder.values[k], side="right")
                at, k = np.repeat(at, last - k), ragged(k, last - k)  # all windows with this prefix
                begin, size = at - place[k], own.size[window[k]]
                ok = (begin >= 0) & (begin + size <= len(prints))
                begin, size, k = begin[ok], size[ok], k[ok]
                ok = row[begin] == row[begin + size - 1] if len(begin) else np.zeros(0, bool)
                for b, m, w in zip(begin[ok].tolist(), size[ok].tolist(), window[k[ok]].tolist(), strict=True):
                    if words_of(data[starts[b] : ends[b + m - 1]].tobytes()) == own.windows[w]:
                        items[row[b]].update(own.items[w])
                        edge[b] += 1
                        edge[b + m] -= 1
            inside = np.cumsum(edge[:-1]) > 0
            hits = []
            for r in range(rows):
                change = np.flatnonzero(np.diff(inside[first[r] : first[r + 1]].astype(np.int8), prepend=0, append=0)) if items[r] else ()
                hits.append(np.asarray(change, dtype=np.int32))
            columns = {
                "n_words": pa.array(np.diff(first)),
                "hits": pa.array(hits, pa.list_(pa.int32())),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(k)) for k, c in enumerate(batch.schema.names)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = 200_000) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words``, ``hits`` and ``items`` (these three replace columns of that name)."""
    pairs = item_windows(benchmark, size)
    pairs = pairs.withColumn("part", F.lit(0)) if (n := pairs.count()) <= block else pairs.withColumn(
        "part", F.pmod(F.xxhash64("item", "window"), F.lit(-(-2 * n // block))).cast("int")
    )
    parts = sorted(r["part"] for r in pairs.select("part").distinct().collect())
    out = docs.withColumns(
        {
            "n_words": F.lit(0).cast("bigint"),
            "hits": F.array().cast("array<int>"),
            "items": F.array().cast("array<string>"),
            "text": F.col("text").cast("string"),
        }
    )
    corpus = out.select("text")
    for part in parts or [None]:
        rows = pairs.filter(F.col("part") == part).groupBy("window").agg(F.sort_array(F.collect_set("item"))).collect() if parts else []
        own = Block([(w, list(items)) for w, items in rows])
        out = _probe(out, own, _count(corpus, own.by_length()) if rows else {})
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = 200_000) -> DataFrame:
    """One row for each document row: words, hit words and the items whose windows occur in it."""
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return find_windows(docs.select(F.col("doc_id"), F.col("text")), benchmark, size, block).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = 200_000) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with their own columns."""
    rows, whole = text_once(docs)
    kept = find_windows(rows, benchmark, size, block).filter(F.size("items") == 0)
    return kept.select(whole.alias("row")).select("row.*")
