"""Best-fit packing of token sequences with large-item matching.

Documents become pieces of at most ``capacity`` ids. How many pieces there are of each length (at most ``capacity``
numbers, whatever the corpus) decides the packing: pieces above a third of the capacity are matched greedily, at most
two to a sequence, the longest with the longest that fits; smaller pieces then go, longest first, to the sequence with
the least room that holds them. The plan deals ranks of pieces of equal length to places, so that the corpus itself is
only ranked and joined with nothing: ranks come from counts per bucket and length, never from one task per length.

Null texts are empty: a document of the end mark alone. Repeated rows are pieces of their own. ``doc_id`` may be null.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkscore.llm import bpe
from inkscore.llm.arrays import flat, slices
from inkscore.session import materialise

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def cut(docs: DataFrame, capacity: int = 1024, end: int | None = 2, name: str = bpe.VOCABULARY) -> DataFrame:
    """The pieces of each row of (doc_id, text) with their ids as little-endian unsigned 32-bit numbers.

    Only a document longer than ``capacity`` is cut; all its pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat(batch.column(1))
            ids, first = bpe.encode(data, offsets, name)
            if end is not None:
                ids = np.insert(ids, first[1:], np.uint32(end))
                first = first + np.arange(len(first))
            size = np.diff(first)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lead = size - (pieces - 1) * capacity
            start = np.where(number == 0, 0, lead[row] + (number - 1) * capacity)
            length = np.where(number == 0, lead[row], capacity)
            begin = first[:-1][row] + start
            content = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([content[4 * b : 4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Places by length: ranks from ``rank`` on go ``per`` to a sequence, from sequence ``bin`` and ``offset`` on."""

    bins: int = 0
    rows: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def put(self, length: int, count: int, per: int, first_bin: int, offset: int) -> None:
        """``count`` pieces, ``per`` to each sequence from ``first_bin`` on, in a row from ``offset`` on."""
        self.rows[length].append((self.used[length], per, first_bin, offset))
        self.used[length] += count


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """The packing of ``counts[length]`` pieces of each length."""
    out, left = Plan(), {k: v for k, v in counts.items() if v > 0}
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids -> runs of sequences (first, number)
    sizes: list[int] = []  # the keys of room that hold runs, ascending

    def free(gap: int, first: int, number: int) -> None:
        if number and gap:
            if not room[gap]:
                insort(sizes, gap)
            heapq.heappush(room[gap], (first, number))

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            fits = reversed(large[: bisect_right(large, capacity - a)])
            b = next((p for p in fits if left[p] > (p == a)), None)  # the longest large piece that fits beside it
            if b is None:
                number = left[a]
                out.put(a, number, 1, out.bins, 0)
            elif b == a:
                number = left[a] // 2
                out.put(a, 2 * number, 2, out.bins, 0)
                left[a] -= number
            else:
                number = min(left[a], left[b])
                out.put(a, number, 1, out.bins, 0)
                out.put(b, number, 1, out.bins, a)
                left[b] -= number
            left[a] -= number
            free(capacity - a - (b or 0), out.bins, number)
            out.bins += number
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(sizes, s)
            if k == len(sizes):
                per = capacity // s
                number = max(1, left[s] // per)
                gap, first = capacity, out.bins
                out.bins += number
            else:
                gap = sizes[k]
                first, number = heapq.heappop(room[gap])
                if not room[gap]:
                    sizes.pop(k)
            per = min(gap // s, left[s])
            full = min(number, left[s] // per)
            out.put(s, per * full, per, first, capacity - gap)
            left[s] -= per * full
            free(gap - per * s, first, full)
            free(gap, first + full, number - full)
    return out


def pack(pieces: DataFrame, capacity: int = 1024, rows_per_bucket: int = 20_000) -> DataFrame:
    """``pieces`` (a written table: doc_id, piece, start, length and more) with a ``sequence_id`` and ``offset`` for each row.

    Pieces are ranked among those of equal length within buckets of about ``rows_per_bucket`` rows, dealt by document
    and piece; only counts per bucket and length meet. The plan has at most capacity squared over three rows and goes
    to the tasks as it is.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    made = plan(histogram, capacity)
    deal = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in made.rows.items()})
    buckets = max(1, -(-sum(histogram.values()) // rows_per_bucket))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("_bucket", "length")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
        .drop("_n")
    )
    order = Window.partitionBy("_bucket", "length").orderBy(*[c for c in pieces.columns if c != "length"])
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(order) - 1)
        .join(before, ["_bucket", "length"])
        .select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "sequence_id"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                first, per, bins, place = deal.value[size]
                k = np.searchsorted(first, rank[own], side="right") - 1
                into = rank[own] - first[k]
                sequence[own] = bins[k] + into // per[k]
                offset[own] = place[k] + into % per[k] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], batch.schema.names)

    return ranked.mapInArrow(run, ranked.schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end: int | None = 2, name: str = bpe.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their sequence and place, the CRC-32 of their ids and, if asked for, the ids."""
    pieces = cut(docs, capacity, end, name).withColumn("ids_crc32", F.crc32("ids"))
    return pack(materialise(pieces if with_ids else pieces.drop("ids"), "pieces"), capacity)
