"""Harmonic packing of token sequences, with gaps filled by cut documents.

Lengths fall into classes by reciprocal capacity: class k holds those above capacity / (k + 1) and at most capacity / k,
and a sequence of class k takes exactly k documents. So a worker fills its classes with what it reads and needs to know
nothing of any other worker: the documents are read once, nothing is shuffled, collected or broadcast. A worker packs a
group of about ``group_ids`` ids at a time.

Within a group a document longer than the capacity gives full pieces, each a sequence, and a rest. Rests that would fill
their class worst (k times the length is smallest), and those that are too few for another sequence of their class, are
not placed but cut: their ids run, one document after the other, through the room that the placed ones leave. As many
are taken as that room needs. What they hold beyond it makes further full sequences and at last, for fewer ids than the
capacity, one sequence for each power of two in their number. Every sequence is thus full or a power of two long, so
nothing is padded, at most eleven short sequences end a group, and about one document is cut for each sequence with room.

Null texts are empty: a document of the end mark alone. Repeated rows, and rows without doc_id, are documents of their
own; an empty table has no pieces. Other columns are not read. A text is encoded whole, however long it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.llm import word_bpe
from inkscore.llm.arrays import flat, slices

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_TASK_BITS = 40  # a task numbers its sequences from its own number times 2 ** 40


def _class_bins(rest: np.ndarray, rows: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents ``rows`` those that fill sequences of their class, the sequence of each, and those left over."""
    fixed = capacity // rest[rows]
    order = np.argsort(fixed, kind="stable")
    rows, fixed = rows[order], fixed[order]
    kinds, first, number = np.unique(fixed, return_index=True, return_counts=True)
    bins = number // kinds
    place = np.arange(len(rows)) - np.repeat(first, number)
    placed = place < np.repeat(bins * kinds, number)
    before = np.repeat(np.cumsum(bins) - bins, number)
    return rows[placed], (before + place // fixed)[placed], rows[~placed]


def _powers(number: int) -> list[int]:
    return [1 << b for b in reversed(range(number.bit_length())) if number >> b & 1]


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Document, start, length, sequence and offset of each piece of documents of the given sizes (all above 0)."""
    full = sizes // capacity
    doc = np.repeat(np.arange(len(sizes)), full)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    out = [(doc, number * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))]
    used = len(doc)

    rest = sizes - full * capacity
    rows = np.flatnonzero(rest)
    if len(rows):
        worst = rows[np.argsort(capacity // rest[rows] * rest[rows], kind="stable")]

        def split(cut: int):
            placed, sequence, over = _class_bins(rest, np.sort(worst[cut:]), capacity)
            filling = np.sort(np.concatenate([worst[:cut], over]))
            bins = int(sequence[-1]) + 1 if len(sequence) else 0
            return placed, sequence, filling, bins * capacity - int(rest[placed].sum())

        low, high = 0, len(worst)  # all of them are always enough
        while low < high:
            middle = (low + high) // 2
            _, _, filling, room = split(middle)
            low, high = (low, middle) if rest[filling].sum() >= room else (middle + 1, high)
        placed, sequence, filling, room = split(low)

        begin = full * capacity
        run = np.cumsum(rest[placed]) - rest[placed]
        head = np.flatnonzero(np.diff(sequence, prepend=-1))  # the first document of each sequence
        offset = run - run[head][sequence] if len(placed) else run
        out.append((placed, begin[placed], rest[placed], used + sequence, offset))

        taken = np.bincount(sequence, weights=rest[placed], minlength=0).astype(np.int64) if len(placed) else np.zeros(0, np.int64)
        spare = int(rest[filling].sum()) - room
        more = np.array([capacity] * (spare // capacity) + _powers(spare % capacity), dtype=np.int64)
        base = np.concatenate([taken, np.zeros(len(more), np.int64)])
        slots = np.concatenate([capacity - taken, more])
        slot_end, doc_end = np.cumsum(slots), np.cumsum(rest[filling])
        ends = np.union1d(slot_end[slots > 0], doc_end)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        of, into = np.searchsorted(doc_end, starts, side="right"), np.searchsorted(slot_end, starts, side="right")
        own = starts - (doc_end - rest[filling])[of] if len(filling) else starts
        out.append((filling[of], begin[filling][of] + own, ends - starts, used + into, base[into] + starts - (slot_end - slots)[into]))
    return tuple(np.concatenate(parts).astype(np.int64) for parts in zip(*out, strict=True))


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    end: int | None = 1,
    name: str = word_bpe.VOCABULARY,
    group_ids: int = 1 << 22,
    with_ids: bool = False,
) -> DataFrame:
    """All pieces of (doc_id, text) with their sequence and place, the CRC-32 of their ids and, if asked for, the ids."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = TaskContext.get().partitionId() << _TASK_BITS
        keys: list[pa.Array] = []
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal used
            size = np.concatenate(sizes)
            whole = np.flatnonzero(size)  # without an end mark an empty text has no piece
            ids, first = np.concatenate(found).astype("<u4"), np.cumsum(size) - size
            key = pa.concat_arrays(keys)
            doc, start, length, sequence, offset = pack_group(size[whole], capacity)
            doc = whole[doc]
            content = memoryview(ids).cast("B")
            begin = (4 * (first[doc] + start)).tolist()
            pieces = [content[b : b + 4 * n] for b, n in zip(begin, length.tolist(), strict=True)]
            columns = [
                key.take(pa.array(doc)),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                pa.array(size[doc]),
                pa.array(used + sequence),
                pa.array(offset),
            ]
            if with_ids:
                columns.append(pa.array([bytes(p) for p in pieces], pa.binary()))
            used += int(sequence.max()) + 1 if len(sequence) else 0
            for part in (keys, found, sizes):
                part.clear()
            made = pa.RecordBatch.from_arrays(columns, names)
            for at in range(0, made.num_rows, 10_000):
                yield made.slice(at, 10_000)

        for batch in slices(batches):
            data, offsets = flat(batch.column(1))
            ids, first = word_bpe.encode(data, offsets, name)
            if end is not None:
                ids = np.insert(ids, first[1:], np.uint32(end))
                first = first + np.arange(len(first))
            keys.append(batch.column(0))
            found.append(ids)
            sizes.append(np.diff(first))
            if sum(map(len, found)) >= group_ids or sum(map(len, sizes)) >= group_ids // 8:
                yield from close()
        if sizes:
            yield from close()

    schema = PIECES + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
