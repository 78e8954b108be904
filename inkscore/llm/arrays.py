"""Text columns as flat numpy arrays: words, fingerprints and shingles of whole Arrow batches.

Everything works on the bytes of a batch at once. A word is a maximal run of bytes that are no separators, its
fingerprint a 64-bit polynomial over its bytes with A-Z lower-cased, mixed at the end. Work space is about ten times
a slice of at most ``SLICE`` bytes (or of one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
_BLOCK = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003)) * U(0x9E3779B97F4A7C15))


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + 1, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_VALUE = stream(1, 256)
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_PLACE = stream(2, 16) | U(1)

#: Separators by byte: ASCII white space; all of ASCII but letters and digits.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[:128] = True
SYMBOLS[48:58] = SYMBOLS[65:91] = SYMBOLS[97:123] = False


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other and where each begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column) or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return content[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE`` bytes of text."""
    for batch in batches:
        _, offsets = flat(batch.column(batch.schema.get_field_index(name)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def span_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """A 64-bit fingerprint of each of the given spans, which follow each other."""
    out = np.empty(len(starts), dtype=U)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + _BLOCK, side="right"))
        if to <= at:  # one span longer than a block
            total, step = U(0), _BLOCK // 2
            for place in range(int(base), int(ends[at]), step):
                part = values[data[place : min(place + step, int(ends[at]))]] * _UP[: min(step, int(ends[at]) - place)]
                total = mix(np.array([total * U(_BASE) + part.sum(dtype=U)], dtype=U))[0]
            out[at] = total
            at += 1
            continue
        part = values[data[base : ends[to - 1]]]
        part *= _UP[: len(part)]
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(part, out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * _DOWN[s]
        at = to
    return mix(out ^ ((ends - starts).astype(U) * U(0x9E3779B97F4A7C15)))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of the first word of each text (one more entry than texts)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):  # a word that runs over the end of a text is one word in each
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        at = np.searchsorted(starts, inner, side="left") - 1
        cut = inner[(at >= 0) & (inner > starts[at]) & (inner < ends[at])]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_prints(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each word with A-Z lower-cased, and the first word of each text."""
    starts, ends, first = words(data, offsets, separators)
    return span_prints(data, starts, ends, _LOWER), first


def runs(prints: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of the ``n`` words from each word on; those that leave their text are the caller's to drop."""
    if len(prints) < n:
        return np.zeros(0, dtype=U)
    total = np.full(len(prints) - n + 1, n, dtype=U)
    for k in range(n):
        total += prints[k : len(prints) - n + 1 + k] * _PLACE[k]
    return mix(total)


def shingle_sets(prints: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct ``n``-word shingles; fewer words are one shingle, none is an empty set."""
    every, out = runs(prints, n), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(every[a : b - n + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        else:
            out.append(runs(prints[a:b], b - a) if b > a else np.zeros(0, dtype=U))
    return out


def set_print(own: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of shingles; 0 for the empty set only by chance."""
    return int(mix(np.array([mix(own + U(77)).sum(dtype=U) + U(len(own))], dtype=U)).view(np.int64)[0])


def jaccard_reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values; never for empty sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
