"""Token counts with a whole-token shortcut.

Offline, ``whole_tokens`` proves which strings of the vocabulary are one pre-token and encode alone as one token: it
encodes them all. A chunk of text (see ``bpe``) or pre-token found in that set counts one without any merging; only
the rest is merged, once per distinct string and batch. The proven set has at most as many entries as the vocabulary.

Null texts are empty. Empty texts have no tokens. Repeated rows and null identifiers are counted as they stand.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.llm import bpe
from inkscore.llm.arrays import flat, slices

SLICE_ROWS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


@functools.cache
def whole_tokens(name: str = bpe.VOCABULARY) -> frozenset[str]:
    """Strings that are one pre-token and whose encoding is one token: proven by encoding every string of the vocabulary."""
    coder = bpe.library(name)
    special = {t.content for t in coder.get_added_tokens_decoder().values()}
    texts = [coder.decode([i], skip_special_tokens=False) for i in range(coder.get_vocab_size())]
    found = coder.encode_batch(texts, add_special_tokens=False)
    pattern = regex.compile(public_tokenizers.PATTERN)
    return frozenset(
        text
        for i, (text, own) in enumerate(zip(texts, found, strict=True))
        if own.ids == [i] and text not in special and pattern.fullmatch(text)
    )


def _counts(texts: list[str], whole: frozenset[str], name: str) -> np.ndarray:
    """Tokens of each distinct chunk: one by the shortcut, else over its pre-tokens, merging those that are not proven."""
    coder = bpe.library(name)
    special = [t.content for t in coder.get_added_tokens_decoder().values()]
    find = regex.compile(public_tokenizers.PATTERN).findall
    out = np.ones(len(texts), dtype=np.int64)
    merged: dict[str, int] = {}
    open_chunks: list[tuple[int, list[str]]] = []
    library_chunks: list[int] = []
    for k, text in enumerate(texts):
        if text in whole:
            continue
        if not text.isascii() and max(text) >= "ɀ" or any(s in text for s in special):
            library_chunks.append(k)  # character classes may differ there, and special strings come first
            continue
        pieces = find(text)
        rest = [p for p in pieces if p not in whole]
        out[k] = len(pieces) - len(rest)
        if rest:
            open_chunks.append((k, rest))
            merged.update(dict.fromkeys(rest, 0))
    pieces = list(merged)
    merged = dict(zip(pieces, _merge(pieces, name), strict=True))
    for k, rest in open_chunks:
        out[k] += sum(merged[p] for p in rest)
    for k, own in zip(library_chunks, coder.encode_batch([texts[k] for k in library_chunks], add_special_tokens=False), strict=True):
        out[k] = len(own.ids)
    return out


def _merge(pieces: list[str], name: str) -> list[int]:
    ranks, _ = bpe.ranks(name)
    if ranks is None:
        return [len(e.ids) for e in bpe.library(name).encode_batch(pieces, add_special_tokens=False)]
    return [len(ranks.encode_single_piece(p)) if hasattr(ranks, "encode_single_piece") else len(ranks.encode_ordinary(p)) for p in pieces]


def count_tokens(docs: DataFrame, name: str = bpe.VOCABULARY, limit: int = 1024) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens and whether they exceed ``limit``, for each row of (doc_id, text)."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat(batch.column(1))
            tokens = np.zeros(len(offsets) - 1, dtype=np.int64)
            if len(data):
                begin, size, which, starts = bpe.distinct_chunks(data, offsets)
                content = data.tobytes()
                texts = [content[b : b + n].decode() for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
                sums = np.concatenate([[0], np.cumsum(_counts(texts, whole.value, name)[which])])
                tokens = np.diff(sums[np.searchsorted(starts, offsets, side="left")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SLICE_ROWS).withColumn("over_limit", F.col("n_tokens") > limit)
