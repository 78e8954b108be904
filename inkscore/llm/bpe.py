"""Token ids of whole batches of texts by a public byte-level BPE vocabulary.

A text falls apart before every space that a visible character follows: no pre-token crosses that place, whatever
stands before it. Each distinct chunk of a batch is encoded once and its ids are dealt back to all its places.
Chunks of characters below U+0240 go through ``tiktoken`` (the same vocabulary as ranks), whose character classes
there equal those of ``tokenizers``; any other chunk goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import public_tokenizers

from inkscore.llm.arrays import span_prints

VOCABULARY = "byte_bpe_50k.json"
#: Bytes after a space that may begin white space: there a text is not cut.
_UNSURE = np.zeros(256, dtype=bool)
_UNSURE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = 0xC9


@functools.cache
def library(name: str = VOCABULARY):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def ranks(name: str = VOCABULARY):
    """The vocabulary as ranks, with the same special tokens, or None where no such file is at hand."""
    import tiktoken

    path = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
    if not os.path.exists(path):
        return None, np.zeros(0, np.int64)
    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t.content: i for i, t in library(name).get_added_tokens_decoder().items()}
    sizes = np.zeros(max([*table.values(), *special.values()]) + 1, dtype=np.int64)
    for text, i in [*table.items(), *((k.encode(), v) for k, v in special.items())]:
        sizes[i] = len(text)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special), sizes


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chunk begins and ends; chunks never cross the end of a text."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[:-2][(data[:-1] == 32) & ~_UNSURE[data[1:]]] = True
    # a space that ends a text is followed by another text's byte: no cut there
    last = offsets[1:] - 1
    cut[last[(last >= 0) & (offsets[1:] > offsets[:-1])]] = False
    cut[offsets[:-1]] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)).astype(np.int64)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1 ... of each span, one span after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def distinct_chunks(data: np.ndarray, offsets: np.ndarray):
    """Begin and size of one place of each distinct chunk, which of them stands at each place, and where the chunks begin."""
    starts, ends = chunks(data, offsets)
    _, where, which = np.unique(span_prints(data, starts, ends), return_index=True, return_inverse=True)
    return starts[where], (ends - starts)[where], which, starts


def encode_spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray, name: str = VOCABULARY):
    """Ids of the given chunks in some order, and where each chunk's ids begin and how many it has."""
    coder, sizes = ranks(name)
    second = data[np.minimum(begin + 1, len(data) - 1)]
    joined = (data[begin] == 32) & (size > 1) & ~_UNSURE[second]
    bytes_of = ragged(begin, size)
    wide = np.maximum.reduceat(data[bytes_of], np.cumsum(size) - size) >= _WIDE if coder else np.ones(len(begin), bool)
    first, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    found: list[np.ndarray] = []
    total = 0
    whole = np.flatnonzero(joined & ~wide)
    for at in range(0, len(whole), 20_000):
        part = whole[at : at + 20_000]
        text = data[ragged(begin[part], size[part])].tobytes().decode()
        ids = np.array(coder.encode(text, allowed_special="all"), dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(size[part]), side="left") + 1
        first[part], count[part] = total + np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        found.append(ids)
        total += len(ids)
    rest = np.flatnonzero(~joined | wide)
    texts = [data[b : b + n].tobytes().decode() for b, n in zip(begin[rest].tolist(), size[rest].tolist(), strict=True)]
    slow = [k for k, w in enumerate(wide[rest].tolist()) if w]
    by_library = dict(zip(slow, library(name).encode_batch([texts[k] for k in slow], add_special_tokens=False), strict=True))
    for k, text in enumerate(texts):
        ids = by_library[k].ids if k in by_library else coder.encode(text, allowed_special="all")
        first[rest[k]], count[rest[k]] = total, len(ids)
        found.append(np.array(ids, dtype=np.uint32))
        total += len(ids)
    return np.concatenate(found), first, count


def encode(data: np.ndarray, offsets: np.ndarray, name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text's ids begin and end."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    begin, size, which, starts = distinct_chunks(data, offsets)
    ids, first, count = encode_spans(data, begin, size, name)
    own = count[which]
    ends = np.concatenate([[0], np.cumsum(own)])
    return ids[ragged(first[which], own)], ends[np.searchsorted(starts, offsets, side="left")]
