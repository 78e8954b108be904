"""Token ids of whole batches of texts by a public vocabulary with word ends, lower case and without white space.

Its merges begin from bytes of which the last of a pre-token is marked. With the mark as a zero byte behind the pre-token
the vocabulary is one of ranks: a byte and the mark join first, then the merges in their order. So all distinct chunks of a
batch (see ``bpe``) become one text of marked pre-tokens that ``tiktoken`` merges in one call. That path takes chunks of
printable ASCII, white space and letters up to U+023F, for which normal form, lower case and character classes are the
same everywhere; others, and those that might hold a special token, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers
import regex

from inkscore.llm import bpe

VOCABULARY = "word_bpe_49k.json"
MARK, NEXT = "\x00", "\x0b"  # neither occurs in a chunk of this path; white space ends a run of symbols
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(9), 11, *range(14, 32), 127, *range(0xC9, 256)]] = True


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in the files of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


@functools.cache
def ranks(name: str = VOCABULARY):
    """The vocabulary as ranks over marked pre-tokens, the id that ends a chunk, and the pattern of pre-tokens."""
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        said = json.load(file)
    model, letters = said["model"], _byte_letters()
    end = model["end_of_word_suffix"]
    special = {t["content"] for t in said["added_tokens"]}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    order = [t for t in sorted(model["vocab"], key=model["vocab"].get) if t not in special]
    if order[-len(merged) :] != [m.replace(end, "", m.count(end) - m.endswith(end)) for m in merged]:
        raise ValueError(f"{name}: ids do not follow the order of merges")

    def content(token: str) -> bytes:
        word = token.removesuffix(end)
        return bytes(letters[c] for c in word) + (MARK.encode() if token != word else b"")

    table = {content(t): model["vocab"][t] for t in order}
    pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    coder = tiktoken.Encoding("own", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=table, special_tokens={})
    return coder, table[(NEXT + MARK).encode()], regex.compile(f"{NEXT}|{pattern}")


def encode(data: np.ndarray, offsets: np.ndarray, name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text's ids begin and end."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    begin, size, which, starts = bpe.distinct_chunks(data, offsets)
    coder, end, pattern = ranks(name)
    spread = bpe.ragged(begin, size)
    odd = _ODD[data]
    odd[:-1] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0)  # controls and the no-break space
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # special tokens begin like this
    head = np.cumsum(size) - size
    slow = np.logical_or.reduceat(odd[spread], head)
    first, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)

    fast = np.flatnonzero(~slow)
    found = [np.zeros(0, np.uint32)]
    if len(fast):
        # the chunks one after the other, each with NEXT behind it
        wide = size[fast] + 1
        joined = np.full(int(wide.sum()), ord(NEXT), dtype=np.uint8)
        joined[bpe.ragged(np.cumsum(wide) - wide, size[fast])] = data[bpe.ragged(begin[fast], size[fast])]
        pieces = pattern.findall(joined.tobytes().decode().lower())
        ids = np.array(coder.encode_ordinary(MARK.join(pieces) + MARK), dtype=np.uint32)
        stops = np.flatnonzero(ids == end)
        first[fast] = np.concatenate([[0], stops[:-1] + 1])
        count[fast] = stops - first[fast]
        found.append(ids)
    total = sum(map(len, found))
    rest = np.flatnonzero(slow)
    texts = [data[b : b + n].tobytes().decode() for b, n in zip(begin[rest].tolist(), size[rest].tolist(), strict=True)]
    for k, one in zip(rest.tolist(), bpe.library(name).encode_batch(texts, add_special_tokens=False), strict=True):
        first[k], count[k] = total, len(one.ids)
        found.append(np.array(one.ids, dtype=np.uint32))
        total += len(one.ids)
    ids, own = np.concatenate(found), count[which]
    ends = np.concatenate([[0], np.cumsum(own)])
    return ids[bpe.ragged(first[which], own)], ends[np.searchsorted(starts, offsets, side="left")]
