"""Removal of paragraphs that repeat across or inside documents, by MinHash banding, and of repeated runs of words.

A paragraph is a line. Paragraphs of at least ``min_words`` words are compared by their five-word shingles: 16 bands
of 4 minima let 99.98 % of pairs at Jaccard 0.8 meet (one band of four agrees with probability 0.41), pairs are
verified on their full shingle sets, and linked paragraphs form components. Each component keeps its first paragraph
(smallest doc_id, then place); all others are cut out of their documents, whichever they are.

Paragraphs of equal words in equal order are one class and meet once. Where over ``crowd`` classes that are not one component share a band
value, those that share a second one too are linked first, as a head start; then whichever of them are still in different components
are compared in blocks. So two paragraphs that share a band value are compared however many others share it.

Then every run of ``PASSAGE`` words that repeats, inside lines or across them, is cut wherever it is not the first. Each
window of that many words has one anchor, its smallest ``GRAM``-word shingle, chosen by content alone; only windows
whose anchor occurs twice are looked up. A window that overlaps its first occurrence stays. Cuts make new neighbours, so
this goes on until no run repeats; only windows that a text cut last holds can repeat then, so only these are looked for. Words are compared without regard to A-Z case and white space.

Null and empty texts have no paragraphs and stay as they are. Rows that repeat doc_id and text are one document. Rows
without doc_id come last. Shorter paragraphs have no shingle of five words and are never removed; ``min_words`` is 5 at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.llm.arrays import SPACES, flat, mix, runs, shingle_sets, slices, stream, word_prints, words
from inkscore.llm.bpe import ragged
from inkscore.llm.links import BROADCAST_BYTES, Links, bounded, joined_families, settle, shared
from inkscore.session import in_small_batches, materialise, measured_bytes

BANDS, ROWS = 16, 4
SHINGLE = 5
_WEIGHTS = stream(33, 4096) | np.uint64(1)
_FACTORS = stream(31, BANDS * ROWS) | np.uint64(1)
_SALTS = stream(32, BANDS)
_SEEN = 100_000
PASSAGE, GRAM = 50, 10


class Paragraphs:
    """The paragraphs of at least ``min_words`` words of a batch: text, place, bytes and words of each."""

    def __init__(self, batch: pa.RecordBatch, min_words: int):
        self.data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
        line = np.flatnonzero(self.data == 10)
        full = np.flatnonzero(np.diff(offsets))
        starts = np.unique(np.concatenate([offsets[:-1][full], line + 1]))
        starts = starts[starts < len(self.data)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        place = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1], side="left")[row]
        ends = np.append(starts[1:], len(self.data)).astype(np.int64)
        prints, first = word_prints(self.data, np.append(starts, len(self.data)), SPACES)
        own = np.flatnonzero(np.diff(first) >= min_words) if len(starts) else np.zeros(0, np.int64)
        self.row, self.place, self.begin = row[own], place[own].astype(np.int32), starts[own]
        self.end = ends[own] - (self.data[ends[own] - 1] == 10)
        size = np.diff(first)[own]
        self.size = size
        self.prints = prints[ragged(first[:-1][own], size)]
        self.first = np.cumsum(size) - size
        if len(own):  # by the words in their order
            at = (np.arange(len(self.prints)) - np.repeat(self.first, size)) % len(_WEIGHTS)
            total = np.add.reduceat(self.prints * _WEIGHTS[at], self.first)
            self.ids = mix(total + size.astype(np.uint64)).view(np.int64)
        else:
            self.ids = np.zeros(0, np.int64)

    def band_keys(self, which: np.ndarray) -> np.ndarray:
        """The band values of the given paragraphs, band by band; each carries its band's number in its low bits."""
        n = self.size[which] - SHINGLE + 1
        every = runs(self.prints, SHINGLE)[ragged(self.first[which], n)]
        begin = np.cumsum(n) - n
        out = []
        for b in range(BANDS):
            total = np.full(len(which), _SALTS[b])
            for f in _FACTORS[ROWS * b : ROWS * (b + 1)]:
                total = mix(total + np.minimum.reduceat(every * f, begin))
            out.append((total & ~np.uint64(15)) | np.uint64(b))
        return np.concatenate(out).view(np.int64)


def _occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = Paragraphs(batch, min_words)
            taken = pa.array(own.row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(own.place), pa.array(own.ids)], ["doc", "doc_id", "place", "id"])

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc bigint, doc_id bigint, place int, id bigint")


def _index(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, id) of all paragraphs; a task leaves out most of those it has just indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in slices(batches):
            own = Paragraphs(batch, min_words)
            ids, which = np.unique(own.ids, return_index=True)
            fresh = ~np.isin(ids, seen)
            ids, which = ids[fresh], which[fresh]
            seen = np.concatenate([seen if len(seen) < _SEEN else seen[:0], ids])
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(own.band_keys(which)), pa.array(np.tile(ids, BANDS))], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key bigint, id bigint")


def _texts(docs: DataFrame, members: DataFrame, min_words: int):
    """(id, text) of given classes of paragraphs among ``members``; each paragraph is written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = Paragraphs(batch, min_words)
            content = own.data.tobytes()
            found = [content[a:b] for a, b in zip(own.begin.tolist(), own.end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own.ids), pa.array(found, pa.binary()).cast(pa.string())], ["id", "text"])

    wanted = bounded(materialise(members.select("id").distinct(), "ids"))
    every = docs.select("text").mapInArrow(run, "id bigint, text string").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    every = materialise(every, "texts")
    return lambda ids: every.join(bounded(ids), "id", "left_semi")


def _two_bands(members: DataFrame, crowded: DataFrame) -> DataFrame:
    """(key, id) of each two band values of an id of which one at least is crowded, once.

    An id has ``BANDS`` band values at most, so it has at most 120 rows, however many ids share them.
    """
    own = members.join(crowded.select("id").distinct(), "id", "left_semi").select("id", "key", F.lit(False).alias("crowded"))
    own = own.unionByName(crowded.select("id", "key", F.lit(True).alias("crowded"))).groupBy("id", "key").agg(F.max("crowded").alias("crowded"))
    own = own.groupBy("id").agg(F.collect_list(F.struct("key", "crowded")).alias("bands"))

    def with_later(x):
        later = F.filter("bands", lambda y: (x["key"] < y["key"]) & (x["crowded"] | y["crowded"]))
        return F.transform(later, lambda y: F.xxhash64(x["key"], y["key"]))

    return own.select(F.explode(F.flatten(F.transform("bands", with_later))).alias("key"), "id")


def _open(crowded: DataFrame, links: Links) -> DataFrame:
    """(id, family, c) of the band values of ``crowded`` that are not one component by now."""
    known = materialise(links.label(crowded.select("key", "id")), "crowded")
    still = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("key")
    return known.join(still, "key").select("id", F.col("key").alias("family"), "c")


def repeated_paragraphs(docs: DataFrame, min_words: int = SHINGLE, percent: int = 80, crowd: int = 24) -> DataFrame:
    """(doc, place, kept_doc_id, kept_place) of each paragraph to remove; ``docs`` has (doc, doc_id, text)."""

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        return shingle_sets(*word_prints(*flat(column), SPACES))

    found = materialise(_occurrences(docs, min_words), "paragraphs")
    members = materialise(shared(_index(docs, min_words)), "members")
    texts = _texts(docs, members, min_words)
    links = Links()
    crowded = settle(members, links, texts, sets_of, percent, crowd)
    if not crowded.isEmpty():
        refined = materialise(shared(_two_bands(members, crowded)), "refined")
        settle(refined, links, texts, sets_of, percent, crowd)
        links.add(joined_families(_open(crowded, links), texts, sets_of, percent))
    known = links.label(found)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "place")
    kept = known.groupBy("c").agg(F.min(order).alias("kept"), F.count("*").alias("n")).filter("n > 1").select("c", "kept")
    return (
        known.join(kept, "c")
        .filter((F.col("doc") != F.col("kept.doc")) | (F.col("place") != F.col("kept.place")))
        .select("doc", "place", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.place").alias("kept_place"))
        .distinct()  # of equal rows
    )


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value among the ``width`` from each place on, by windows that double."""
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        later = values[step:] < values[:-step]
        place = np.where(later, place[step:], place[:-step])
        values = np.where(later, values[step:], values[:-step])
        have += step
    return place


def _anchors(prints: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and first word of each window of ``PASSAGE`` words, its anchor's word and the anchor's fingerprint."""
    if len(prints) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = runs(prints, GRAM)
    begin = np.arange(len(prints) - PASSAGE + 1)
    text = np.searchsorted(first, begin, side="right") - 1
    inside = begin + PASSAGE <= first[text + 1]
    at = _least(grams, PASSAGE - GRAM + 1)
    text, begin, at = text[inside], begin[inside], at[inside]
    return text, begin, at, grams[at].view(np.int64)


def _window_prints(prints: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The fingerprints of the ``PASSAGE`` words from each of ``begin`` on."""
    grams, total = runs(prints, GRAM), np.full(len(begin), PASSAGE, dtype=np.uint64)
    for k in range(0, PASSAGE, GRAM):
        total = mix(total + grams[begin + k]) if len(begin) else total
    return total.view(np.int64)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return word_prints(*flat(batch.column(batch.schema.get_field_index("text"))), SPACES)


def passage_anchors(docs: DataFrame) -> DataFrame:
    """(doc, key, at) of the anchors of all windows of ``docs`` (doc, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints, first = _words(batch)
            text, _, at, key = _anchors(prints, first)
            fresh = np.unique(at, return_index=True)[1]
            text = text[fresh]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(key[fresh]), pa.array((at[fresh] - first[text]).astype(np.int32))], ["doc", "key", "at"])

    return materialise(docs.select("doc", "text").mapInArrow(find, "doc bigint, key bigint, at int"), "anchors")


def repeated_passages(docs: DataFrame, anchors: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """(doc, starts): where the windows of ``PASSAGE`` words to cut begin in ``docs`` (doc, doc_id, text) with these ``anchors``.

    ``fresh`` are the anchors of the texts that the last search cut. A window that none of them holds has no occurrence
    left that its first one does not overlap, so it is not looked for again.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints, first = _words(batch)
            text, begin, at, _ = _anchors(prints, first)
            wanted = batch.column(batch.schema.get_field_index("anchors"))
            known = np.asarray(wanted.flatten()) + np.repeat(first[:-1], np.asarray(wanted.value_lengths()))
            near = np.isin(at, known)
            text, begin = text[near], begin[near]
            key = _window_prints(prints, begin)
            taken = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), batch.column(0).take(taken), batch.column(1).take(taken), pa.array((begin - first[text]).astype(np.int32))], ["key", "doc", "doc_id", "at"]
            )

    if fresh is not None:
        anchors = anchors.join(bounded(materialise(fresh.select("key").distinct(), "fresh")), "key", "left_semi")
    place = F.xxhash64("doc", "at")  # equal rows are one place
    twice = anchors.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo < hi").select("key")
    twice = bounded(materialise(twice, "twice"))
    near = materialise(anchors.join(twice, "key", "left_semi").groupBy("doc").agg(F.collect_set("at").alias("anchors")), "near")
    near = docs.select("doc", "doc_id", "text").join(bounded(near), "doc")
    found = materialise(near.mapInArrow(windows, "key bigint, doc bigint, doc_id bigint, at int"), "windows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "at")
    kept = found.groupBy("key").agg(F.min(order).alias("kept"), F.count("*").alias("n")).filter("n > 1").select("key", "kept")
    again = found.join(bounded(materialise(kept, "kept")), "key").filter((F.col("doc") != F.col("kept.doc")) | (F.col("at") - F.col("kept.at") >= PASSAGE))
    return again.groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def without_passages(text: bytes, starts: list[int]) -> tuple[bytes, int]:
    """The text without the words of the windows that begin at ``starts``, and their number; line breaks stay breaks."""
    data = np.frombuffer(text, np.uint8)
    begin, end, _ = words(data, np.array([0, len(data)]), SPACES)
    away = np.zeros(len(begin), dtype=bool)
    for at in starts:
        away[at : at + PASSAGE] = True
    edge = np.diff(np.concatenate([[0], away.astype(np.int8), [0]]))
    out, last = [], 0
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        to = int(begin[b]) if b < len(begin) else len(text)
        before = text[last : int(begin[a])]
        gap = text[int(begin[a]) : to]
        out += [before, b"\n" if b"\n" in gap and before and not before.endswith(b"\n") else b""]
        last = to
    return b"".join([*out, text[last:]]), int(away.sum())


def _trimmed(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc, doc_id, text, n_cut) of the documents that are cut; ``n_cut`` goes on from that of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, starts = (batch.column(k).to_pylist() for k in (2, 4))
            made = [without_passages(t.encode(), s) for t, s in zip(texts, starts, strict=True)]
            n = [a + b for a, (_, b) in zip(batch.column(3).to_pylist(), made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.decode() for t, _ in made], pa.string()), pa.array(n, pa.int64())], ["doc", "doc_id", "text", "n_cut"])

    rows = docs.join(bounded(cuts), "doc").select("doc", "doc_id", "text", "n_cut", "starts")
    return rows.mapInArrow(run, "doc bigint, doc_id bigint, text string, n_cut bigint").dropDuplicates(["doc"])


@in_small_batches
def without_repeats(docs: DataFrame, min_words: int = SHINGLE, percent: int = 80, crowd: int = 24) -> DataFrame:
    """All rows and columns of ``docs`` as a struct ``row``, the text without repeats, an array ``removed`` and ``n_cut``, the words cut as passages."""
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = whole.withColumn("doc", F.xxhash64("doc_id", "text"))
    cuts = materialise(repeated_paragraphs(whole.select("doc", "doc_id", "text"), min_words, percent, crowd), "cuts")
    # an array holds the paragraphs of one document
    by_doc = cuts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("paragraph"), "kept_doc_id", "kept_place"))).alias("removed"))
    by_doc = F.broadcast(by_doc) if measured_bytes(cuts) <= BROADCAST_BYTES else by_doc
    lines = F.split("text", "\n")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.transform("removed", lambda r: r["paragraph"]), i)), "\n")
    )
    made = whole.join(by_doc, "doc", "left").select("row", "doc", "doc_id", text.alias("text"), F.size(lines).alias("n_paragraphs"), "removed")
    docs = materialise(made.filter(F.length("text") > 0).select("doc", "doc_id", "text", F.lit(0).cast("bigint").alias("n_cut")), "kept")
    anchors, fresh, trimmed = passage_anchors(docs), None, None
    while not (starts := materialise(repeated_passages(docs, anchors, fresh), "passages")).isEmpty():
        cut = materialise(_trimmed(docs, starts), "trimmed")
        changed = bounded(cut.select("doc"))
        docs = docs.join(changed, "doc", "left_anti").unionByName(cut)
        fresh = passage_anchors(cut)
        anchors = anchors.join(changed, "doc", "left_anti").unionByName(fresh)
        trimmed = cut if trimmed is None else trimmed.join(changed, "doc", "left_anti").unionByName(cut)
    if trimmed is None:
        return made.drop("doc").withColumn("n_cut", F.lit(0).cast("bigint"))
    made = made.join(trimmed.select("doc", F.col("text").alias("_text"), "n_cut"), "doc", "left")
    return made.select("row", "doc_id", F.coalesce("_text", "text").alias("text"), "n_paragraphs", "removed", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
