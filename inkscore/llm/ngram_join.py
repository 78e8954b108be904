"""Exact self-join of documents on the Jaccard similarity of their word shingles, by universe partition.

Two sets with ``100 * intersection >= percent * union`` differ in at most H = (100 - p)(r + s) / (100 + p) shingles.
The hash space of shingles is cut into m segments by the size band of the larger set, m = H + 1 + slack for the
largest sizes of the band: at least slack + 1 segments of such a pair then hold equal subsets. A document is indexed
under the subsets of its non-empty segments, in its own band and in the next one if sets there can be similar.

Values are allocated to segments by cost. Rare subsets get 1 (equal subsets meet). Subsets that more than ``crowd``
documents have, and empty ones, cost most and get 0, which the slack pays for. A document whose remaining segments
sum to less than H + 1 is indexed anew under its subsets and their one-deletion neighbourhoods: segments whose keys
are all rare then get 2 (subsets that differ by one shingle meet), others 1 or 0. Only documents that fall short even
so meet in their crowded and empty segments too. What a document's rare segments sum to beyond H is also the number of
rare subsets that it shares with any similar one: pairs with fewer in common are dropped before their texts travel. Nothing is skipped: each similar pair meets at some key, or its ends
are already in one component. Candidates are verified on their full sets.

Shingles and sets are compared by 64-bit fingerprints. Documents with equal sets are one class and are compared once.
Null texts and texts without words have no shingles and no links. Repeated rows each get their row; a null ``doc_id``
never names a component unless all its members have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.llm.arrays import SPACES, flat, jaccard_reaches, mix, set_print, shingle_sets, slices, stream, word_prints
from inkscore.llm.links import Links, bounded, components, joined_families, settle, shared
from inkscore.session import in_small_batches, materialise

_SEEN = 500_000


class Bands:
    """Size bands whose ends grow by half, with H and m of each."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent = percent
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, low[-1] * 3 // 2))
        self.low = np.array(low)
        self.most = [(100 - percent) * 2 * (high - 1) // (100 + percent) for high in low[1:]]
        self.segments = [h + 1 + -(-(h + 1) // 5) for h in self.most]

    def views(self, n: int) -> list[int]:
        """The bands in which a set of ``n`` shingles is looked for: its own, then those of larger similar sets."""
        own = int(np.searchsorted(self.low, n, side="right")) - 1
        out = [own]
        while 100 * n >= self.percent * int(self.low[out[-1] + 1]):
            out.append(out[-1] + 1)
        return out

    def cut(self, own: np.ndarray, band: int) -> np.ndarray:
        """Where each segment of a sorted set begins; segments are equal stretches of the hash space."""
        m = self.segments[band]
        edges = (np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m)).astype(np.uint64)
        return np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])

    def keys(self, own: np.ndarray, mixed: np.ndarray, band: int, deletions: bool = False):
        """Keys and segments of the non-empty subsets; with ``deletions`` also those of subsets less one shingle."""
        at = self.cut(own, band)
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=sums[1:])
        totals = sums[at[1:]] - sums[at[:-1]]
        size = np.diff(at)
        salt = stream(1000 + band, len(size))
        full = np.flatnonzero(size)

        def key(total: np.ndarray, segment: np.ndarray) -> np.ndarray:
            return ((mix(total ^ salt[segment]) & ~np.uint64(63)) | np.uint64(band & 63)).view(np.int64)

        if not deletions:
            return key(totals[full], full)
        segment = np.repeat(np.arange(len(size)), size)
        many = size[segment] > 1
        empty = np.flatnonzero(size == 0)
        return (
            np.concatenate([key(totals[full], full), key(totals[segment[many]] - mixed[many], segment[many]), key(np.zeros(len(empty), np.uint64), empty)]),
            np.concatenate([full, segment[many], empty]),
            np.concatenate([np.where(size[full] > 1, 0, 1), np.full(int(many.sum()), 2), np.full(len(empty), 3)]),
        )


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets(*word_prints(*flat(batch.column(batch.schema.get_field_index("text"))), SPACES))


def _classes(docs: DataFrame, bands: Bands) -> DataFrame:
    """doc_id, number of shingles, class, and by view its band, H + 1 and number of non-empty segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for own in _sets(batch):
                views = bands.views(len(own)) if len(own) else []
                filled = [{"band": v, "need": bands.most[v] + 1, "filled": int((np.diff(bands.cut(own, v)) > 0).sum())} for v in views]
                rows.append((len(own), set_print(own) if len(own) else None, filled))
            n, c, v = zip(*rows, strict=True)
            kind = pa.list_(pa.struct([("band", pa.int32()), ("need", pa.int32()), ("filled", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(v, kind)], ["doc_id", "n", "id", "views"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, id bigint, views array<struct<band:int,need:int,filled:int>>")


def _index(docs: DataFrame, bands: Bands) -> DataFrame:
    """(key, id) of all documents; a task leaves out classes it has just indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            keys, ids = [], []
            for own in _sets(batch):
                if not len(own) or (c := set_print(own)) in seen:
                    continue
                seen.add(c)
                mixed = mix(own + np.uint64(5))
                for view in bands.views(len(own)):
                    keys.append(bands.keys(own, mixed, view))
                    ids.append(np.full(len(keys[-1]), c))
            if len(seen) > _SEEN:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key bigint, id bigint")


def _index_around(texts: DataFrame, bands: Bands) -> DataFrame:
    """Keys of subsets and their one-deletion neighbourhoods for (text, views): key, id, band, segment and kind.

    Kinds: 0 a subset, 1 a subset of one shingle, 2 a subset less one shingle, 3 an empty segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            views = batch.column(batch.schema.get_field_index("views")).to_pylist()
            for own, wanted in zip(_sets(batch), views, strict=True):
                mixed, c = mix(own + np.uint64(5)), set_print(own)
                for view in wanted:
                    key, segment, kind = bands.keys(own, mixed, view, True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.full(len(key), c)), pa.array(np.full(len(key), view, np.int32)), pa.array(segment.astype(np.int32)), pa.array(kind.astype(np.int32))],
                        ["key", "id", "band", "segment", "kind"],
                    )

    return texts.mapInArrow(run, "key bigint, id bigint, band int, segment int, kind int")


def _texts(docs: DataFrame, classes: DataFrame):
    """(id, text) of given classes: rows of the classes' first documents, whose class is made anew from the text."""
    reps = materialise(classes.groupBy("id").agg(F.min("doc_id").alias("doc_id")), "first-documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [set_print(own) if len(own) else None for own in _sets(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(1)], ["id", "text"])

    def get(ids: DataFrame) -> DataFrame:
        wanted = bounded(materialise(reps.join(ids, "id", "left_semi").select("doc_id"), "wanted"))
        rows = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        return materialise(rows.mapInArrow(run, "id bigint, text string").join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")

    return get


@in_small_batches
def similar_components(docs: DataFrame, percent: int = 80, crowd: int = 24) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for each row of (doc_id, text)."""
    bands = Bands(percent)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(_classes(docs, bands), "classes")
    classes = rows.filter("id is not null")
    texts = _texts(docs, classes)

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        return shingle_sets(*word_prints(*flat(column), SPACES))

    members = materialise(shared(_index(docs, bands)), "members")
    # by view, the rare segments beyond the H that a linked document may not share
    common = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key")
    taken = members.join(common, "key", "left_semi").groupBy("id", F.col("key").bitwiseAND(63).alias("band")).agg(F.count("*").alias("crowded"))
    views = classes.dropDuplicates(["id"]).select("id", F.explode("views").alias("v")).select("id", "v.*")
    ours = views.join(members.select("id").distinct(), "id", "left_semi").join(taken, ["id", "band"], "left")
    spare = materialise(ours.select("id", "band", (F.col("filled") - F.coalesce("crowded", F.lit(0)) - F.col("need") + 1).alias("spare")), "spare")
    links = Links()
    crowded = settle(members, links, texts, sets_of, percent, crowd, spare)

    # views of which that leaves nothing, counting crowds of more than one component
    taken = crowded.groupBy("id", F.col("key").bitwiseAND(63).alias("band")).agg(F.count("*").alias("crowded"))
    short = materialise(
        views.join(taken, ["id", "band"], "left").filter(F.col("filled") - F.coalesce("crowded", F.lit(0)) < F.col("need")).select("id", "band", "need"), "short"
    )
    if not short.isEmpty():
        wanted = short.groupBy("id").agg(F.collect_set("band").alias("views"))  # at most three views
        around = materialise(_index_around(texts(wanted.select("id")).join(wanted, "id"), bands), "around")
        near = materialise(shared(around.filter("kind != 3").select("key", "id")), "near")
        settle(near, links, texts, sets_of, percent, crowd)
        common = near.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key", F.lit(True).alias("common"))
        value = (
            around.filter("kind != 3")
            .join(common, "key", "left")
            .groupBy("id", "band", "segment")
            .agg(F.max((F.col("kind") < 2) & F.col("common").isNotNull()).alias("no"), F.max((F.col("kind") == 1) | F.col("common").isNotNull()).alias("one"))
            .select("id", "band", F.when(F.col("no"), 0).when(F.col("one"), 1).otherwise(2).alias("value"))
        )
        last = value.groupBy("id", "band").agg(F.sum("value").alias("value")).join(short, ["id", "band"], "right").filter(F.coalesce("value", F.lit(0)) < F.col("need"))
        left = around.filter("kind = 3 or kind < 2").join(last.select("id", "band"), ["id", "band"], "left_semi")
        left = left.join(common, "key", "left").filter("kind = 3 or common").select("key", "id")
        rest = materialise(shared(left), "rest")
        crowded = settle(rest, links, texts, sets_of, percent, crowd)
        family = components(crowded.groupBy("key").agg(F.min("id").alias("a")).join(crowded, "key").select("a", F.col("id").alias("b")).filter("a != b").distinct())
        last = crowded.select("id", "c").distinct().join(family.withColumnRenamed("component", "family"), "id")
        links.add(joined_families(last, texts, sets_of, percent))

    first = classes.groupBy("id").agg(F.min("doc_id").alias("first"))
    known = links.label(first)
    named = known.join(known.groupBy("c").agg(F.min("first").alias("component_id")), "c").select("id", "component_id")
    return rows.join(named, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
