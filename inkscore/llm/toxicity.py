"""Toxicity by a counterfactually regularised linear classifier.

A document's features are the distinct words it holds and their beginnings of 4, 5 and 6 bytes. Weights are fitted by
logistic regression on a bounded sample of labelled documents (``rows``), over the features whose share differs between
the labels by more than ``least_z`` standard errors. Tasks count in how many documents of each label a feature stands; only the
features that differ reach the driver, which fits their weights. For every labelled sentence that names a group, copies with the
term swapped for others of its kind are made, and squared differences of the score (before the logistic) between a
sentence and its copies are penalised with weight ``fairness``: a group's name alone then moves no score.

All documents are scored on their whole texts, row by row. Null and empty texts have the score of no features. Repeated
rows get equal scores. Without labelled rows of both kinds every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.llm.arrays import SYMBOLS, _LOWER, flat, mix, slices, span_prints, words
from inkscore.llm.decontamination import Finder
from inkscore.llm.labelled import held_out, sample
from inkscore.session import materialise, text_once

PREFIXES = (4, 5, 6)
#: Names of groups by kind. A swap stays inside its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit name of each occurrence of a feature."""
    starts, ends, first = words(data, offsets, SYMBOLS)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    names, rows = [span_prints(data, starts, ends, _LOWER)], [row]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        names.append(mix(span_prints(data, starts[long], starts[long] + k, _LOWER) + np.uint64(k)))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(names)


def distinct_features(texts: list[str]) -> list[np.ndarray]:
    row, name = features(*flat(pa.array(texts, pa.string())))
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
    row, name = row[keep], name[keep]
    return np.split(name, np.searchsorted(row, np.arange(1, len(texts)))) if texts else []


def swaps(text: str, kinds: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """Each sentence that names a group, with each copy in which one kind's terms are swapped for the next of the kind."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        low = set(re.findall(r"[^\W\d_]+", sentence.lower()))
        for kind in kinds:
            if low.isdisjoint(kind):
                continue
            for step in range(1, len(kind)):
                after = {t: kind[(k + step) % len(kind)] for k, t in enumerate(kind)}
                out.append((sentence, re.sub(r"[^\W\d_]+", lambda m, a=after: a.get(m[0].lower(), m[0]), sentence)))
    return out


@dataclass
class Model:
    names: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray, finder: Finder) -> np.ndarray:
        row, name = features(data, offsets)
        at, k = finder.places(name)
        pairs = np.unique(row[at] * len(self.names) + k) if len(at) else np.zeros(0, np.int64)
        total = np.bincount(pairs // max(1, len(self.names)), self.weights[pairs % max(1, len(self.names))], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def fit(texts: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], least_z: float = 4.0, ridge: float = 0.02, fairness: float = 1.0, rounds: int = 300) -> Model:
    """Weights from distinct features by text, labels, and the features of sentences and their swapped copies."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 500.0 if share else -500.0)
    size = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), size)
    names, at = np.unique(np.concatenate(texts), return_inverse=True)
    toxic = np.bincount(at, labels[row], minlength=len(names))
    every = np.bincount(at, minlength=len(names))
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    p, q, mean = (toxic + 0.5) / (ones + 1), (every - toxic + 0.5) / (zeros + 1), (every + 1) / (len(labels) + 2)
    z = (p - q) / np.sqrt(mean * (1 - mean) * (1 / ones + 1 / zeros))
    kept = np.flatnonzero((np.abs(z) > least_z) & (every >= 3))
    place = np.full(len(names), -1)
    place[kept] = np.arange(len(kept))
    use = place[at] >= 0
    r, c = row[use], place[at][use]
    names = names[kept]

    def columns(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat_names = np.concatenate(own) if own else np.zeros(0, np.uint64)
        k = np.minimum(np.searchsorted(names, flat_names), max(0, len(names) - 1))
        ok = names[k] == flat_names if len(names) else np.zeros(len(flat_names), bool)
        return np.repeat(np.arange(len(own)), [len(x) for x in own])[ok], k[ok]

    (ra, ca), (rb, cb) = columns([a for a, _ in pairs]), columns([b for _, b in pairs])
    n, d, m = len(labels), len(kept), len(pairs)
    weights, bias = np.zeros(d), np.log(share / (1 - share))
    first, second, first_b, second_b = np.zeros(d), np.zeros(d), 0.0, 0.0
    for step in range(1, rounds + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights[c], minlength=n) + bias, -50, 50)))
        error = score - labels
        grad = np.bincount(c, error[r], minlength=d) / n + ridge * weights / n**0.5
        if m:
            gap = np.bincount(ra, weights[ca], minlength=m) - np.bincount(rb, weights[cb], minlength=m)
            grad += 2 * fairness * (np.bincount(ca, gap[ra], minlength=d) - np.bincount(cb, gap[rb], minlength=d)) / m
        grad_b = error.mean()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        first_b, second_b = 0.9 * first_b + 0.1 * grad_b, 0.99 * second_b + 0.01 * grad_b**2
        rate = 0.1 / (1 + step / 100)
        weights -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        bias -= rate * first_b / (1 - 0.9**step) / (np.sqrt(second_b / (1 - 0.99**step)) + 1e-8)
    return Model(names, weights, float(bias))


def telling(found: DataFrame, least_z: float) -> DataFrame:
    """The names of the features of (label, features) whose share may differ by ``least_z`` standard errors, as ``fit`` has it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "features"):
            own = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            label = np.repeat(np.asarray(batch.column(0), dtype=np.int64), [len(x) for x in own])
            names, at = np.unique(np.concatenate(own), return_inverse=True)
            columns = names, np.bincount(at, label, len(names)).astype(np.int64), np.bincount(at, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["name", "toxic", "every"])

    n, ones = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        return found.sparkSession.createDataFrame([], "name bigint")
    counted = found.select("label", "features").mapInArrow(count, "name bigint, toxic bigint, every bigint")
    counted = counted.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every"))
    p, q = (F.col("toxic") + 0.5) / (ones + 1), (F.col("every") - F.col("toxic") + 0.5) / (n - ones + 1)
    mean = (F.col("every") + 1) / (n + 2)
    z = (p - q) / F.sqrt(mean * (1 - mean) * (1 / ones + 1 / (n - ones)))
    return counted.filter((F.abs(z) > least_z - 1e-6) & (F.col("every") >= 3)).select("name")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = 8_000, kinds=IDENTITY_TERMS, least_z: float = 4.0, **settings) -> Model:
    """Fits on at most ``rows`` labelled documents; their features are made and counted by tasks.

    What reaches the driver are the features that tell the labels apart, and which of them each document, sentence and copy holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            own = [x.tobytes() for x in distinct_features(texts)]
            made = []
            for text in texts:
                pairs = swaps(text, kinds)
                a, b = distinct_features([x for x, _ in pairs]), distinct_features([y for _, y in pairs])
                made.append([v for x, y in zip(a, b, strict=True) for v in (x.tobytes(), y.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.binary()), pa.array(made, pa.list_(pa.binary()))], ["label", "features", "pairs"])

    found = sample(docs, labels, "toxic", folds, fold, rows).mapInArrow(run, "label int, features binary, pairs array<binary>")
    found = materialise(found, "toxicity-features")
    names = np.sort(telling(found, least_z).toArrow().column(0).to_numpy().view(np.uint64))
    given = docs.sparkSession.sparkContext.broadcast(names)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = given.value

        def only(own: bytes) -> bytes:
            name = np.frombuffer(own, np.uint64)
            at = np.minimum(np.searchsorted(known, name), max(0, len(known) - 1))
            return (name[known[at] == name] if len(known) else name[:0]).tobytes()

        for batch in slices(batches, "features"):
            own = [only(x) for x in batch.column(1).to_pylist()]
            pairs = [[only(x) for x in sides] for sides in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(pairs, pa.list_(pa.binary()))], batch.schema.names)

    held = found.mapInArrow(kept, found.schema).toArrow()
    columns = [held.column(c).to_pylist() for c in ("features", "label", "pairs")]
    ordered = sorted(zip(*columns, strict=True))  # the same sums however the rows were dealt
    bits = lambda x: np.frombuffer(x, dtype=np.uint64)
    pairs = [bits(x) for _, _, own in ordered for x in own]
    return fit(
        [bits(x) for x, _, _ in ordered],
        np.array([label for _, label, _ in ordered], dtype=float),
        list(zip(pairs[::2], pairs[1::2], strict=True)),
        least_z=least_z,
        **settings,
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` as a struct ``row``, and ``score``."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    rows, whole = text_once(docs)
    rows = rows.withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given.value.names)
        for batch in slices(batches):
            found = given.value.scores(*flat(batch.column(1)), finder)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema).select(whole.alias("row"), "score")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, whether it is held out, score and prediction for each row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, folds, fold)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
