"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the last may be shorter); every passage of the whole text is
encoded. Labels are known for documents only: gated attention learns which passages decide, the document's
representation is the attention-weighted sum of its passages' codes, and a logistic unit scores it.

Fitted with Adam on a bounded sample of labelled documents (``rows``); all documents are scored row by row. Null and
empty texts are empty bags with the score of a zero representation. Repeated rows get equal scores. Without labelled
rows of both kinds every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.llm.arrays import SPACES, _LOWER, flat, mix, slices, span_prints, words
from inkscore.llm.labelled import held_out, sample

PASSAGE = 60
_MARKS = np.frombuffer(b"*&$%#!|.,@+()-<>/?:;'\"", dtype=np.uint8)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of measures for each passage, and the first passage of each text."""
    starts, ends, first = words(data, offsets, SPACES)
    count = np.diff(first)
    number = -(-count // PASSAGE)
    bag = np.concatenate([[0], np.cumsum(number)])
    if not bag[-1]:
        return np.zeros((0, WIDTH)), bag
    row = np.repeat(np.arange(len(count)), number)
    begin = first[:-1][row] + (np.arange(bag[-1]) - bag[:-1][row]) * PASSAGE
    end = np.minimum(begin + PASSAGE, first[1:][row])
    n = (end - begin).astype(float)
    size = (ends[end - 1] - starts[begin]).astype(float)
    kind = np.zeros(256, dtype=np.int64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:], kind[_MARKS] = 1, 2, 3, 4, np.arange(5, 5 + len(_MARKS))
    width = 5 + len(_MARKS)
    of_byte = np.repeat(np.arange(len(begin)), ends[end - 1] - starts[begin])
    places = np.arange(len(of_byte)) + np.repeat(starts[begin] - np.concatenate([[0], np.cumsum(size[:-1])]).astype(np.int64), size.astype(np.int64))
    shares = np.bincount(of_byte * width + kind[data[places]], minlength=len(begin) * width).reshape(-1, width) / size[:, None]
    prints = span_prints(data, starts, ends, _LOWER)
    of_word = np.repeat(np.arange(len(begin)), end - begin)
    named, times = np.unique(prints ^ mix(of_word.astype(np.uint64)), return_counts=True)
    back = times[np.searchsorted(named, prints ^ mix(of_word.astype(np.uint64)))]
    again = np.zeros(len(prints))
    again[1:] = prints[1:] == prints[:-1]
    lengths = (ends - starts).astype(float)
    per = lambda x: np.bincount(of_word, x, minlength=len(begin)) / n
    most = np.maximum.reduceat(back, begin) / n
    mean = per(lengths)
    words_in = [per(1.0 / back), most, per(again), mean / 10, np.sqrt(np.maximum(per(lengths**2) - mean**2, 0)) / 10, n / PASSAGE, np.ones_like(n)]
    return np.column_stack([np.sqrt(shares), *words_in]), bag


WIDTH = 5 + len(_MARKS) + 7


def _softmax(x: np.ndarray, bag: np.ndarray, row: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(x, bag)
    e = np.exp(x - top[row])
    return e / np.add.reduceat(e, bag)[row]


class Model:
    """Encoder, gated attention and score; ``shift`` and ``scale`` standardise the measures."""

    def __init__(self, codes: int = 16, gates: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "w": rng.normal(0, WIDTH**-0.5, (WIDTH, codes)),
            "v": rng.normal(0, codes**-0.5, (codes, gates)),
            "u": rng.normal(0, codes**-0.5, (codes, gates)),
            "a": rng.normal(0, gates**-0.5, gates),
            "c": np.zeros(codes),
            "b": np.zeros(1),
        }
        self.shift, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bag: np.ndarray) -> tuple:
        """Scores of non-empty bags whose first passages are ``bag``, and what the gradient needs."""
        p = self.p
        row = np.repeat(np.arange(len(bag)), np.diff(np.append(bag, len(x))))
        h = np.tanh(((x - self.shift) / self.scale) @ p["w"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        weight = _softmax((t * s) @ p["a"], bag, row)
        z = np.add.reduceat(h * weight[:, None], bag)
        return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -500, 500))), row, h, t, s, weight, z

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, by: np.ndarray, ridge: float) -> dict[str, np.ndarray]:
        p = self.p
        score, row, h, t, s, weight, z = self.forward(x, bag)
        e = (score - y) * by
        dz = e[:, None] * p["c"]
        dweight = (h * dz[row]).sum(axis=1)
        centre = np.add.reduceat(dweight * weight, bag)
        dlogit = weight * (dweight - centre[row])
        dts = dlogit[:, None] * p["a"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh = (weight[:, None] * dz[row] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        out = {"w": ((x - self.shift) / self.scale).T @ dh, "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ dlogit, "c": z.T @ e, "b": np.array([e.sum()])}
        return {k: g + ridge * p[k] * (k != "b") for k, g in out.items()}

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, bag = passages(data, offsets)
        out = np.full(len(offsets) - 1, 1 / (1 + np.exp(-np.clip(self.p["b"][0], -500, 500))))
        full = np.flatnonzero(np.diff(bag))
        if len(full):
            out[full] = self.forward(x, bag[:-1][full])[0]
        return out


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 0.01, ridge: float = 1e-4, seed: int = 7) -> Model:
    """``x``: measures of all passages; ``bag``: first passages of the (non-empty) documents; ``y``: their labels."""
    model = Model(seed=seed)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        model.p["b"][:] = 500.0 if share else -500.0
        return model
    model.shift, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    by_label = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # half-way to equal weight of both labels
    ends = np.append(bag[1:], len(x))
    rng = np.random.default_rng(seed)
    first, second, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bag))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            size = ends[own] - bag[own]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(bag[own], ends[own], strict=True)])
            step += 1
            for k, g in model.gradient(x[rows], np.cumsum(size) - size, y[own], by_label[own] / len(own), ridge).items():
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                now = rate * (1 - epoch / epochs)
                model.p[k] = model.p[k] - now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, rows: int = 6_000, **settings) -> Model:
    """Fits on at most ``rows`` labelled documents, whose passages are encoded by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, bag = passages(*flat(batch.column(0)))
            own = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bag[:-1], bag[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.binary())], ["label", "bag"])

    held = sample(docs, labels, "quality", folds, fold, rows).mapInArrow(run, "label int, bag binary").filter(F.length("bag") > 0).toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in held.column("bag").to_pylist()]
    size = np.array([len(b) for b in bags], dtype=np.int64)
    x = np.concatenate(bags).astype(float) if bags else np.zeros((0, WIDTH))
    return fit(x, np.cumsum(size) - size, np.array(held.column("label").to_pylist(), dtype=float), **settings)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, whether it is held out, score and prediction for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(*flat(batch.column(1))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
