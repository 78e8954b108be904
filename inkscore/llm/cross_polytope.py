"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Equal vectors form one class; only classes are indexed, each with its ``k`` + 1 smallest ids, which is all a query can
return of it. Vectors fall into bands of norms that grow by an eighth of an octave, are scaled by the largest norm of
their own band and get one coordinate that makes them unit vectors (queries get 0 there), so that within a band the
largest inner product is the smallest angle, and one long vector moves no other. Each of ``tables`` pseudo-rotations
(three rounds of fixed random signs and a fast Hadamard transform) assigns a vector to the nearest of the 2 D signed
axes; a query looks into the buckets of its nearest ones, for all bands at once: ``probes`` of them, or an eighth of all
axes if that is more. A bucket is cut into blocks of about ``block`` candidates, so one that holds a third of all rows
is many tasks; its queries pass by each block in batches. Every block returns each query's best ``k`` + 1 classes by
exact inner products, and the best of all blocks are the result.

The same search serves every number of rows. Queries that find fewer than ``k`` vectors in the buckets, while there are
more of their length, are compared with all of that length, block by block. So every query gets min(``k``, others of its length) rows; ``functions`` > 1 refines buckets for large tables.
Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors only meet vectors of
their length. Rows that repeat a vec_id and its vector are one row. Rows without vec_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkscore.llm.arrays import stream
from inkscore.session import materialise

#: Bands of norms in an octave.
BANDS = 8


def signs(table: int, function: int, d: int) -> np.ndarray:
    bits = stream(5000 + 64 * table + function, 3 * d).reshape(3, d)
    return np.where(bits >> np.uint64(63), 1.0, -1.0)


def rotate(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Three rounds of signs and a Hadamard transform on rows whose length is a power of two."""
    d = x.shape[1]
    for s in sign:
        x, h = x * s, 1
        while h < d:
            y = x.reshape(len(x), d // (2 * h), 2, h)
            x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), d)
            h *= 2
        x = x / d**0.5
    return x


def axes(x: np.ndarray, table: int, function: int, best: int) -> np.ndarray:
    """The nearest ``best`` signed axes of each row, nearest first: 2 j for +axis j, 2 j + 1 for -axis j."""
    turned = rotate(x, signs(table, function, x.shape[1]))
    both = np.stack([turned, -turned], axis=2).reshape(len(x), -1)
    if best == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :best]


def log_norms(x: np.ndarray) -> np.ndarray:
    """Binary logarithms of the norms of rows that are not zero, whatever their scale."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    return np.log2(scale[:, 0]) + np.log2(np.linalg.norm(x / scale, axis=1))


def lifted(x: np.ndarray, share: np.ndarray | None) -> np.ndarray:
    """Unit vectors of power-of-two length; candidates keep the ``share`` their norm has of their band's largest."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    share = np.ones((len(x), 1)) if share is None else np.minimum(share, 1.0)[:, None]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * share
    d = 1 << int(x.shape[1]).bit_length()
    return np.hstack([x, np.sqrt(1 - share**2), np.zeros((len(x), d - x.shape[1] - 1))])


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column of equal lengths."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    size = np.asarray(batch.column(batch.schema.get_field_index(name)).value_lengths())
    for n in np.unique(size).tolist():
        yield batch.take(pa.array(np.flatnonzero(size == n)))


def _with_band(classes: DataFrame) -> DataFrame:
    """(id, vector, size, norm, band) of (id, vector); ``norm`` is a binary logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, "vector"):
                norm = log_norms(_matrix(batch.column(1)))
                size = np.full(len(norm), len(batch.column(1)[0]), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(size), pa.array(norm), pa.array(np.floor(norm * BANDS).astype(np.int32))], ["id", "vector", "size", "norm", "band"]
                )

    return classes.mapInArrow(run, "id bigint, vector array<double>, size int, norm double, band int")


def _bucketed(classes: DataFrame, tables: int, functions: int, probes: int, query: bool) -> DataFrame:
    """(bucket, id, vector): each class (id, vector, share) in its bucket of every table, or a query in those it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, "vector"):
                x = lifted(_matrix(batch.column(1)), None if query else np.asarray(batch.column(2)))
                n = np.uint64(len(batch.column(1)[0]))
                best = min(2 * x.shape[1], max(probes, x.shape[1] // 4)) if query else 1
                for t in range(tables):
                    found = np.zeros((len(x), 1), dtype=np.uint64)
                    for f in range(functions):
                        own = axes(x, t, f, best).astype(np.uint64)
                        found = (found[:, :, None] * np.uint64(2 * x.shape[1]) + own[:, None, :]).reshape(len(x), -1)
                    bucket = ((n << np.uint64(48)) + found * np.uint64(tables) + np.uint64(t)).astype(np.int64)
                    for p in range(bucket.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(bucket[:, p]), batch.column(0), batch.column(1)], ["bucket", "id", "vector"])

    return classes.mapInArrow(run, "bucket bigint, id bigint, vector array<double>")


def _rerank(rows: DataFrame, k: int) -> DataFrame:
    """Best ``k`` + 1 candidates of each query in its block; rows are sorted by block, candidates (side 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, held = None, [], []
        stack = None
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            at = 0
            while at < len(key):
                to = at + 1
                while to < len(key) and key[to] == key[at]:
                    to += 1
                part, own = batch.slice(at, to - at), key[at][:2]
                if own != here:
                    here, ids, held, stack = own, [], [], None
                if key[at][2] == 0:
                    ids.append(np.asarray(part.column(3)))
                    held.append(_matrix(part.column(4)))
                elif ids:
                    if stack is None:
                        stack = np.concatenate(ids), np.concatenate(held)
                    yield from best(part, *stack)
                at = to

    def best(part: pa.RecordBatch, ids: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.num_rows, 256):
            q = _matrix(part.column(4).slice(at, 256))
            own = np.asarray(part.column(3).slice(at, 256))
            near = q @ held.T
            if len(ids) > k + 1:
                least = np.partition(near, len(ids) - k - 1, axis=1)[:, -k - 1]
                row, column = np.nonzero(near >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
            else:
                row, column = np.divmod(np.arange(near.size), len(ids))
            exact = (q[row] * held[column]).sum(axis=1)
            order = np.lexsort((ids[column], -exact, row))
            row, column, exact = row[order], column[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            ok = rank <= k
            yield pa.RecordBatch.from_arrays([pa.array(own[row[ok]]), pa.array(ids[column[ok]]), pa.array(exact[ok])], ["query", "id", "score"])

    return rows.mapInArrow(run, "query bigint, id bigint, score double")


def _met(index: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """(query, id, score): the best of each block of the buckets in which queries and candidates (bucket, id, vector) meet."""
    parts = materialise(index.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "buckets")
    c = index.join(parts, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "vector")
    q = queries.join(parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "vector")
    met = c.unionByName(q).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side")
    return _rerank(met, k).distinct()


def _lists(found: DataFrame, few: DataFrame, k: int) -> DataFrame:
    """(id, near): the best ``k`` + 1 vec_ids of each query class."""
    top = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    best = found.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k + 1).drop("_r")
    # the classes' members: k + 1 classes of k + 1 ids at most
    members = best.join(few.select("id", "ids"), "id").select("query", F.explode("ids").alias("vec_id"), "score")
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = members.withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") <= k + 1)
    return ranked.groupBy(F.col("query").alias("id")).agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("near"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 8, probes: int = 32, functions: int = 1, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found, for each row of (vec_id, embedding) that ``is_query``."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"), is_query.alias("asked")).filter(_usable(F.col("vector")) & F.col("vec_id").isNotNull())
    rows = materialise(rows.withColumn("key", F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256)), "vectors")
    smallest = Window.partitionBy("key").orderBy("vec_id")
    distinct = rows.select("key", "vec_id").distinct()
    first = distinct.withColumn("_r", F.row_number().over(smallest)).filter(F.col("_r") <= k + 1)  # pruned before the shuffle
    few = first.groupBy("key").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    few = materialise(few, "classes")
    reps = rows.join(few.select(F.col("id").alias("vec_id"), "id", "key"), ["key", "vec_id"]).dropDuplicates(["id"]).select("id", "vector")
    reps = materialise(_with_band(reps), "reps")
    asked = rows.filter("asked").select("vec_id", "key").distinct().join(few.select("key", "id"), "key").select("vec_id", "id")
    asked = materialise(asked, "asked")
    searching = reps.join(asked.select("id").distinct(), "id", "left_semi")
    # the vectors there are of a length, counted no further than a query can tell
    sizes = reps.join(few.select("id", F.size("ids").alias("n")), "id").groupBy("size").agg(F.sum("n").alias("n"))
    sizes = materialise(sizes, "sizes")
    bands = materialise(reps.groupBy("size", "band").agg(F.max("norm").alias("largest")), "bands")
    shares = reps.join(bands, ["size", "band"]).select("id", "vector", F.pow(F.lit(2.0), F.col("norm") - F.col("largest")).alias("share"))
    index = _bucketed(shares, tables, functions, probes, False)
    found = _met(index, _bucketed(searching.select("id", "vector"), tables, functions, probes, True), k, block)
    lists = materialise(_lists(found, few, k), "lists")
    short = searching.join(lists, "id", "left").join(sizes, "size").filter(F.coalesce(F.size("near"), F.lit(0)) < F.least(F.lit(k + 1), "n"))
    short = materialise(short.select("id", "vector", "size"), "short")
    if not short.isEmpty():
        whole = lambda df: df.select(F.col("size").cast("bigint").alias("bucket"), "id", "vector")
        rest = _met(whole(reps.join(short.select("size").distinct(), "size", "left_semi")), whole(short), k, block)
        lists = lists.join(short, "id", "left_anti").unionByName(_lists(rest, few, k))
    own = asked.join(lists, "id").withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k))
    return own.select(F.col("vec_id").alias("query_id"), F.posexplode("near").alias("_p", "x")).select("query_id", (F.col("_p") + 1).alias("rank"), "x.vec_id", "x.score")
