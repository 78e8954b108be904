"""Links inside groups of rows that share a key, and the components they form, without all pairs of a group.

A group whose members are one component is settled: no further link can change a component. Members of crowded groups
are first compared with the group's first member; only members of different components are compared further.
All tables hold 64-bit identifiers; nothing is collected to the driver, and lineage is cut by written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.llm.arrays import jaccard_reaches, slices
from inkscore.llm.bpe import ragged
from inkscore.session import materialise, measured_bytes

#: Bytes, as measured, up to which a side is broadcast: a million rows of one identifier; beyond, the join shuffles.
BROADCAST_BYTES = 32_000_000
_EDGES = 1 << 20


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if all its rows, arrays included, measure at most ``most`` bytes."""
    return F.broadcast(df) if measured_bytes(df) <= most else df


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (u, v) that is not the smallest of its component, in ascending order, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while len(np.flatnonzero((up := root[root]) != root)):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    lower = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[lower], nodes[root[lower]]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (u, v), u > v, dealt out by u; within a task each node then points to the smallest one it reaches there.

    A task reads its edges in the order of u and holds ``_EDGES`` at most: of the last u, which may go on, it keeps one edge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined(last: bool) -> Iterator[pa.RecordBatch]:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(u):
                return
            node, to = forest(u, v)
            out = np.ones(len(node), dtype=bool)
            if not last:
                out = node != u[-1]
                held.append((node[~out], to[~out]))
            yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(to[out])], ["u", "v"])

        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            if sum(len(x) for x, _ in held) >= _EDGES:
                yield from joined(False)
        if held:
            yield from joined(True)

    return edges.repartition("u").sortWithinPartitions("u", "v").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of the edges (a, b); the component is its smallest id.

    Alternating stars: a round points every edge to the smallest neighbour of its smaller end, then joins each larger end's
    edges, and whatever else meets in a task, to the smallest node there; rounds grow with the logarithm of the longest path.
    A graph of at most ``_EDGES`` edges (16 MB), counted, is one task's share and takes one pass.
    """

    def stars(df: DataFrame) -> bool:
        """Whether every node points to one root that points nowhere."""
        ends = df.select(F.col("u").alias("x"), F.lit(True).alias("points")).unionByName(df.select(F.col("v").alias("x"), F.lit(False).alias("points")))
        seen = ends.groupBy("x").agg(F.count_if("points").alias("out"), F.bool_and("points").alias("only"))
        return seen.filter("out > 1 or (out = 1 and not only)").isEmpty()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if rows:
            u, v = (np.concatenate(x) for x in zip(*rows, strict=True))
            node, to = forest(u, v)
            roots = np.unique(to)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([to, roots]))], ["id", "component"])

    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), "edges")
    if now.count() <= _EDGES:  # no more than a task holds at a time anyway
        return materialise(now.coalesce(1).mapInArrow(whole, "id bigint, component bigint"), "components")
    now = materialise(contracted(now), "edges")
    while not stars(now):
        least = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        now = materialise(contracted(now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))), "edges")
    roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def shared(keys: DataFrame) -> DataFrame:
    """(key, id, first) of each key that at least two ids have; ``first`` is its smallest id.

    The rows are sorted by key and read as a stream that holds one row back, so a group may be of any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, i, first = (np.zeros(0, np.int64) for _ in range(3))
        shared_before = False
        for batch in batches:
            k, n = (np.concatenate([a, np.asarray(batch.column(c))]) for c, a in (("key", key), ("id", i)))
            if not len(k):
                continue
            fresh = np.ones(len(k), dtype=bool)
            fresh[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
            k, n = k[fresh], n[fresh]
            opens = np.ones(len(k), dtype=bool)
            opens[1:] = k[1:] != k[:-1]
            begin = np.maximum.accumulate(np.where(opens, np.arange(len(k)), 0))
            head = n[begin]
            if len(first):  # the row held back may go on with a key that began earlier
                head[begin == 0] = first[0]
            known = np.zeros(len(k), dtype=bool)
            known[:-1] |= ~opens[1:]
            known |= ~opens
            if len(first):
                known[0] |= shared_before
            out = known[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][out]) for x in (k, n, head)], ["key", "id", "first"])
            key, i, first, shared_before = k[-1:], n[-1:], head[-1:], bool(known[-1])
        if shared_before:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(i), pa.array(first)], ["key", "id", "first"])

    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.sparkSession.sparkContext.defaultParallelism)
    rows = keys.repartition(parts, "key").sortWithinPartitions("key", "id")
    return rows.mapInArrow(run, "key bigint, id bigint, first bigint")


Texts = Callable[[DataFrame], DataFrame]
Sets = Callable[[pa.Array], list[np.ndarray]]


def verified(pairs: DataFrame, texts: Texts, sets_of: Sets, percent: int) -> DataFrame | None:
    """The pairs (a, b) that are links, or None if there are no pairs.

    ``texts(ids)`` gives (id, text) for given ids from a written table, ``sets_of`` their shingles. Members travel to their leader ``a``,
    whose own text is sent once for every 500 of them.
    """
    pairs = materialise(pairs, "pairs")
    if pairs.isEmpty():
        return None
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    content = texts(ids)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).alias("_parts"))
    members = pairs.join(salts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("_salt"), "b")
    leaders = salts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_salt"), F.lit(None).cast("bigint").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_set = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for part in slices(iter([batch])):
                for a, b, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets_of(part.column(3)), strict=True):
                    if b is None:
                        lead, lead_set = a, own
                    elif lead == a and jaccard_reaches(lead_set, own, percent):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    rows = members.unionByName(leaders).join(content, "id").select("a", "_salt", "b", "text").repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())
    return materialise(rows.mapInArrow(run, "a bigint, b bigint"), "links")


def _join_block(ids: list[int], comps: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join components inside one block; with two sides only pairs across them are compared."""
    root = {c: c for c in comps}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, holders = np.concatenate(sets)[order], row[order]
    across = len(set(sides)) > 1
    for i, own in enumerate(sets):
        begin, end = np.searchsorted(values, own, side="left"), np.searchsorted(values, own, side="right")
        both = np.bincount(holders[ragged(begin, end - begin)], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (both > 0))
        for j in near[near > i].tolist():
            if not (across and sides[i] == sides[j]) and (x := find(comps[i])) != (y := find(comps[j])):
                root[x] = y
                yield ids[i], ids[j]


def joined_families(rows: DataFrame, texts: Texts, sets_of: Sets, percent: int, chunk: int = 500) -> DataFrame | None:
    """Links that join different components ``c`` within each family of (id, family, c).

    Families of over ``chunk`` members are cut into chunks that meet pair by pair of chunks, so a task holds the sets of
    at most about two chunks; each member's text travels once for each chunk of its family.
    """
    rows = materialise(rows, "families")
    if rows.isEmpty():
        return None
    content = texts(rows.select("id"))
    parts = rows.groupBy("family").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_n"))
    dealt = rows.join(parts, "family").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("family", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "_own", "id", "c").join(content, "id")
    dealt = dealt.select("family", "lo", "hi", "_own", "id", "c", "text").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, ([], [], [], [])
        out: tuple[list, list] = ([], [])

        def close() -> None:
            if len(held[0]) > 1:
                for a, b in _join_block(held[0], held[1], held[2], held[3], percent):
                    out[0].append(min(a, b))
                    out[1].append(max(a, b))
            for x in held:
                x.clear()

        for batch in batches:
            for part in slices(iter([batch])):
                columns = [part.column(k).to_pylist() for k in range(6)]
                for family, lo, hi, own, i, c, words in zip(*columns, sets_of(part.column(6)), strict=True):
                    if (family, lo, hi) != block:
                        close()
                        block = (family, lo, hi)
                    for x, y in zip(held, (i, c, own, words), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
            out = ([], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return materialise(dealt.mapInArrow(run, "a bigint, b bigint"), "links")


@dataclass
class Links:
    """The components of the links added so far, brought up to date when they are asked for.

    New links are drawn between the components known by then, so only the small graph of components is searched again.
    """

    _new: DataFrame | None = None
    _components: DataFrame | None = None

    def add(self, more: DataFrame | None) -> None:
        if more is not None and not more.isEmpty():
            self._new = more if self._new is None else self._new.unionByName(more)

    def _update(self) -> None:
        known, self._new, new = self._components, None, self._new
        if known is None:
            self._components = components(new)
            return
        for end in ("a", "b"):
            new = new.join(known.withColumnsRenamed({"id": end, "component": f"{end}_"}), end, "left").withColumn(end, F.coalesce(f"{end}_", end)).drop(f"{end}_")
        joined = components(new.filter("a != b").distinct())
        moved = known.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
        fresh = joined.join(known.select("id"), "id", "left_anti")
        self._components = materialise(moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(fresh), "components")

    def label(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component ``c`` of their ``id``."""
        if self._new is not None:
            self._update()
        if self._components is None:
            return rows.withColumn("c", F.col("id"))
        return rows.join(self._components, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def settle(
    members: DataFrame, links: Links, texts: Texts, sets_of: Sets, percent: int, crowd: int, spare: DataFrame | None = None
) -> DataFrame:
    """Adds links that join the components of the groups (key, id, first); gives (key, id, c) of unsettled groups of over ``crowd``.

    Members are compared with their group's first one. In groups of at most ``crowd`` that still hold more than one
    component, members of different components are compared. ``spare`` (id, band, spare) says how many groups of a band,
    the low six bits of a key, a row shares at least with any row it is linked with; other pairs are not compared.
    """
    band = F.col("key").bitwiseAND(63).alias("band")
    star = members.filter("id != first").groupBy(F.col("first").alias("a"), F.col("id").alias("b"), band).agg(F.count("*").alias("n"))
    if spare is not None:  # no more than a head start: pairs with few groups in common wait
        star = star.join(spare.withColumnRenamed("id", "b"), ["b", "band"], "left").filter(F.col("n") >= F.coalesce(F.col("spare") / 2, F.lit(1)))
    links.add(verified(star.select("a", "b").distinct(), texts, sets_of, percent))
    known = links.label(members)
    still = known.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("key", "n")
    rest = materialise(known.join(still, "key").select("key", "id", "c", "n"), "open")
    few = rest.filter(F.col("n") <= crowd)
    x, y = few.select("key", F.col("id").alias("a"), F.col("c").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    pairs = x.join(y, "key").filter("a < b and ca != cb").groupBy("a", "b", band).agg(F.count("*").alias("n"))
    if spare is not None:
        for end in ("a", "b"):
            pairs = pairs.join(spare.withColumnsRenamed({"id": end, "spare": f"s{end}"}), [end, "band"], "left")
        pairs = pairs.filter(F.col("n") >= F.greatest(F.coalesce("sa", F.lit(1)), F.coalesce("sb", F.lit(1))))
    links.add(verified(pairs.select("a", "b").distinct(), texts, sets_of, percent))
    return rest.filter(F.col("n") > crowd).select("key", "id", "c")
