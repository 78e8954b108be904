"""Repair of conversation structure: cheapest edits by a Viterbi search whose survivors coalesce.

A conversation's rows, ordered by turn (nulls first), then role and the text's SHA-256, are kept (0), given another role (3) or deleted
(4, and this is the only choice for blank and duplicate rows); turns without text may be inserted anywhere (3). A truncated
row that is not deleted costs 3 more. The initials of the resulting roles must spell ``(s?(ua)+)?``. Of the cheapest edits
those are taken whose initials D, I, K, R, in order, are the least string.

The search has four states (nothing yet, after s, u, a) and keeps the best path into each. Paths are leaves of a tree that
holds their common parts once: every node has a run of edits and the number of its children and survivors, a node that
loses its last one is dropped, and a node with one child is joined with it. As soon as all survivors descend from one
child of the root its edits are settled: they are emitted and forgotten. Equally cheap paths are compared over all that is
not settled, which the tree answers by the first edits after they part. So a task holds the unsettled edits alone, a byte
for each survivor and edit; a state that another beats whatever follows is dropped, else "delete everything" would keep
all edits open. Texts take no part: rows are ordered and searched as role, digest and fault, and texts are joined with the
edits afterwards, by conversation and digest. A conversation with a third of all rows is thus read in order by one task as
some tens of bytes a row (sorted on disk, streamed), while its texts are spread. Only the digest of a conversation, a stream by
definition, reads its repaired texts in order again, holding one batch.

Null roles and texts are one space: a blank row. An empty role has no initial and cannot be kept. Null turns come first,
rows equal in everything are all but the first duplicates. Conversations without an identifier are one conversation. Empty
tables give empty results; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkscore.session import materialise

KEEP, REROLE, DELETE, INSERT = b"K"[0], b"R"[0], b"D"[0], b"I"[0]
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role with this initial, by state before; rows may change to user or assistant only.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEEDED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
_SPACE = r"\x20\x09-\x0D"


class Node:
    """A run of edits with those that follow it; ``uses`` counts its children and survivors."""

    __slots__ = ("edits", "parent", "children", "uses", "depth")

    def __init__(self, parent: Node | None, edits: bytes = b""):
        self.parent, self.edits, self.children, self.uses = parent, bytearray(edits), [], 0
        self.depth = 0 if parent is None else parent.depth + 1


class Search:
    """The survivors of one conversation. ``step`` takes a row and gives the edits that are settled by it."""

    def __init__(self):
        self.root = Node(None)
        self.best: dict[int, tuple[int, Node]] = {}
        self._survive({NOTHING: (0, self.root, b"")})

    def step(self, initial: str, fault: str) -> bytes:
        options: dict[int, tuple[int, Node, bytes]] = {}
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, (cost, node) in self.best.items():
            self._offer(options, state, cost + COST[DELETE], node, bytes([DELETE]))
            if fault in (BLANK, DUPLICATE):
                continue
            kept = NEXT.get((state, initial))
            if kept is not None:
                self._offer(options, kept, cost + extra, node, bytes([KEEP]))
            self._offer(options, NEEDED[state], cost + extra + COST[REROLE], node, bytes([REROLE]))
        self._survive(options)
        return self._settled()

    def finish(self) -> tuple[int, bytes]:
        """The cost of the whole and the edits that were not settled yet."""
        ends = [(*self.best[s], b"") for s in (NOTHING, ASSISTANT) if s in self.best]
        cost, node, _ = ends[0]
        for other in ends[1:]:
            if self._better(other, (cost, node, b"")):
                cost, node, _ = other
        path = []
        while node is not None:
            path.append(bytes(node.edits))
            node = node.parent
        return cost, b"".join(reversed(path))

    def _better(self, a: tuple[int, Node, bytes], b: tuple[int, Node, bytes]) -> bool:
        """Whether ``a`` is cheaper than ``b`` or, at equal cost, the lesser string over all unsettled edits."""
        if a[0] != b[0]:
            return a[0] < b[0]
        x, y, after_x, after_y = a[1], b[1], a[2], b[2]
        while x is not y:  # climb to the node at which both part
            if x.depth >= y.depth:
                x, after_x = x.parent, bytes(x.edits[:1]) if x.edits else after_x
            else:
                y, after_y = y.parent, bytes(y.edits[:1]) if y.edits else after_y
        return after_x < after_y

    def _offer(self, options: dict, state: int, cost: int, node: Node, edits: bytes) -> None:
        new = (cost, node, edits)
        if state not in options or self._better(new, options[state]):
            options[state] = new

    def _survive(self, options: dict[int, tuple[int, Node, bytes]]) -> None:
        """Adds insertions, drops states that cannot win, and grows the tree by the edits of the others."""
        for state in (NOTHING, SYSTEM, USER, ASSISTANT, USER):  # from assistant to user once more: no longer chain can help
            if state in options:
                cost, node, edits = options[state]
                self._offer(options, NEEDED[state], cost + COST[INSERT], node, edits + bytes([INSERT]))
        done = options[ASSISTANT]  # always there: two insertions lead to it
        if SYSTEM in options and self._better(done, options[SYSTEM]):
            del options[SYSTEM]  # whatever follows s may follow a as well
        if NOTHING in options and done[0] + COST[DELETE] < options[NOTHING][0]:
            del options[NOTHING]  # as before, with the system row deleted
        old = [node for _, node in self.best.values()]
        self.best = {}
        for state, (cost, node, edits) in sorted(options.items(), key=lambda o: len(o[1][2])):
            leaf = self._grow(node, edits)
            leaf.uses += 1
            self.best[state] = (cost, leaf)
        for node in old:
            node.uses -= 1
            self._tidy(node)
        if not old:
            self.root.uses += 1  # held by the search itself

    def _grow(self, node: Node, edits: bytes) -> Node:
        """The node that stands ``edits`` after ``node``; runs that begin alike are shared."""
        while edits:
            child = next((c for c in node.children if c.edits[0] == edits[0]), None)
            if child is None:
                child = Node(node, edits)
                node.children.append(child)
                node.uses += 1
                return child
            same = len(child.edits)
            assert edits[:same] == child.edits[:same], "a survivor's edits are a run of their own"
            node, edits = child, edits[same:]
        return node

    def _tidy(self, node: Node) -> None:
        """Drops a node without use, and joins one that has a single child and no survivor with that child."""
        while node.uses == 0 and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.uses -= 1
            node = parent
        while node.parent is not None and node.uses == 1 and len(node.children) == 1:
            child, parent = node.children[0], node.parent
            joined = node.edits
            joined += child.edits
            child.edits, child.parent = joined, parent
            parent.children[parent.children.index(node)] = child
            self._lift(child)
            node = child

    def _lift(self, node: Node) -> None:
        node.depth = node.parent.depth + 1
        for child in node.children:
            self._lift(child)

    def _settled(self) -> bytes:
        """The edits that all survivors share; they leave the tree."""
        out = bytearray()
        while self.root.uses == 2 and len(self.root.children) == 1:  # the search itself and one child
            child = self.root.children[0]
            out += child.edits
            child.edits, child.parent, child.uses = bytearray(), None, child.uses + 1
            child.depth = 0
            for grandchild in child.children:
                self._lift(grandchild)
            self.root = child
        return bytes(out)


def rows_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a digest of the text."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def ordered(rows: DataFrame) -> DataFrame:
    """``rows_of`` a table without their texts: place in the conversation from 1 on, initial and fault; written once."""
    last = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*+\z", 1)
    light = rows.select("conv_id", "turn", "role", "digest", last.alias("_last"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    placed = light.withColumn("place", F.row_number().over(order).cast("bigint"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("place")) > 1
    fault = (
        F.when(F.col("_last") == "", BLANK)
        .when(seen, DUPLICATE)
        .when(~F.col("_last").isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    initial = F.substring("role", 1, 1)
    return materialise(placed.select("conv_id", "turn", "place", "role", "digest", initial.alias("initial"), fault.alias("fault")), "turns")


def edits(places: DataFrame) -> DataFrame:
    """The cheapest edits of ``ordered`` rows in order: conversation, place of the row, number of the edit, initial, new role.

    Insertions carry the place of the row before them (0 at the beginning) and follow it. Each conversation ends with a
    row that is no edit: it alone has a ``cost``, that of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]
        here, search, initials, state, place, number = None, None, [], NOTHING, 0, 0

        def emit(letters: bytes) -> None:
            nonlocal state, place, number
            used = 0
            for letter in letters:
                role = None
                if letter != INSERT:
                    place, used = place + 1, used + 1
                if letter == KEEP:
                    state = NEXT[state, initials[used - 1]]
                elif letter != DELETE:
                    state = NEEDED[state]
                    role = ROLE[state]
                number += 1
                for column, value in zip(out, (here, place, number, chr(letter), role, None), strict=True):
                    column.append(value)
            del initials[:used]

        def close() -> None:
            """The last edits, and the cost of all as a row without edit."""
            if search is not None:
                total, letters = search.finish()
                emit(letters)
                for column, value in zip(out, (here, place, number + 1, "", None, total), strict=True):
                    column.append(value)

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            for column in out:
                column.clear()
            return made

        for part in batches:
            for conv, initial, fault in zip(*(part.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if search is None or conv != here:
                    close()
                    here, search, initials, state, place, number = conv, Search(), [], NOTHING, 0, 0
                initials.append(initial)
                settled = search.step(initial, fault)
                if settled:
                    emit(settled)
            yield batch()
        close()
        yield batch()

    names = ["conv_id", "place", "number", "edit", "new_role", "cost"]
    small = places.select("conv_id", "place", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return small.mapInArrow(run, "conv_id bigint, place bigint, number bigint, edit string, new_role string, cost bigint")


def repaired(rows: DataFrame, places: DataFrame, found: DataFrame) -> DataFrame:
    """Every edit with the role and text it leaves (null if deleted), from ``rows_of`` a table, its ``ordered`` rows and ``edits``.

    A row that stays is the first of its role and text, so texts are reduced to one for each digest before they meet edits.
    """
    own = places.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "place", "role", "digest")])
    stays = F.col("edit").isin("K", "R")
    joined = found.join(own, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("place") == F.col("_place")) & stays, "left")
    texts = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_said"), F.col("digest").alias("_of")).agg(F.any_value("text").alias("_text"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_role") == F.col("_said")) & (F.col("_digest") == F.col("_of"))
    return joined.join(texts, same, "left").select(
        "conv_id",
        "number",
        "edit",
        "cost",
        F.when(F.col("edit") == "K", F.col("_role")).otherwise(F.col("new_role")).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("_text")).alias("text"),
    )


def digests(made: DataFrame) -> DataFrame:
    """Per conversation of ``repaired``: cost, initials of the edits, and the SHA-256 of ``role:text`` lines without a last LF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_, lines, digest, audit, cost = None, False, 0, None, bytearray(), 0
        done: list[tuple] = []

        def close() -> None:
            if open_:
                done.append((here, cost, audit.decode(), digest.hexdigest()))

        def result() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            done.clear()
            return made

        for batch in batches:
            for conv, edit, total, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                if not open_ or conv != here:
                    close()
                    here, open_, lines, digest, audit, cost = conv, True, 0, hashlib.sha256(), bytearray(), 0
                audit += edit.encode()
                cost = total if total is not None else cost
                if edit and edit != "D":
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
            yield result()
        close()
        yield result()

    names = ["conv_id", "cost", "audit", "repaired_sha256"]
    in_order = made.repartition("conv_id").sortWithinPartitions("conv_id", "number")
    return in_order.mapInArrow(run, "conv_id bigint, cost bigint, audit string, repaired_sha256 string")


def faults(places: DataFrame) -> DataFrame:
    """Per conversation of ``ordered`` rows: missing turn numbers, rows by fault, and neighbours that may not follow each other."""
    before = F.lag("initial").over(Window.partitionBy("conv_id").orderBy("place"))
    legal = F.concat("_before", "initial").isin("su", "ua", "au") & (F.length("_before") == 1)
    turns = places.groupBy("conv_id", "turn").agg(F.count("*").alias("_n"))  # rows of one turn meet pre-aggregated
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    gaps = turns.groupBy(F.col("conv_id").alias("_conv")).agg(span.alias("gaps"))
    counts = (
        places.select("conv_id", "place", "initial", "fault")
        .withColumn("_before", before)
        .groupBy("conv_id")
        .agg(
            *[F.count_if(F.col("fault") == name).alias(name) for name in (BLANK, DUPLICATE, TRUNCATED)],
            F.count_if(F.col("_before").isNotNull() & ~legal).alias("illegal"),
        )
    )
    return counts.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")


def repair(turns: DataFrame) -> DataFrame:
    """Per conversation: faults, cost, initials of the cheapest edits and the digest of what they leave."""
    rows = rows_of(turns)
    places = ordered(rows)
    found = digests(repaired(rows, places, edits(places))).withColumnRenamed("conv_id", "_conv")
    return faults(places).join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by crc32("conv_id:turn") mod 20; null identifiers, turns, roles and texts are one space there.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes its
    role user.
    """

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20)).cast("int")
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_fault") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    damaged = rows.filter("_fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return damaged.drop("_copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a line also for conversations of which nothing is left."""
    every = turns.select(F.col("conv_id").cast("bigint").alias("_conv")).distinct()
    found = repair(damage(turns))
    nothing = hashlib.sha256(b"").hexdigest()
    numbers = ["gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]
    return every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
