"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

A conversation is cut into windows of at most ``budget`` tokens, template included. Prefix sums of the turns' tokens
choose the span of each window: the most turns that fit after its context. The context is the system turn (the first
turn, if its role is ``system``) and the last turns before the span, as many as fit into ``history`` tokens. Context is
repeated text: only assistant texts of the span itself are under the loss mask, so each is a target exactly once. A turn
that alone exceeds the budget is a window of its own, without history.

Turns are ordered by ``turn`` (nulls first), then role and text. Windows do not cross multiples of ``block`` turn
numbers, so the blocks of a very long conversation are formatted by different tasks; the context of a block comes from
the blocks before it. Null roles and texts are empty. Repeated rows are turns of their own.

Template: ``<|im_start|>role LF text <|im_end|> LF``. In roles and texts ``<`` followed by n backslashes and ``|`` gets one
more backslash, so no control string can occur in them; line feeds in roles are written ``<\\n|`` first. Both are undone
by ``unescape``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkscore.llm import bpe
from inkscore.llm.arrays import flat, slices

START, END = "<|im_start|>", "<|im_end|>"
FRAME = 16  # tokens that a turn's template counts at most, role aside, also where control strings are no single tokens
WINDOWS = "conv_id bigint, block bigint, window bigint, context int, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text begins and ends."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and begin and end of the text, of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return out


def _tokens(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``tokens`` to (conv_id, block, turn, role, text): those of the escaped text and role, and the frame's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            roles, texts = (batch.column(k).to_pylist() for k in (3, 4))
            data, offsets = flat(pa.array([escape_role(r) + "\n" + escape(t) for r, t in zip(roles, texts, strict=True)], pa.string()))
            _, first = bpe.encode(data, offsets, name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first) + FRAME)], [*batch.schema.names, "tokens"])

    return rows.mapInArrow(run, "conv_id bigint, block bigint, turn bigint, role string, text string, tokens bigint")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, block: int = 1024, name: str = bpe.VOCABULARY) -> DataFrame:
    """The windows of all conversations: text, number of leading context turns, and spans under the loss mask."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 40))).cast("bigint").alias("block"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    own = _tokens(rows, name)
    blocks = rows.select("conv_id", "block").distinct().withColumn("before", F.lag("block").over(Window.partitionBy("conv_id").orderBy("block")))
    later = blocks.filter("before is not null")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    # context of later blocks: the system turn of the conversation, and the last turns of the block before
    begin = blocks.groupBy("conv_id").agg(F.min("block").alias("first"), F.max("block").alias("end")).filter("first < end")
    opening = own.join(begin, ["conv_id"]).filter("block = first")
    opening = opening.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).filter("_k = 1 and role = 'system'")
    system = later.select("conv_id", "block").join(opening.select("conv_id", "turn", "role", "text", "tokens"), "conv_id").withColumn("kind", F.lit(0))
    ends = own.join(begin.select("conv_id"), "conv_id", "left_semi")
    backwards = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc())
    ends = ends.withColumn("_k", F.row_number().over(backwards)).filter(F.col("_k") <= max(1, history // FRAME))
    ends = ends.withColumnRenamed("block", "before").join(later, ["conv_id", "before"]).withColumn("kind", F.lit(1))
    names = ["conv_id", "block", "kind", "turn", "role", "text", "tokens"]
    every = own.withColumn("kind", F.lit(2)).select(names).unionByName(system.select(names)).unionByName(ends.select(names))
    every = every.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        here, system_turn, past, span, number = None, None, [], [], 0

        def close() -> None:
            """Writes the window of the turns in ``span`` and moves them to the past."""
            nonlocal span, past, number
            if not span:
                return
            base = sum(t[2] for t in span)
            context, left = [], budget - base
            if system_turn is not None and system_turn is not span[0] and system_turn[2] <= left:
                context, left = [system_turn], left - system_turn[2]
            left, back = min(left, history), []
            for turn in reversed(past):
                if turn is system_turn or turn[2] > left:
                    break
                back.append(turn)
                left -= turn[2]
            context += back[::-1]
            text, loss, at = [], [], 0
            for k, (role, content, _) in enumerate(context + span):
                piece, a, b = format_turn(role, content)
                if k >= len(context) and role == "assistant":
                    loss.append({"start": at + a, "end": at + b})
                text.append(piece)
                at += len(piece)
            out.append((here[0], here[1], number, len(context), "".join(text), loss))
            number += 1
            past = (past + span)[-max(1, history // FRAME) :]
            span = []

        def room() -> int:
            """Tokens of the context that the next span gets if its first turn leaves them free."""
            used = system_turn[2] if system_turn is not None else 0
            back = 0
            for turn in reversed(past):
                if turn is system_turn or back + turn[2] > history:
                    break
                back += turn[2]
            return budget - used - back

        for batch in batches:
            for c, b, kind, _, role, text, tokens in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (c, b) != here:
                    close()
                    here, system_turn, past, span, number, total = (c, b), None, [], [], 0, 0
                turn = (role, text, tokens)
                if kind == 0:
                    system_turn = turn
                elif kind == 1:
                    past.append(turn)
                else:
                    if span and total + tokens > limit:
                        close()
                    if not span:
                        limit, total = room(), 0
                    if number == 0 and not span and system_turn is None and not past and role == "system":
                        system_turn = turn
                    span.append(turn)
                    total += tokens
            yield batch_of(out)
            out.clear()
        close()
        yield batch_of(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "block", "window", "context", "text", "loss"])

    return every.mapInArrow(run, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns, their digest, the text under the mask and all characters.

    SHA-256 is a stream over a conversation in order, so its windows pass through one task, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_ = None, False
        turns = loss = None
        counts = [0, 0, 0]
        done: list[tuple] = []

        def close() -> None:
            if open_:
                done.append((here, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        for batch in batches:
            for c, context, text, spans in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                if not open_ or c != here:
                    close()
                    here, open_, turns, loss, counts = c, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, content, _, _ in parse(text)[context:]:
                    turns.update(f"{role}\n{content}\n".encode())
                    counts[0] += 1
                for span in spans:
                    target = unescape(text[span["start"] : span["end"]])
                    loss.update(target.encode())
                    counts[1] += len(target)
                counts[2] += len(text)
            yield result(done)
            done.clear()
        close()
        yield result(done)

    def result(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(run, schema)
