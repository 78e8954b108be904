"""Joins against a side with unique keys, safe for hot keys on the other side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import measured_bytes

BROADCAST_BYTES = 256 * 1024 * 1024
SALTS = 32


def lookup_join(
    fact: DataFrame,
    dimension: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread_by: str | Sequence[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join many fact rows to at most one row of a dimension.

    The dimension is measured first. Up to ``broadcast_bytes`` it is broadcast and
    the fact side is not shuffled. Beyond that both sides are shuffled on (key,
    salt): the salt of a fact row is a hash of ``spread_by``, and the dimension is
    replicated once per salt, so that a key holding a third of all fact rows is
    spread over ``salts`` tasks.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if measured_bytes(dimension) <= broadcast_bytes:
        return fact.join(F.broadcast(dimension), keys, how)
    return salted_join(fact, dimension, keys, how, spread_by, salts)


def salted_join(
    fact: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: str | Sequence[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a replicated side cannot be preserved by a {how} join")
    keys = list(on)
    spread = [c for c in fact.columns if c not in keys] if spread_by is None else spread_by
    spread = [spread] if isinstance(spread, str) else list(spread)
    if not spread:
        # Fact keys are unique as well: there is nothing to spread.
        return fact.join(dimension, keys, how)
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        fact.withColumn("_salt", salt)
        .join(dimension.withColumn("_salt", copies), keys + ["_salt"], how)
        .drop("_salt")
    )


def join_prompt(summaries: DataFrame, prompts: DataFrame, **options) -> DataFrame:
    """Answers with their passage; an answer without one is kept with NULLs."""
    options.setdefault("spread_by", "student_id")
    return lookup_join(summaries, prompts, "prompt_id", "left", **options)


def expand_struct(df: DataFrame, struct_column: str, suffix: str = "") -> DataFrame:
    """Replace a struct column by its fields, optionally with a name suffix."""
    fields = df.schema[struct_column].dataType.fieldNames()
    kept = [F.col(f"`{c}`") for c in df.columns if c != struct_column]
    return df.select(*kept, *[F.col(f"{struct_column}.{f}").alias(f"{f}{suffix}") for f in fields])
