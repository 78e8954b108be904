"""Group-disjoint, size-balanced fold assignment.

The rule: groups in order of falling size (ties by the MD5 of the key, then the
key) each go to the fold with the fewest rows so far (ties to the lower fold).

Taken literally that is one sequential pass over all groups. It only depends on
the *sizes*, though: N rows hold at most sqrt(2 N) different group sizes, and
within one size the choice of folds is periodic as soon as the loads lie within
one group size of each other. So the sequential part runs on the histogram of
sizes (size, number of groups), which is tiny for any table, and yields a few
cyclic stretches per size. The groups themselves are ranked and assigned in
parallel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .joins import lookup_join

# Prefix of the key's MD5: splits the ranking inside one group size into 4096 windows.
_BUCKET_CHARS = 3


def stretches(histogram: Iterable[tuple[int, int]], n_splits: int) -> Iterator[tuple[int, int, list[int]]]:
    """(size, first index, cycle of folds) for a histogram in order of falling size.

    Group number i >= first index of that size goes to cycle[(i - first) % len(cycle)],
    up to the next stretch of the same size.
    """
    loads = [0] * n_splits
    for size, groups in histogram:
        done = 0
        while done < groups:
            order = sorted(range(n_splits), key=lambda f: (loads[f], f))
            # Folds that are served before the lightest one is lightest again.
            cycle = [f for f in order if loads[f] - loads[order[0]] < size]
            rounds = -(-(groups - done) // len(cycle))
            if len(cycle) < n_splits:
                # Whole rounds during which no other fold becomes the lightest.
                ceiling = loads[order[len(cycle)]]
                rounds = min(rounds, (ceiling - loads[cycle[-1]] - 1) // size + 1)
            take = min(groups - done, rounds * len(cycle))
            yield size, done, cycle
            for position, fold in enumerate(cycle):
                loads[fold] += size * ((take - position + len(cycle) - 1) // len(cycle))
            done += take


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n_rows"))


def assign_groups(df: DataFrame, group: str, n_splits: int = 4) -> DataFrame:
    """(grp, fold) for every group of ``df``."""
    sizes = materialise(group_sizes(df, group), "group-sizes")
    # At most sqrt(2 x rows) lines, see the module text.
    histogram = sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("n_rows"))
    plan: dict[int, list] = {}
    for size, first, cycle in stretches(
        ((r["n_rows"], r["groups"]) for r in histogram.toLocalIterator()), n_splits
    ):
        plan.setdefault(size, []).append((first, cycle))
    phases = df.sparkSession.createDataFrame(
        list(plan.items()), "n_rows bigint, phases array<struct<first: bigint, cycle: array<int>>>"
    )

    digest = F.coalesce(F.md5(F.col("grp").cast("string")), F.lit(""))  # rows without a group are a group of their own
    hashed = sizes.select("grp", "n_rows", digest.alias("digest"), F.substr(digest, F.lit(1), F.lit(_BUCKET_CHARS)).alias("bucket"))
    local = W.partitionBy("n_rows", "bucket").orderBy("digest", "grp")
    before = W.partitionBy("n_rows").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("n_rows", "bucket")
        .agg(F.count(F.lit(1)).alias("in_bucket"))
        .select("n_rows", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    )
    ranked = hashed.withColumn("local", F.row_number().over(local) - 1).join(offsets, ["n_rows", "bucket"])
    indexed = ranked.select("grp", "n_rows", (F.col("offset") + F.col("local")).alias("index"))
    current = F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("index")), -1)
    placed = lookup_join(indexed, phases, "n_rows", "inner", spread_by="grp").withColumn("phase", current)
    step = (F.col("index") - F.col("phase.first")) % F.size("phase.cycle")
    return placed.select("grp", F.get("phase.cycle", step.cast("int")).alias("fold"))


def group_kfold(df: DataFrame, group: str, n_splits: int = 4, spread_by: str | None = None) -> DataFrame:
    """``df`` with its ``fold``; all rows of one group share it, and so do those whose group is NULL."""
    folds = materialise(assign_groups(df, group, n_splits), "folds")

    def key(column: str):  # equal for equal groups, the missing one included
        return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))

    folds = folds.select(key("grp").alias("_group"), "fold")
    spread_by = [c for c in df.columns if c != group] if spread_by is None else spread_by
    return lookup_join(df.withColumn("_group", key(group)), folds, "_group", "left", spread_by=spread_by).drop("_group")


def train_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") != fold)


def valid_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)
