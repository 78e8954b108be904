"""Fold assignment against the literal one-group-at-a-time rule."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkscore.operators import folds


def one_by_one(sizes, n_splits):
    loads, picks = [0] * n_splits, []
    for size in sizes:
        fold = min(range(n_splits), key=lambda f: (loads[f], f))
        loads[fold] += size
        picks.append(fold)
    return picks


def expand(histogram, n_splits):
    plan = {}
    for size, first, cycle in folds.stretches(histogram, n_splits):
        plan.setdefault(size, []).append((first, cycle))
    picks = []
    for size, groups in histogram:
        for i in range(groups):
            first, cycle = [p for p in plan[size] if p[0] <= i][-1]
            picks.append(cycle[(i - first) % len(cycle)])
    return picks, sum(map(len, plan.values()))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=8), st.integers(1, 6))
def test_stretches_equal_the_sequential_rule(sizes, n_splits):
    histogram = sorted(sizes.items(), reverse=True)
    picks, used = expand(histogram, n_splits)
    assert picks == one_by_one([s for s, m in histogram for _ in range(m)], n_splits)
    assert used <= (n_splits + 1) * len(histogram)


def test_a_million_equal_groups_need_few_stretches():
    histogram = [(1_000_000_000, 1), (7, 1_000_000), (1, 500_000_000)]
    plan = list(folds.stretches(histogram, 4))
    assert len(plan) <= 12


def test_loads_of_small_example(spark):
    rows = [(g,) for g, n in zip("abcdef", (5, 4, 3, 3, 2, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string")
    kept = folds.group_kfold(df, "g", 3).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in kept) == [6, 6, 6]


@pytest.mark.parametrize("n_splits", [2, 4])
def test_spark_assignment_matches_sequential_rule(spark, n_splits):
    rng = random.Random(7)
    counts = {f"g{i}": rng.choice([1, 1, 1, 2, 3, 50, 400]) for i in range(120)}
    counts["hot"] = 3000
    df = spark.createDataFrame([(g,) for g, n in counts.items() for _ in range(n)], "g string")
    order = sorted(counts, key=lambda g: (-counts[g], hashlib.md5(g.encode()).hexdigest(), g))
    expected = dict(zip(order, one_by_one([counts[g] for g in order], n_splits)))
    got = {r["grp"]: r["fold"] for r in folds.assign_groups(df, "g", n_splits).collect()}
    assert got == expected
    assert folds.group_kfold(df, "g", n_splits).count() == df.count()


def test_rows_without_a_group_are_one_group(spark):
    df = spark.createDataFrame([("a",)] * 3 + [(None,)] * 5 + [("",)] * 2, "g string")
    rows = folds.group_kfold(df, "g", 3).groupBy("g", "fold").count().collect()
    assert sorted((r["g"] is None, r["g"] or "", r["fold"], r["count"]) for r in rows) == [(False, "", 2, 2), (False, "a", 1, 3), (True, "", 0, 5)]
