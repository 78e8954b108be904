"""Catalogue queries against their SQL counterparts in DuckDB, on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations orders".split()
QUICK = (
    "scan_summaries pred_table_sink fold_split oov_words correction_candidates model_leaderboard weighted_blend"
    " group_kfold quotes_overlap entity_overlap clean_text valence_scores spelling_errors autocorrect"
    " features_enriched weight_search run_report"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), 0 if v is None else v) for v in row])


def test_every_counterpart_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert in_order(map(tuple, got.select(*columns).collect())) == in_order(want.fetchall())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.count() == 200 and result.columns[0] == "student_id"
