"""Registered queries against their reference SQL on the smallest tables.

A spread of queries runs by default; ``ALL_QUERIES=1`` runs every one.
"""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

from .conftest import SMALL

SOME = ("bars_first_per_day indicators_averaged panel_features sector_leave_one_out cross_section_ranks frame_issues "
        "source_coverage_gate dataset_profile targets_union_calendar sample_table scaler_window_weighted_robust vocabulary "
        "aligned_features news_windows alias_query_plan headline_relevance daily_rank_ic coverage_curve selections_at_3 "
        "block_bootstrap_auc calibration_isotonic experiment_ledger").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert compare(mine, [tuple(r[i] for i in at) for r in cur.fetchall()]) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
