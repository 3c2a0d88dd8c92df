from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel.operators import asof, news, quality, splits, targets

D = dt.date


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(2)
    obs = []
    for s in ("A1", "B1"):
        for d in pd.date_range("2019-12-20", periods=60):
            if rng.uniform() < 0.6:
                obs.append((s, d.date(), float(rng.normal(100, 3)), 1.0))
    registry = spark.createDataFrame([("A1", "A", "INDEX"), ("B1", "B", "YIELD")],
                                     "source_id string, availability string, asset_class string")
    source = spark.createDataFrame(obs, "source_id string, source_date date, close double, volume double")
    origins = spark.createDataFrame([(d.date(),) for d in pd.date_range("2019-12-15", periods=70)], "origin_date date")
    return obs, source, registry, origins


@pytest.mark.parametrize("strict", [None, True])
def test_asof_equals_merge_asof(world, strict):
    obs, source, registry, origins = world
    feats = asof.source_features(source, registry)
    got = asof.align_asof(origins, feats, registry, strict).orderBy("source_id", "origin_date").toPandas()
    o = pd.DataFrame({"t": pd.date_range("2019-12-15", periods=70)})
    for s, same in (("A1", strict is None), ("B1", False)):
        days = pd.DataFrame({"d": sorted(pd.Timestamp(x[1]) for x in obs if x[0] == s)})
        want = pd.merge_asof(o, days, left_on="t", right_on="d", allow_exact_matches=same)
        mine = got[got["source_id"] == s].reset_index(drop=True)
        assert [None if pd.isna(x) else x.date() for x in want["d"]] == [
            None if pd.isna(x) else pd.Timestamp(x).date() for x in mine["observation_date"]]
        for t, d, lag in zip(want["t"], want["d"], mine["lag_sessions"]):
            if pd.notna(d):
                assert lag == ((days["d"] > d) & (days["d"] <= t)).sum()


def test_rule_cannot_be_relaxed(world):
    _, source, registry, origins = world
    with pytest.raises(asof.AvailabilityError):
        asof.align_asof(origins, asof.source_features(source, registry), registry, strict=False)


def test_strict_sources_report_no_violation(world):
    _, source, registry, origins = world
    aligned = asof.align_asof(origins, asof.source_features(source, registry), registry)
    report = {r["source_id"]: r for r in asof.alignment_report(aligned).collect()}
    assert report["B1"]["n_same_date"] == 0 and report["A1"]["n_same_date"] > 0
    assert all(r["violations"] == 0 for r in report.values())


def test_news_window_excludes_the_origin_day(spark):
    items = spark.createDataFrame([("X", D(2020, 1, d)) for d in (1, 1, 4, 7, 8)], "ticker string, publish_date date")
    origins = spark.createDataFrame([("X", D(2020, 1, 8)), ("Y", D(2020, 1, 8))], "ticker string, origin_date date")
    got = {r["ticker"]: r for r in news.window_counts(origins, items).collect()}
    assert [got["X"][f"news_{w}d"] for w in (1, 3, 7)] == [1, 1, 4]
    assert got["X"]["news_present"] and got["Y"]["news_30d"] == 0
    with pytest.raises(news.NewsDateError):
        news.assert_dated(items.unionByName(spark.createDataFrame([("X", None)], items.schema)))


def test_alias_windows_split_at_a_rename(spark):
    rows = [("T", "Old Name", "HISTORICAL_SAFE", None, D(2015, 6, 30)), ("T", "New Name", "EXACT_SAFE", D(2015, 7, 1), None),
            ("T", "Other", "REJECTED", None, None)]
    al = spark.createDataFrame(rows, "ticker string, alias string, class string, valid_from date, valid_to date")
    got = [(r["start"], r["end"], r["alias"]) for r in news.alias_windows(al, "2015-01-01", "2015-12-31").orderBy("start").collect()]
    assert got == [(D(2015, 1, 1), D(2015, 6, 30), "Old Name"), (D(2015, 7, 1), D(2015, 12, 31), "New Name")]


def test_leading_dates_and_common_forms(spark):
    df = spark.createDataFrame([("2003-07-29; 2025-10-01",), ("2001",), ("2001-05",), ("20010502",), ("soon",)], "t string")
    assert [r[0] for r in df.select(news.leading_date(F.col("t"))).collect()] == [
        D(2003, 7, 29), D(2001, 1, 1), D(2001, 5, 1), D(2001, 5, 2), None]
    names = spark.createDataFrame([("Tata Motors Limited",), ("ITC Ltd.",), ("Plain",)], "n string")
    assert [r[0] for r in names.select(news.common_form(F.col("n"))).collect()] == ["Tata Motors", None, None]


def test_headline_matching_reads_whole_texts(spark):
    long_body = "word " * 5000 + "Acme Steel ends it"
    art = spark.createDataFrame([(1, "Acme Steel rises", "x"), (2, "Other", long_body), (3, "Acme Steelworks", "none")],
                                "article_id long, title string, body string")
    al = spark.createDataFrame([("T", "Acme Steel", "EXACT_SAFE"), ("U", "Acme", "AMBIGUOUS")], "ticker string, alias string, class string")
    got = {(r["article_id"], r["ticker"]): r["relevance"] for r in news.headline_relevance(art, al).collect()}
    assert got == {(1, "T"): "TITLE_EXPLICIT", (2, "T"): "BODY_MATCH_ONLY"}


def test_horizons_follow_trading_rows_over_a_holiday(spark):
    days = [d.date() for d in pd.bdate_range("2018-02-26", periods=20) if not D(2018, 3, 5) <= d.date() <= D(2018, 3, 9)]
    bars = spark.createDataFrame([("T", d, float(i)) for i, d in enumerate(days, 1)], "ticker string, date date, close double")
    got = {(r["origin_date"], r["horizon"]): r["target_end_date"] for r in targets.horizon_targets(bars, (1, 3)).collect()}
    assert got[(D(2018, 3, 2), 1)] == D(2018, 3, 12) and got[(D(2018, 3, 1), 3)] == D(2018, 3, 13)
    capped = targets.horizon_targets(bars, (1, 3), boundary="2018-03-13")
    assert capped.agg(F.max("target_end_date")).first()[0] <= D(2018, 3, 13)


def test_union_and_own_calendars_differ(spark):
    rows = [("A", D(2020, 1, d), 1.0 + d) for d in (1, 2, 3)] + [("B", D(2020, 1, d), 5.0) for d in (1, 3)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    union = {(r["ticker"], r["origin_date"].day): r["target_date"].day for r in targets.next_day_targets(bars).collect()}
    own = {(r["ticker"], r["origin_date"].day): r["target_date"].day for r in targets.next_day_targets(bars, calendar="own").collect()}
    assert union == {("A", 1): 2, ("A", 2): 3} and own == {("A", 1): 2, ("A", 2): 3, ("B", 1): 3}


def test_sample_crossing_a_fold_edge_belongs_to_no_split(spark):
    rows = spark.createDataFrame([("A", D(2018, 12, 31), D(2019, 1, 1)), ("A", D(2018, 6, 1), D(2018, 6, 2))],
                                 "ticker string, origin_date date, target_date date")
    placed = splits.assign_folds(rows, splits.SEARCH_FOLDS[:1]).collect()
    assert [(r["origin_date"], r["split"]) for r in placed] == [(D(2018, 6, 1), "train")]


def test_firewall_raises(spark):
    df = spark.createDataFrame([(D(2020, 1, 1),)], "d date")
    with pytest.raises(quality.BoundaryError):
        quality.assert_boundary(df, ["d"], "2019-12-31")
    with pytest.raises(quality.BoundaryError):
        quality.assert_boundary(df, ["d"], sealed=("2020-01-01", "2020-12-31"))
    assert quality.assert_boundary(df, ["d"], "2020-12-31") is df


def test_tolerance_clears_rounding(spark):
    rows = [("A", D(2020, 1, 1), 10.0, 10.0 - 1e-12, 9.0, 10.0, 1.0), ("A", D(2020, 1, 2), 10.0, 9.0, 9.5, 10.0, 1.0)]
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    r = quality.ohlc_violations(bars).first()
    assert r["high_below_close_hard"] == 1 and r["high_below_close_cleared"] == 1 and r["high_below_low_hard"] == 1


def test_missing_year_counts_zero(spark):
    obs = spark.createDataFrame([("S", d.date()) for d in pd.bdate_range("2014-01-01", "2014-12-31")], "source_id string, source_date date")
    r = quality.source_coverage_gate(obs, 2014, 2015).first()
    assert not r["passed"] and r["n_2015"] == 0 and "2015 has only 0" in r["reason"]
