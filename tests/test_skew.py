"""The sliced forms give the same result as one window, with a third of all rows in one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel.operators import bootstrap, metrics
from quillpanel.plans import skew


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(7)
    n = 900
    day = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 30, n))
    value = np.round(rng.normal(0, 1, n), 1)  # many ties
    pdf = pd.DataFrame({"d": day, "id": np.arange(n), "v": value, "w": rng.integers(0, 4, n)})
    pdf.loc[rng.choice(n, 60, replace=False), "v"] = np.nan
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache(), pdf


def rows(df, *order):
    return df.orderBy(*order).toPandas().reset_index(drop=True)


def test_check_sees_the_hot_group(hot):
    assert skew.groups_fit(hot[0], ["d"], 400) and not skew.groups_fit(hot[0], ["d"], 200)


def test_ranks(hot, tiny_groups):
    df, pdf = hot
    assert not skew.groups_fit(df, ["d"])
    want = pdf.groupby("d")["v"].rank(pct=True)
    for fits in (True, False, None):
        got = rows(skew.average_ranks(df, ["d"], {"v": "r"}, fits=fits), "id")
        np.testing.assert_allclose(got["r"].astype(float), want, rtol=1e-12)


def test_running_and_positions(hot, tiny_groups):
    df, pdf = hot
    order = [F.col("v").asc_nulls_last(), F.col("id").asc()]
    a = rows(skew.running(df, ["d"], order, {"s": F.col("w")}, fits=True), "id")
    b = rows(skew.running(df, ["d"], order, {"s": F.col("w")}, fits=False), "id")
    assert (a["s"] == b["s"]).all()
    p = rows(skew.positions(df, [], order), "v", "id")
    assert sorted(p["pos"]) == list(range(len(pdf)))


def test_quantiles(hot, tiny_groups):
    df, pdf = hot
    probs = {"q1": 0.25, "m": 0.5, "q9": 0.9}
    for fits in (True, False):
        got = rows(skew.quantiles(df, ["d"], "v", probs, fits=fits), "d")
        for name, p in probs.items():
            np.testing.assert_allclose(got[name], pdf.groupby("d")["v"].quantile(p).to_numpy(), rtol=1e-12)
        whole = skew.quantiles(df, [], "v", probs, F.col("w"), fits=fits).first()
        repeated = pdf.loc[pdf.index.repeat(pdf["w"])]["v"]
        assert np.isclose(whole["q9"], repeated.quantile(0.9))


def test_previous_value(hot, tiny_groups):
    df, _ = hot
    keys = df.select("d", "id")
    a = rows(skew.previous_value(keys, ["d"], "id", "p", fits=True), "id")
    b = rows(skew.previous_value(keys, ["d"], "id", "p", fits=False), "id")
    pd.testing.assert_frame_equal(a, b[a.columns])


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(3)
    n = 1200
    p = np.round(rng.uniform(0, 1, n), 2)
    days = pd.bdate_range("2020-01-01", periods=40)
    pdf = pd.DataFrame({"fold": np.where(np.arange(n) < 400, 1, 2), "ticker": [f"T{i % 30}" for i in range(n)],
                        "origin_date": [days[(i // 30) % 40].date() for i in range(n)], "p_up": p,
                        "y_true": (rng.uniform(0, 1, n) < 0.3 + 0.4 * p).astype(int)})
    pdf["target_date"] = pdf["origin_date"]
    return spark.createDataFrame(pdf).cache(), pdf


def auc(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y == 0
    diff = p[pos][:, None] - p[neg][None, :]
    return ((np.sign(diff) + 1) / 2 * w[pos][:, None] * w[neg][None, :]).sum() / (w[pos].sum() * w[neg].sum())


def test_area_under_curve(predictions, tiny_groups):
    df, pdf = predictions
    got = {r["fold"]: r["roc_auc"] for r in metrics.roc_auc(df, ["fold"]).collect()}
    for f, g in pdf.groupby("fold"):
        assert np.isclose(got[f], auc(g["y_true"].to_numpy(), g["p_up"].to_numpy()), rtol=1e-12)


def test_coverage_curve(spark, predictions, tiny_groups):
    df, _ = predictions
    sliced = rows(metrics.coverage_curve(df, ["fold"]), "fold", "coverage_target")
    spark.conf.unset(skew.GROUP_ROWS_KEY)
    whole = rows(metrics.coverage_curve(df, ["fold"]), "fold", "coverage_target")
    pd.testing.assert_frame_equal(sliced, whole)


def test_bootstrap_area_by_slices(predictions):
    df, pdf = predictions
    a = rows(bootstrap.replicate_areas(df, ["fold"], replicates=25, slice_rows=100000), "fold", "replicate")
    b = rows(bootstrap.replicate_areas(df, ["fold"], replicates=25, slice_rows=60), "fold", "replicate")
    np.testing.assert_allclose(a["roc_auc"], b["roc_auc"], rtol=1e-12)
    g = pdf[pdf["fold"] == 2]
    dates = sorted(g["origin_date"].unique())
    w = bootstrap._weights("2|", len(dates), bootstrap.BLOCK, 25, bootstrap.SEED)
    at = g["origin_date"].map({d: i for i, d in enumerate(dates)}).to_numpy()
    for r in (0, 7):
        want = auc(g["y_true"].to_numpy(), g["p_up"].to_numpy(), w[r][at])
        got = b[(b["fold"] == 2) & (b["replicate"] == r)]["roc_auc"].iloc[0]
        assert np.isclose(got, want, rtol=1e-12)


def test_helper_draws_equal_the_draw_table(predictions):
    df, pdf = predictions
    days = bootstrap._dates(df, ["fold"], "origin_date")
    drawn = bootstrap.draws(days, ["fold"], replicates=5).groupBy("fold", "replicate", "_d").count().collect()
    n = pdf[pdf["fold"] == 2]["origin_date"].nunique()
    w = bootstrap._weights("2|", n, bootstrap.BLOCK, 5, bootstrap.SEED)
    got = np.zeros_like(w)
    for r in drawn:
        if r["fold"] == 2:
            got[r["replicate"], r["_d"]] = r["count"]
    assert (got == w).all()


def test_quantiles_of_awkward_values(spark):
    """Signs, zeros, extremes, one value for most rows, neighbours that differ in the last bit, NULL groups and values."""
    rng = np.random.default_rng(7)
    groups = {"mixed": np.concatenate([rng.normal(size=301), [0.0, -0.0, 1e308, -1e308, 5e-324, -5e-324]]),
              "hot": np.concatenate([np.full(5000, 1.25), rng.normal(size=37)]), "close": 1.0 + np.arange(64) * 2.0 ** -52,
              "one": np.array([-3.5]), "two": np.array([2.0, -2.0]), "whole": np.arange(10.0), None: rng.integers(0, 5, 50) / 7}
    data = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("one", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in skew.quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        for name, p in probs.items():
            at = p * (len(x) - 1)
            lo, hi = (sorted(x)[int(f(at))] for f in (np.floor, np.ceil))
            np.testing.assert_allclose(got[g][name], lo + (hi - lo) * (at - np.floor(at)), rtol=1e-15)
    assert skew.quantiles(df.limit(0), ["g"], "v", probs).count() == 0
    weighted = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 0), ("a", 9.0, 1), ("a", 5.0, None)], "g string, v double, w int")
    assert skew.quantiles(weighted, ["g"], "v", {"m": 0.5, "top": 1.0}, F.col("w")).first()[1:] == (1.0, 9.0)
