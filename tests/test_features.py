from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillpanel.functions.ema import Ema, add_emas, number_rows, span, wilder
from quillpanel.operators.base_features import INDICATORS, base_features, family_indicators
from quillpanel.operators.cross_section import (MARKET_LOO_FEATURES, add_market_loo, add_sector_context,
                                                assemble_context)
from quillpanel.operators.panel_features import STOCK_FEATURES, panel_features

from .conftest import walk


def frame(df, *order):
    return df.orderBy(*order).toPandas().reset_index(drop=True)


def test_block_average_equals_recursion(spark):
    n = 1800
    x = np.random.default_rng(1).normal(100, 5, n)
    pdf = pd.DataFrame({"ticker": "A", "date": pd.date_range("2000-01-01", periods=n).date, "x": x})
    alphas = {"w": wilder(14), "e12": span(12), "e9": span(9)}
    got = frame(add_emas(number_rows(spark.createDataFrame(pdf)), [Ema(k, "x", a) for k, a in alphas.items()]), "date")
    for k, a in alphas.items():
        want = pd.Series(x).ewm(alpha=a, adjust=False).mean()
        assert np.abs(got[k] / want - 1).max() < 1e-13


def pandas_panel(g: pd.DataFrame) -> pd.DataFrame:
    c, h, low, o, v = (g[k].astype(float) for k in ("close", "high", "low", "open", "volume"))
    lc = np.log(c)
    out = pd.DataFrame({"date": g["date"]})
    for k in (1, 5, 20):
        out[f"log_return_{k}"] = lc - lc.shift(k)
    out["overnight_gap"] = np.log(o) - lc.shift(1)
    out["realized_vol_20"] = lc.diff().rolling(20).std()
    tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
    out["atr_14_pct"] = tr.rolling(14).mean() / c
    gain = c.diff().clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-c.diff()).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    rsi = (100 - 100 / (1 + gain / loss.replace(0, np.nan))).where(loss > 0, 100.0)
    rsi = rsi.where(~((gain == 0) & (loss == 0)), 50.0)
    out["rsi_14_centered"] = (rsi - 50) / 50
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    out["macd_hist_pct"] = (macd - macd.ewm(span=9, adjust=False).mean()) / c
    s20, m20 = c.rolling(20).std(), c.rolling(20).mean()
    out["bollinger_percent_b"] = (c - (m20 - 2 * s20)) / (4 * s20).replace(0, np.nan)
    out["volume_z_20"] = (v - v.rolling(20).mean()) / v.rolling(20).std().replace(0, np.nan)
    out["drawdown_60"] = c / c.rolling(60).max() - 1
    step = (np.sign(c.diff()).fillna(0) * v).cumsum().diff()
    out["obv_change_normalized"] = step / step.abs().rolling(20).mean()
    return out


def test_panel_features_equal_pandas(panel, panel_pdf):
    got = frame(panel_features(panel), "ticker", "date")
    for t, g in panel_pdf.groupby("ticker"):
        want = pandas_panel(g.reset_index(drop=True))
        mine = got[got["ticker"] == t].reset_index(drop=True)
        for c in want.columns[1:]:
            np.testing.assert_allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_features_ignore_the_future(spark, panel_pdf):
    """Cutting or changing later rows leaves every earlier feature as it was."""
    cut = sorted(panel_pdf["date"].unique())[100]
    changed = panel_pdf.copy()
    later = changed["date"] > cut
    for c in ("open", "high", "low", "close"):
        changed.loc[later, c] *= 3.0
    for build, cols in ((panel_features, STOCK_FEATURES), (lambda b: base_features(b, list(INDICATORS)), INDICATORS)):
        full = frame(build(spark.createDataFrame(panel_pdf)).where(F.col("date") <= F.lit(cut)), "ticker", "date")
        short = frame(build(spark.createDataFrame(panel_pdf[~later])), "ticker", "date")
        other = frame(build(spark.createDataFrame(changed)).where(F.col("date") <= F.lit(cut)), "ticker", "date")
        for c in cols:
            pd.testing.assert_series_equal(full[c], short[c], check_exact=True)
            pd.testing.assert_series_equal(full[c], other[c], check_exact=True)


def test_constant_and_rising_closes(spark):
    days = pd.date_range("2020-01-01", periods=40).date
    flat = pd.DataFrame({"ticker": "F", "date": days, "open": 5.0, "high": 5.0, "low": 5.0, "close": 5.0, "volume": 1.0})
    up = flat.assign(ticker="U", close=np.arange(40) + 5.0, high=np.arange(40) + 5.0)
    bars = spark.createDataFrame(pd.concat([flat, up]))
    base = frame(base_features(bars, ["rsi_14", "bb_percent_b", "bb_width"]), "ticker", "date")
    panel = frame(panel_features(bars), "ticker", "date")
    assert (base["rsi_14"] == 50).all()  # warm-up and lossless runs alike
    assert (base[base["ticker"] == "F"]["bb_percent_b"] == 0.5).all()
    f, u = panel[panel["ticker"] == "F"], panel[panel["ticker"] == "U"]
    assert f["rsi_14_centered"].iloc[0] == 1.0 and (f["rsi_14_centered"].iloc[1:] == 0).all()
    assert (u["rsi_14_centered"] == 1.0).all()
    assert f["bollinger_percent_b"].isna().all() and (f["close_location"] == 0.5).all()


def test_missing_volume_and_high(spark):
    pdf = walk("M", 60, 3)
    pdf.loc[30, "volume"] = np.nan
    pdf.loc[40, "high"] = np.nan
    bars = spark.createDataFrame(pdf).select("ticker", "date", "open", F.nanvl("high", F.lit(None)).alias("high"), "low",
                                             "close", F.nanvl("volume", F.lit(None)).alias("volume"))
    got = frame(panel_features(bars), "date")
    assert got["volume_log"][30] == 0.0
    assert np.isnan(got["high_low_range"][40])
    assert np.isnan(frame(base_features(bars, ["log_volume"]), "date")["log_volume"][30])


def test_families():
    assert family_indicators("F0") == []
    assert "rsi_14_rolling" in family_indicators("F1", "R0_rolling") and "rsi_14" not in family_indicators("F1", "R0_rolling")


def test_leave_one_out_equals_recomputation(panel, panel_pdf):
    feats = panel_features(panel, ["log_return_1"])
    got = frame(add_market_loo(feats).select("ticker", "date", "log_return_1", *MARKET_LOO_FEATURES), "ticker", "date")
    valid = got[got["log_return_1"].notna()]
    for _, row in valid.sample(40, random_state=1).iterrows():
        others = valid[(valid["date"] == row["date"]) & (valid["ticker"] != row["ticker"])]["log_return_1"]
        assert np.isclose(row["market_return_mean_loo"], others.mean())
        assert np.isclose(row["market_breadth_loo"], (others > 0).mean())
        assert np.isclose(row["market_dispersion_loo"], others.std())


def test_single_member_sector_is_undefined(spark, panel):
    sectors = spark.createDataFrame([("T0", "S1"), ("T1", "S2"), ("T2", "S2"), ("T3", "S2")], "ticker string, sector string")
    got = frame(add_sector_context(panel_features(panel, ["log_return_1"]), sectors), "ticker", "date")
    lone, pair = got[got["ticker"] == "T0"], got[got["sector"] == "UNKNOWN"]
    assert lone["sector_return_mean_loo"].isna().all() and lone["sector_return_mean"].notna().any()
    assert set(pair["ticker"]) == {"T4", "T5"} and pair["sector_dispersion_loo"].isna().all()


def test_context_has_one_row_per_key(spark, panel):
    sectors = spark.createDataFrame([(f"T{i}", f"S{i % 2}") for i in range(6)], "ticker string, sector string")
    feats = panel_features(panel)
    context = assemble_context(feats, sectors)
    assert context.count() == feats.count() == context.select("ticker", "date").distinct().count()
    assert context.agg(F.max("rank_log_return_5")).first()[0] <= 1.0


def test_late_listing_does_not_reach_back(panel):
    first = panel_features(panel, ["log_return_1"]).where("ticker = 'T5'").agg(F.min("date")).first()[0]
    assert first >= dt.date(2018, 4, 2)
