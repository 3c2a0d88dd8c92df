"""Cases that the supplied tables cannot show."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel.functions import ema
from quillpanel.operators import calibration, gates, news, universe
from quillpanel.plans import skew
from quillpanel.sources import bars

from .conftest import SMALL


@pytest.fixture(scope="module")
def with_null_key(spark):
    rows = [(None if i % 3 == 0 else f"k{i % 2}", i, float(i % 7), i % 4) for i in range(120)]
    return spark.createDataFrame(rows, "d string, id long, v double, w long").cache()


def both(make, *order):
    a, b = (make(fits).orderBy(*order).toPandas() for fits in (True, False))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)])
    return a


def test_null_is_a_group_in_both_forms(with_null_key, tiny_groups):
    df = with_null_key
    assert len(both(lambda fits: skew.positions(df, ["d"], [F.col("id").asc()], fits=fits), "id")) == 120
    ranks = both(lambda fits: skew.average_ranks(df, ["d"], {"v": "r"}, fits=fits), "id")
    assert ranks["r"].notna().all()
    both(lambda fits: skew.previous_value(df, ["d"], "id", "p", fits=fits), "id")
    assert len(both(lambda fits: skew.quantiles(df, ["d"], "v", {"m": 0.5}, fits=fits), "d")) == 3


def test_files_with_other_header_orders(spark, tmp_path):
    (tmp_path / "AA_MINUTE.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,0.5,1.5,10\n")
    (tmp_path / "BB.csv").write_text("timestamp,c,o,h,l,v,extra\n2020-01-01,1.5,1,2,0.5,10,x\n")
    (tmp_path / "OLD_1MIN.csv").write_text("Volume,Close,Low,High,Open,Date\n10,1.5,0.5,2,1,2020-01-01\n10,,1,1,1,2020-01-02\n")
    sheet = spark.createDataFrame([(" CC ", "old_1min.csv"), ("", "BB.csv")], "legacy_label string, csv_filename string")
    got = bars.read_bar_files(spark, str(tmp_path), bars.label_map_of(sheet)).collect()
    assert sorted((r.ticker, r.open, r.high, r.low, r.close, r.volume) for r in got) == [
        (t, 1.0, 2.0, 0.5, 1.5, 10.0) for t in ("AA", "BB", "CC")]


def test_temperature_both_ways(spark):
    """Scores that point the right way have an inner optimum, those that point the wrong way the bound."""
    rng = np.random.default_rng(3)
    p = rng.uniform(0.02, 0.98, 800)
    y = (rng.uniform(size=800) < p).astype(int)
    rows = [("right", float(a), int(b)) for a, b in zip(p, y)] + [("wrong", float(1 - a), int(b)) for a, b in zip(p, y)]
    df = spark.createDataFrame(rows, "fold string, p_up double, y_true int")
    got = {r.fold: r for r in calibration.fit_temperature(df, ["fold"]).collect()}
    z = np.log(p / (1 - p))

    def loss(a):
        return np.logaddexp(0, -(2 * y - 1) * a * z).sum()

    best = 1 / got["right"].temperature
    assert got["right"].converged and loss(best) <= min(loss(best * f) for f in (0.99, 1.01, 0.5, 2))
    assert not got["wrong"].converged and got["wrong"].temperature == 2.0 ** 20


def test_first_listed_industry_counts(spark):
    listed = spark.createDataFrame([("A", "Zinc", 1), ("a ", "Apples", 2), ("B", None, 1), ("B", "Tin", 2)],
                                   "symbol string, industry string, seq int")
    got = universe.build_sectors(spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string"), listed).collect()
    assert {r.ticker: r.industry for r in got} == {"A": "Zinc", "B": "UNKNOWN", "C": "UNKNOWN"}


def test_two_stamp_columns_are_none(spark):
    stamp = "20170612000000"
    rows = spark.createDataFrame([([stamp, stamp, "http://x.y"],), ([stamp, stamp, "http://x.z"],)], "fields array<string>")
    assert [(r.role, r.pos) for r in news.infer_columns(rows, F.lit(stamp)).collect()] == [("source_url", 2)]


def test_infinity_reaches_no_floor(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (0.5,)], "x double")
    assert [r[0] for r in df.select(gates.at_least("x", 0.5)).collect()] == [False, False, False, True]


def test_average_is_undefined_from_a_gap_on(spark):
    x = [float(i % 5) for i in range(40)]
    rows = [("a", i + 1, x[i] if i != 30 else None) for i in range(40)] + [("b", i + 1, x[i]) for i in range(40)]
    df = spark.createDataFrame(rows, "ticker string, _rn int, x double")
    out = ema.add_emas(df, [ema.Ema("y", "x", ema.span(12))]).orderBy("ticker", "_rn").toPandas()
    want = pd.Series(x).ewm(span=12, adjust=False).mean()
    np.testing.assert_allclose(out[out.ticker == "b"]["y"], want, rtol=1e-12)
    np.testing.assert_allclose(out[out.ticker == "a"]["y"][:30], want[:30], rtol=1e-12)
    assert out[out.ticker == "a"]["y"][30:].isna().all()


def test_average_is_carried_over_gaps(spark):
    """The reference's averages, with NULLs at the start, inside, in long runs and at the end."""
    rng = np.random.default_rng(5)
    series = {"whole": rng.normal(5, 2, 700), "holes": rng.normal(5, 2, 700), "runs": rng.normal(5, 2, 3000), "none": np.full(30, np.nan)}
    series["holes"][rng.uniform(size=700) < 0.4] = np.nan
    series["runs"][:3], series["runs"][40:45], series["runs"][100:2600], series["runs"][2990:] = (np.nan,) * 4
    rows = [(t, i + 1, None if np.isnan(v) else float(v)) for t, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, _rn int, x double")
    specs = [ema.Ema("a", "x", ema.span(12)), ema.Ema("b", "x", ema.wilder(14), skip=1), ema.Ema("c", "x", ema.span(2))]
    out = ema.add_emas_over_gaps(df, specs).orderBy("ticker", "_rn").toPandas()
    for t, x in series.items():
        got = out[out.ticker == t]
        for s in specs:
            part = pd.Series(x).where(np.arange(len(x)) >= s.skip)
            np.testing.assert_allclose(got[s.out].astype(float), part.ewm(alpha=s.alpha, adjust=False).mean(), rtol=1e-9)


def test_indicators_after_a_missing_close(spark, panel_pdf):
    from quillpanel.operators.base_features import base_features

    bars = panel_pdf[panel_pdf.ticker == "T0"].reset_index(drop=True)
    bars.loc[[6, 60], "close"] = np.nan
    close = bars["close"]
    rows = spark.createDataFrame(bars).withColumn("close", F.nanvl("close", F.lit(None)))
    got = base_features(rows, ["rsi_14", "ema_12", "macd_signal"]).orderBy("date").toPandas()
    fast, slow = (close.ewm(span=n, adjust=False).mean() for n in (12, 26))
    np.testing.assert_allclose(got["ema_12"].astype(float), fast, rtol=1e-9)
    np.testing.assert_allclose(got["macd_signal"].astype(float), (fast - slow).ewm(span=9, adjust=False).mean(), rtol=1e-7, atol=1e-10)
    delta = close.diff()
    gain, loss = (d.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for d in (delta.clip(lower=0), -delta.clip(upper=0)))
    np.testing.assert_allclose(got["rsi_14"].astype(float), (100 - 100 / (1 + gain / loss)).fillna(50), rtol=1e-7)


def test_universe_reads_every_line(spark, tmp_path):
    """A supplier with lines is there, whatever the quantities of its lines."""
    import __spark_entry__ as entry

    spark.createDataFrame([(2, 1.0), (4, 50.0), (3, 7.0)], "l_suppkey long, l_quantity double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 7)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.symbol: r.resolution for r in entry.queries()["universe_resolved"](spark, str(tmp_path)).collect()}
    assert got == {"P2": "exact", "P4": "exact", "P6": "not_found", "P10": "alias", "P14": "known_unavailable"}


@pytest.mark.parametrize("name", ["screen_logistic", "screen_components", "permutation_importance"])
def test_screens_cover_every_fold(spark, name):
    import __spark_entry__ as entry

    rows = entry.queries()[name](spark, SMALL).collect()
    assert {r.fold for r in rows} == {"Y1998", "Y1999", "Y2000"}


def test_tree_screens_keep_their_full_settings(spark, monkeypatch):
    """What the queries ask for: every fold, and no setting below the reference's."""
    import __spark_entry__ as entry
    from quillpanel.operators import models

    class Asked(Exception):
        pass

    def ask(samples, grid, columns_of):
        raise Asked(grid)

    monkeypatch.setattr(models, "screen_grid", ask)
    for name, kinds in (("screen_boosted", {"boosted"}), ("screen_forest", {"forest"}), ("screen_grid_scores", {"logistic", "boosted"})):
        with pytest.raises(Asked) as asked:
            entry.queries()[name](spark, SMALL)
        (grid,) = asked.value.args
        assert {(g["model"], g["fold"]) for g in grid} == {(m, f"Y{y}") for m in kinds for y in (1998, 1999, 2000)}
        assert not any(g.get("settings") for g in grid)
    assert models.BOOSTED["maxIter"] == 200 and models.FOREST["numTrees"] == 300


@pytest.mark.parametrize("block", [1, 7, 64])
def test_averages_over_gaps_compose_across_blocks(spark, block):
    """Whole blocks without an input, gaps across their edges, late starts: equal to pandas at any block length."""
    rng = np.random.default_rng(block)
    parts = []
    for t in range(12):
        x = rng.normal(50, 9, 150)
        x[rng.random(150) < (0.0, 0.3, 0.9)[t % 3]] = np.nan
        x[: (0, 20, 70)[t % 3]] = np.nan
        if t > 5:
            x[40:110] = np.nan
        parts.append(pd.DataFrame({"ticker": str(t), "_rn": range(1, 151), "x": x}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    specs = [ema.Ema("a", "x", ema.span(12)), ema.Ema("b", "x", ema.wilder(14), skip=3), ema.Ema("c", "x", ema.span(9))]
    out = ema.add_emas_over_gaps(df, specs, block=block).orderBy("ticker", "_rn").toPandas()
    for s in specs:
        for t, rows in out.groupby("ticker"):
            x = rows["x"].astype(float).copy()
            x.iloc[: s.skip] = np.nan
            want = x.ewm(alpha=s.alpha, adjust=False, ignore_na=False).mean()
            np.testing.assert_allclose(rows[s.out].astype(float), want, rtol=1e-9, err_msg=f"{s.out} {t}")


def test_averages_share_one_sort(spark):
    df = ema.number_rows(spark.createDataFrame([("a", "2020-01-01", 1.0)], "ticker string, date string, x double"))
    two = ema.add_emas_over_gaps(df, [ema.Ema("p", "x", ema.span(12)), ema.Ema("q", "x", ema.wilder(14), skip=1)])
    two = ema.add_emas_over_gaps(two, [ema.Ema("r", "q", ema.span(9))])
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning") == 1  # by date, then by block and row
