"""Steps that keep rows narrow, sorted once and stored once; results against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillpanel.plans import skew


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_several_columns_sort_rows_once(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"d": rng.integers(0, 6, n), "id": np.arange(n), "a": np.round(rng.normal(0, 1, n), 1),
                        "b": rng.integers(0, 5, n).astype(float), "c": rng.integers(0, 9, n)})
    pdf.loc[rng.choice(n, 50, replace=False), "a"] = np.nan
    pdf.loc[pdf["d"] == 2, "b"] = np.nan  # a group without a value
    df = spark.createDataFrame(pdf)
    df = df.select(F.when(F.col("d") > 0, F.col("d")).alias("d"), "id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "ab"], "c")
    names = {"a": "ra", "b": "rb", "c": "rc"}
    assert plan_of(skew.average_ranks(df, ["d"], names, fits=True)).count("Sort ") == 1
    for percent in (True, False):
        got = skew.average_ranks(df, ["d"], names, fits=True, percent=percent).orderBy("id").toPandas()
        for source, name in names.items():
            want = pdf.groupby("d")[source].rank(pct=percent)
            np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-12)


def test_ranks_of_special_values_equal_a_window(spark):
    rows = [(1, float("nan"), 1.0), (1, 0.0, None), (1, -0.0, 2.0), (1, None, 2.0), (1, float("inf"), 2.0), (1, float("nan"), None)]
    df = spark.createDataFrame(rows, "d int, a double, b double")
    got = skew.average_ranks(df, ["d"], {"a": "ra", "b": "rb"}, fits=True)
    for source, name in (("a", "ra"), ("b", "rb")):
        alone = skew.average_ranks(df, ["d"], {source: "r"}, fits=True)
        assert sorted(map(repr, got.select(source, F.col(name).alias("r")).collect())) == sorted(
            map(repr, alone.select(source, "r").collect()))


def test_attributions_meet_where_their_rows_were_dealt(spark, monkeypatch):
    from quillpanel.operators import decisions

    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    days = spark.range(400).select(F.concat(F.lit("T"), F.col("id") % 7).alias("ticker"), F.col("id").alias("origin_date"),
                                   (F.col("id") / 3).alias("a"), (-F.col("id")).cast("double").alias("b"))
    dealt = skew.spread(days, ["ticker", "origin_date"])
    assert dealt.rdd.getNumPartitions() == 40
    long = dealt.select("ticker", "origin_date", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in "ab"])))
    top = decisions.mean_attributions(long, ["ticker", "origin_date"], 1)
    assert plan_of(top).count("Exchange hashpartitioning") == 1
    got = top.orderBy("origin_date").collect()
    assert len(got) == 400 and all(r["feature"] == ("b" if r["origin_date"] else "a") for r in got)


def test_reason_text_deals_its_attributions(spark, monkeypatch):
    from quillpanel.catalog import QUERIES, jobs
    from tests.conftest import SMALL

    dealt = []
    monkeypatch.setattr(jobs, "spread", lambda df, keys: dealt.append(keys) or skew.spread(df, keys))
    assert not QUERIES["reason_text"](spark, SMALL).isEmpty()
    assert dealt == [["ticker", "origin_date"]]


def test_store_makes_its_features_once(spark, monkeypatch):
    from quillpanel.catalog import jobs
    from tests.conftest import SMALL

    made, seen = [], {}
    real = jobs.frozen
    monkeypatch.setattr(jobs, "frozen", lambda df: made.append(df.columns) or real(df))
    monkeypatch.setattr(jobs.store, "write_store", lambda tables, *a, **k: seen.update(tables))
    monkeypatch.setattr(jobs.store, "load_store", lambda *a: None)
    jobs._store(spark, SMALL)
    assert "Window" not in plan_of(seen["stock_features"]) and "lineitem" not in plan_of(seen["targets"])
    assert len(made) == 1 and seen["stock_features"].columns == made[0]
