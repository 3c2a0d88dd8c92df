"""Boosted and forest screens grown together: the same scores as ``pyspark.ml``, work by cells, not by rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel.operators import models, tree_grid

COLUMNS = {"X0": ["a"], "X1": ["a", "b", "c"]}


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    n = 6000
    x = rng.normal(size=(n, 3))
    x[:, 2] = np.round(3 * x[:, 2])
    y = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * x[:, 1] + x[:, 2] / 2)))
    x[rng.random((n, 3)) < 0.01] = np.nan
    pdf = pd.DataFrame({"ticker": [f"T{i}" for i in range(n)], "fold": np.where(rng.random(n) < 0.9, "Y1", "Y2"),
                        "split": np.where(rng.random(n) < 0.7, "train", "val"), "y_true": y.astype(int), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "abc"}).cache()


def _pandas(df):
    return df.toPandas().sort_values(["model", "family", "fold", "ticker"], ignore_index=True)


def test_boosted_fits_are_made_together(samples, monkeypatch):
    monkeypatch.setitem(models.BOOSTED, "maxIter", 5)
    monkeypatch.setattr(tree_grid, "STORED_ROUNDS", 2)
    monkeypatch.setattr(tree_grid, "BLOCK_CELLS", 500)
    grid = [{"model": "boosted", "family": f, "fold": y} for f in COLUMNS for y in ("Y1", "Y2")]
    want = _pandas(models.screen_grid(samples, [{**g, "settings": {"maxIter": 5}} for g in grid], COLUMNS))

    def no(*_, **__):
        raise AssertionError("one fit at a time")

    monkeypatch.setattr(models, "GBTClassifier", no)
    got = _pandas(models.screen_grid(samples, grid, COLUMNS))
    pd.testing.assert_frame_equal(got.drop(columns="p_up"), want.drop(columns="p_up"))
    off = abs(got["p_up"] - want["p_up"])
    assert off[got["fold"] == "Y1"].max() < 1e-9
    assert off.mean() < 1e-3  # in nodes of a few rows several splits are alike, and the order of sums decides


def test_forest_of_many_rows_works_on_cells(samples, monkeypatch):
    """About the scores of ``pyspark.ml``, whose draws differ; equal however the rows are partitioned."""
    monkeypatch.setitem(models.FOREST, "numTrees", 40)
    grid = [{"model": "forest", "family": "X1", "fold": "Y1"}]
    want = _pandas(models.screen_grid(samples, grid, COLUMNS))
    monkeypatch.setattr(models, "FEW_ROWS", 0)
    monkeypatch.setattr(models, "RandomForestClassifier", None)
    got = _pandas(models.screen_grid(samples, grid, COLUMNS))
    assert list(got["ticker"]) == list(want["ticker"])
    assert np.corrcoef(got["p_up"], want["p_up"])[0, 1] > 0.95
    assert abs(got["p_up"] - want["p_up"]).mean() < 0.06
    monkeypatch.setattr(tree_grid, "DRAWN_CELLS", 700)
    again = _pandas(models.screen_grid(samples.repartition(3, "b"), grid, COLUMNS))
    pd.testing.assert_frame_equal(got, again)


def test_cells_of_equal_rows(samples, spark):
    """Rows that share their bins are one cell: ten copies make as many cells as one."""
    fits = [tree_grid.Fit({"model": "forest", "family": "X1"}, ("a", "b", "c"), "Y1", models.FOREST)]
    tree_grid._set_edges(samples, fits)
    once = tree_grid._cells(samples, fits, "y_true")
    many = tree_grid._cells(samples.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(10)))), fits, "y_true")
    assert many.count() == once.count()
    assert many.agg(F.sum("n")).first()[0] == 10 * once.agg(F.sum("n")).first()[0]


def test_edges_are_those_of_pyspark_ml():
    values, counts = np.arange(10.0), np.array([1, 1, 1, 1, 6, 1, 1, 1, 1, 6])
    assert list(tree_grid.edges_of_counts(values, counts, 20)) == [i + 0.5 for i in range(9)]
    assert list(tree_grid.edges_of_counts(values, counts, 3)) == [3.5, 4.5, 8.5]
