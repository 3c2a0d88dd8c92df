"""Origins with every horizon, views of one stored table, labels with what their bars carry."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillpanel.operators import metrics as m
from quillpanel.operators import models as md
from quillpanel.operators import splits, targets
from quillpanel.plans import assemble

DAY = dt.date(2000, 1, 3)
HORIZON_ROWS = "ticker string, origin_date date, target_date date, horizon int, y_true int, fold int"


@pytest.fixture(scope="module")
def rows(spark):
    """Three tickers, one NULL; some origins lack a horizon, one has a horizon twice, some labels end in the next year."""
    out = []
    for t in ("a", "b", None):
        for i in range(360):
            day = DAY + dt.timedelta(days=i)
            for h in targets.HORIZONS:
                if (i % 7 == 2 and h == 3) or (i % 11 == 5 and h != 1):
                    continue
                out.append((t, day, day + dt.timedelta(days=h), h, i % 2, 2000))
                if i % 7 == 2 and h == 5:
                    out.append(out[-1])
    return spark.createDataFrame(out, HORIZON_ROWS)


def plan(df):
    return df._jdf.queryExecution().toString()


def counted(df):
    return sorted(map(repr, df.collect()))


def test_common_origins_hold_one_group_an_origin(rows):
    got = targets.common_origins(rows)
    want = rows.groupBy("ticker", "origin_date").agg(F.count_distinct("horizon").alias("h")).where("h = 4").select("ticker", "origin_date")
    assert counted(got) == counted(want) and got.count() > 200
    assert "distinct" not in plan(got).lower()


def test_common_in_folds_joins_nothing(rows):
    folds = [splits.Fold("f", ("2000-01-01", "2000-06-30"), ("2000-07-01", "2000-12-31")),
             splits.Fold("g", ("2000-01-01", "2000-09-30"), ("2000-10-01", "2001-12-31"))]
    rows = rows.drop("fold")
    got = splits.common_in_folds(rows, folds, targets.HORIZONS)
    placed = splits.assign_folds(rows, folds)
    by = ["fold", "split", "ticker", "origin_date"]
    keys = placed.groupBy(*by).agg(F.count_distinct("horizon").alias("h")).where("h = 4").drop("h")
    want = placed.join(keys, by, "left_semi").select(*got.columns)
    assert counted(got) == counted(want) and got.count() > 1000
    assert "Join" not in plan(got)


def test_views_are_flags(rows):
    rows = rows.where("ticker is not null").dropDuplicates()
    got = targets.view_flags(rows, 4, ("ticker", "horizon", "fold"))
    assert got.count() == rows.count()
    assert counted(got.where("in_spaced").select(*rows.columns)) == counted(targets.non_overlapping(rows, ("ticker", "horizon", "fold")))
    assert counted(got.where("in_common").select(*rows.columns)) == counted(targets.keep_common(rows, targets.common_origins(rows)))


def test_predictions_lie_together_by_ticker(spark, monkeypatch):
    """A score is joined to a bar, not to each of its labels, so labels are not moved again."""
    monkeypatch.setattr(assemble, "frozen", lambda df: df)
    found = plan(assemble.horizon_predictions(spark, "/root/testdata/sf0.001"))
    physical = found[found.index("== Physical Plan =="):]
    assert physical.index("Generate") < physical.index("Join")


def test_labels_are_summed_once(spark, panel, monkeypatch):
    labels = targets.horizon_targets(panel, carry=("volume",))
    assert {"volume", "close_t"} <= set(labels.columns)
    pred = labels.select("ticker", "origin_date", F.col("target_end_date").alias("target_date"), "horizon", F.col("y").alias("y_true"),
                         (F.hash("ticker", "origin_date") % 100 / 200 + 0.5).alias("p_up"))
    train = pred.select("ticker", "horizon", "y_true")
    stored = []
    real = m.frozen
    monkeypatch.setattr(m, "frozen", lambda df: stored.append(1) or real(df))
    plain = m.direction_block(pred, train, ["horizon"])
    assert stored == [1]
    assert counted(plain) == counted(m.direction_block(pred, m.ticker_labels(train, ["horizon"]), ["horizon"]))
    assert stored == [1]


def test_shuffled_values_are_not_broadcast(spark):
    df = spark.createDataFrame([(f"t{i}", DAY, float(i), float(-i)) for i in range(40)], "ticker string, origin_date date, a double, b double")
    numbered, n = md.numbered(df, 1)
    copies = md.shuffled_copies(numbered, n, ["a", "b"], 2, 1)
    assert "Broadcast" not in plan(copies)
    assert copies.count() == 160
    assert sorted(r.a for r in copies.where("feature = 'a' and repeat = 1").collect()) == [float(i) for i in range(40)]
