from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel.operators import calibration, decisions, gates, metrics, models, samples, scaling, universe
from quillpanel.plans import skew
from quillpanel.session import checkpoint_dir
from quillpanel.sources import bars, events, store

D = dt.date


def test_csv_folder_with_duplicates_and_bad_numbers(spark, tmp_path):
    body = "Date,Open,High,Low,Close,Volume\n2023-01-02 09:15:00,1,2,0.5,1.5,10\n2023-01-02 09:16:00,x,2,0.5,,10\n"
    (tmp_path / "MM_minute.csv").write_text(body)
    (tmp_path / "MM_minute_new.csv").write_text(body * 3)
    (tmp_path / "BOC_X.csv").write_text(body)
    labels = spark.createDataFrame([("BRITISH OXYGEN", "BOC_X")], "label string, stem string")
    got = bars.read_bar_files(spark, str(tmp_path), labels).collect()
    assert sorted((r["ticker"], r["close"]) for r in got) == [("BRITISH OXYGEN", 1.5), ("MM", 1.5)]


def test_missing_header_is_an_error(spark):
    with pytest.raises(ValueError):
        bars.resolve_headers(spark.createDataFrame([(1, 2)], "Date int, Open int"))


def test_repeated_dates_first_and_last(spark):
    rows = [("A", "2020-01-01", 1.0, 1.0, 1.0, 1.0, 1.0, 1), ("A", "2020-01-01 15:00:00", 2.0, 2.0, 2.0, 2.0, 2.0, 2),
            ("A", "2020-01-02", 1.0, 1.0, 1.0, -1.0, 1.0, 3), ("A", "bad", 1.0, 1.0, 1.0, 1.0, 1.0, 4)]
    raw = spark.createDataFrame(rows, "ticker string, date string, open double, high double, low double, close double, volume double, seq int")
    assert sorted(r["close"] for r in bars.normalize_daily(raw, "seq").collect()) == [-1.0, 1.0]
    assert [r["close"] for r in bars.normalize_panel(raw, "seq").collect()] == [2.0]


def test_intraday_skips_missing_prices(spark):
    t = lambda h: dt.datetime(2020, 1, 1, h)
    rows = [("A", t(9), None, 5.0, 1.0, 2.0, None), ("A", t(10), 3.0, None, 2.0, 4.0, None), ("A", t(11), 4.0, 6.0, 3.0, None, None)]
    raw = spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double")
    r = bars.resample_intraday(raw).first()
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (3.0, 6.0, 1.0, 4.0, 0.0)


def test_ragged_event_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\tb\tc\na\tb\n\t\t\n")
    rows = events.split_rows(events.read_event_lines(spark, str(tmp_path)), 3)
    r = events.row_counts(rows).first()
    assert (r["kept"], r["ragged"]) == (2, 1) and events.kept(rows).count() == 2


def test_store_roundtrip_and_reuse(spark, panel, tmp_path):
    root = str(tmp_path / "store")
    tables = {t: panel for t in store.STORE_TABLES}
    a = store.write_store(tables, root, {"v": 1})
    assert store.write_store(tables, root, {"v": 1}) == a != store.write_store(tables, root, {"v": 2})
    assert store.load_store(spark, root)["targets"].count() == panel.count()
    with pytest.raises(FileNotFoundError):
        store.load_store(spark, str(tmp_path / "none"))


def test_store_joins_without_an_exchange(spark, panel, tmp_path):
    root = str(tmp_path / "bucketed")
    tables = {"stock_features": panel, "market_context": panel.groupBy("date").agg(F.avg("close").alias("market")),
              "sector_context": panel.select("ticker", "date", F.lit("S").alias("sector")),
              "cross_sectional_features": panel.select("ticker", "date", (F.col("close") * 2).alias("twice")),
              "targets": panel.select("ticker", F.col("date").alias("origin_date"), F.lit(1).alias("y")).where("ticker <> 'T0'")}
    store.write_store(tables, root, {}, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for forgotten in (False, True):
            for t in [t.name for t in spark.catalog.listTables() if t.name.startswith("store_")] if forgotten else []:
                spark.sql(f"DROP TABLE {t}")  # as in a session that has not written the store; its files stay
            joined = store.store_panel(store.load_store(spark, root))
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and plan.count("SortMergeJoin") == 3
            assert joined.count() == panel.count() and joined.where("y IS NULL").select("ticker").distinct().collect() == [("T0",)]
            assert joined.where("twice <> 2 * close OR market IS NULL OR sector <> 'S'").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ledger_refuses_forbidden_claims(spark, tmp_path):
    path, cols = str(tmp_path / "ledger"), ("id", "variant", "fold", "seed", "best_epoch", "test_evaluated")
    ok = spark.createDataFrame([("1", "A", "f", 42, 3)], "id string, variant string, fold string, seed int, best_epoch int")
    store.append_ledger(ok, path, cols, ("test_evaluated",))
    with pytest.raises(store.LedgerError):
        store.append_ledger(ok.withColumn("test_evaluated", F.lit("YES")), path, cols, ("test_evaluated",))
    with pytest.raises(store.LedgerError):
        store.append_ledger(ok.withColumn("extra", F.lit(1)), path, cols, ())
    s = store.ledger_summary(store.read_ledger(spark, path), "test_evaluated").first()
    assert (s["total_experiments"], s["forbidden_claims"], s["max_best_epoch"]) == (1, 0, 3)


def test_manifest_hashes(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"hello")
    (tmp_path / "y.bin").write_bytes(b"world")
    m = {r["file"]: (r["bytes"], r["sha256"]) for r in store.file_manifest(spark, str(tmp_path)).collect()}
    assert m["x.bin"] == (5, hashlib.sha256(b"hello").hexdigest())
    one = store.manifest_hash(store.file_manifest(spark, str(tmp_path))).first()["fingerprint"]
    (tmp_path / "y.bin").write_bytes(b"World")
    assert store.manifest_hash(store.file_manifest(spark, str(tmp_path))).first()["fingerprint"] != one


def test_target_cache_refuses_late_dates(spark, tmp_path):
    df = spark.createDataFrame([("A", D(2019, 1, 1), D(2020, 1, 1), 1)], "ticker string, origin_date date, target_end_date date, horizon int")
    store.write_targets(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        store.load_targets(spark, str(tmp_path / "t"), "2019-12-31")


def test_vocabulary_and_symbols(spark):
    v = {r["value"]: r["id"] for r in universe.vocabulary(spark.createDataFrame([("b",), ("a",), ("UNKNOWN",), ("b",)], "s string"), "s").collect()}
    assert v == {"UNKNOWN": 0, "a": 1, "b": 2}
    names = ["BRITISH OXYGEN (BOC)", "L&T", "POND'S", "()"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(universe.safe_label(F.col("n"))).collect()
    assert [r[0] for r in got] == ["BRITISH_OXYGEN_BOC", "L_AND_T", "PONDS", "UNNAMED"]


def test_scalers(spark):
    x = np.r_[np.random.default_rng(0).normal(5, 2, 50), 9.0]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": 1.0, "w": np.arange(51) % 3}))
    std = {r["feature"]: r for r in scaling.fit_scaler(df, ["x", "c"]).collect()}
    assert np.isclose(std["x"]["scale"], x.std()) and std["c"]["scale"] == 1.0
    w = scaling.fit_scaler(df, ["x"], weight="w").first()
    rep = np.repeat(x, np.arange(51) % 3)
    assert np.isclose(w["center"], rep.mean()) and np.isclose(w["scale"], rep.std())
    z = scaling.apply_scaler(df, scaling.fit_scaler(df, ["x", "c"], "robust"), ["x", "c"]).toPandas()
    assert np.isclose(z["x"].median(), 0)


def test_sequences_inclusive_and_exclusive(spark):
    df = spark.createDataFrame([("A", D(2020, 1, d), float(d), float(d % 2)) for d in range(1, 7)], "ticker string, date date, x double, target double")
    inc = {r["date"].day: r["sequence"] for r in samples.with_sequences(df, ["x"], 3).collect()}
    exc = {r["date"].day: r["sequence"] for r in samples.sequences_before(df, ["x"], 3).collect()}
    assert inc[3] == [[1.0], [2.0], [3.0]] and inc[2] is None
    assert exc[4] == [[1.0], [2.0], [3.0]] and 3 not in exc


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 800
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.8 * x - 0.3)))).astype(int)
    days = pd.bdate_range("2020-01-01", periods=80)
    pdf = pd.DataFrame({"fold": "F", "split": np.where(np.arange(n) < 600, "train", "val"), "ticker": [f"T{i % 10}" for i in range(n)],
                        "origin_date": [days[i // 10].date() for i in range(n)], "x": x, "z": z, "y_true": y,
                        "p_up": 1 / (1 + np.exp(-3 * x))})
    return spark.createDataFrame(pdf).cache(), pdf


def newton(X, y, ridge):
    X = np.c_[np.ones(len(X)), X]
    R = np.diag([0.0] + [ridge] * (X.shape[1] - 1))
    b = np.zeros(X.shape[1])
    for _ in range(50):
        s = 1 / (1 + np.exp(-X @ b))
        b -= np.linalg.solve((X * (s * (1 - s))[:, None]).T @ X + R, X.T @ (s - y) + R @ b)
    return b


def test_logistic_screen_equals_newton(scored):
    df, pdf = scored
    train, val = pdf[pdf["split"] == "train"], pdf[pdf["split"] == "val"]
    cols = ["x", "z"]
    mu, sd = train[cols].mean().to_numpy(), train[cols].std(ddof=0).to_numpy()
    b = newton((train[cols].to_numpy() - mu) / sd, train["y_true"].to_numpy(), 1.0)
    want = 1 / (1 + np.exp(-(b[0] + ((val[cols].to_numpy() - mu) / sd) @ b[1:])))
    screen = models.fit_screen(df.where("split = 'train'"), cols)
    got = screen.score(df.where("split = 'val'")).orderBy("origin_date", "ticker").toPandas()["p_up"]
    order = val.sort_values(["origin_date", "ticker"]).index
    np.testing.assert_allclose(got, pd.Series(want, index=val.index).loc[order], atol=1e-5)


def test_temperature_and_platt(scored):
    df, pdf = scored
    z = np.log(pdf["p_up"] / (1 - pdf["p_up"])).to_numpy()
    y = pdf["y_true"].to_numpy()
    grid = np.exp(np.linspace(-1, 3, 20001))
    s = [-np.mean(y * np.log(1 / (1 + np.exp(-z / t))) + (1 - y) * np.log(1 / (1 + np.exp(z / t)))) for t in grid[::50]]
    t = calibration.fit_temperature(df, ["fold"]).first()["temperature"]
    assert abs(np.log(t) - np.log(grid[::50][int(np.argmin(s))])) < 0.02
    b = newton(pdf[["p_up"]].to_numpy(), y, 1e-6)
    r = calibration.fit_platt(df, ["fold"]).first()
    assert np.isclose(r["intercept"], b[0], atol=1e-6) and np.isclose(r["coefficient"], b[1], atol=1e-6)


def test_isotonic_is_monotone_and_mean_preserving(scored):
    df, _ = scored
    out = calibration.apply_isotonic(calibration.fit_isotonic(df), df).orderBy("p_up").toPandas()
    assert (out["p_calibrated"].diff().dropna() >= -1e-12).all()
    assert np.isclose(out["p_calibrated"].mean(), out["y_true"].mean())


def test_shuffle_is_a_permutation(spark, scored, tiny_groups):
    df, pdf = scored
    got = models.shuffled(df.dropDuplicates(["ticker", "origin_date"]), "x", 1).toPandas()
    assert np.allclose(np.sort(got["x"]), np.sort(pdf["x"])) and not np.allclose(got["x"], pdf["x"])


def test_informative_column_matters(scored):
    df, _ = scored
    screen = models.fit_screen(df.where("split = 'train'"), ["x", "z"])
    imp = {r["feature"]: r["importance"] for r in models.permutation_importance(screen, df.where("split = 'val'"), ["x", "z"], 2).collect()}
    assert imp["x"] > 0.05 > abs(imp["z"])


def test_one_class_fold_and_ties(spark):
    rows = [("f", "A", D(2020, 1, 1), D(2020, 1, 2), 1, 0.7), ("f", "B", D(2020, 1, 1), D(2020, 1, 2), 1, 0.7)]
    pred = spark.createDataFrame(rows, "fold string, ticker string, origin_date date, target_date date, y_true int, p_up double")
    assert metrics.roc_auc(pred, ["fold"]).first()["roc_auc"] is None
    r = metrics.direction_scores(pred, ["fold"]).first()
    assert r["balanced_accuracy"] is None and r["accuracy"] == 1.0
    assert metrics.selections_at_k(pred, ["fold"], 2).first()["up_tickers"] == "A,B"
    assert metrics.precision_at_k(pred, ["fold"], 3).count() == 0


def test_risk_bands(spark):
    pred = spark.createDataFrame([("A", D(2020, 1, 1), 0.85), ("B", D(2020, 1, 1), 0.3), ("C", D(2020, 1, 1), 0.55)],
                                 "ticker string, origin_date date, p_up double")
    snap = pred.select("ticker", "origin_date", F.lit(100.0).alias("close"), F.lit(2.0).alias("atr_14"))
    got = {r["ticker"]: r for r in decisions.risk_decisions(pred, snap).collect()}
    assert (got["A"]["stop_loss"], got["A"]["take_profit"], got["A"]["confidence_level"]) == (98.4, 103.0, "HIGH")
    assert (got["B"]["direction"], got["B"]["stop_loss"], got["B"]["confidence_level"]) == ("DOWN", 102.0, "MEDIUM")
    assert got["C"]["confidence_level"] == "LOW"


def test_missing_figure_ranks_last(spark):
    df = spark.createDataFrame([(1, None), (3, 0.6), (5, 0.7)], "horizon int, mean_roc_auc double")
    got = {r["horizon"]: r["rank"] for r in gates.ranked(df, [("mean_roc_auc", "desc")]).collect()}
    assert got == {5: 1, 3: 2, 1: 3}


def test_gate_fails_on_missing_figures(spark):
    cols = ["mean_roc_auc", "mean_balanced_accuracy", "mean_baseline_delta", "years_roc_auc_above_50", "common_mean_baseline_delta",
            "non_overlap_mean_roc_auc", "years_beating_majority_baseline"]
    good, bad = (0.6, 0.6, 0.02, 5, 0.01, 0.55, 5), (0.6, 0.6, 0.02, 5, None, 0.55, 5)
    df = spark.createDataFrame([good, bad], ", ".join(f"{c} double" if "years" not in c else f"{c} int" for c in cols))
    got = [r["classification"] for r in gates.horizon_gate(df, gates.HORIZON_THRESHOLDS).collect()]
    assert got == ["STRONGLY_PROMISING", "SCREEN_FAIL"]


def test_frozen_table_lands_in_the_shared_folder(spark, panel):
    stored = skew.frozen(panel)
    assert checkpoint_dir(spark).split("file:")[-1] in stored.inputFiles()[0]
    assert stored.count() == panel.count()


def test_configured_folder_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or checkpoint_dir(spark) == configured


def test_manifest_of_files_of_any_size(spark, tmp_path, monkeypatch):
    """Files are hashed alike as rows and in pieces; one of more than 2 GB (without content on disk) is no row."""
    names = {"a.bin": b"z", "b.gz": b"not gzip", "sub/c d%20é.bin": b"x" * 100, "sub/e.bin": b"y" * 99}
    (tmp_path / "sub").mkdir()
    for name, content in names.items():
        (tmp_path / name).write_bytes(content)
    want = sorted((n.split("/")[-1], len(c), hashlib.sha256(c).hexdigest()) for n, c in names.items())
    for whole in (store.WHOLE, 99, 7):
        monkeypatch.setattr(store, "WHOLE", whole)
        assert sorted(map(tuple, store.file_manifest(spark, str(tmp_path)).collect())) == want
    monkeypatch.undo()
    with (tmp_path / "large.bin").open("wb") as file:
        file.truncate((1 << 31) + 5)
    digest = hashlib.sha256()
    for _ in range(128):
        digest.update(bytes(1 << 24))
    digest.update(bytes(5))
    got = store.file_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted([*want, ("large.bin", (1 << 31) + 5, digest.hexdigest())])
    assert store.manifest_hash(got).first().total_bytes == (1 << 31) + 5 + 208
