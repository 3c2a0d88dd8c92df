"""Calibration, model screens, decisions and stored tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import base_features as base
from ..operators import calibration as cal
from ..operators import cross_section as cs
from ..operators import decisions as dec
from ..operators import models as md
from ..operators import newton_grid as grid
from ..operators import panel_features as pf
from ..operators import samples as smp
from ..operators import splits, targets
from ..operators.metrics import direction_scores, roc_auc
from ..plans import assemble, views
from ..plans.skew import frozen, spread
from ..session import checkpoint_dir, passing_table
from ..sources import store
from . import sql as S
from .metrics import PT
from .registry import query
from .tidy import tidy

CELL = ["fold"]
P = S.with_(*S.PREDICTIONS)


def _reversal(spark, sf):
    """Predictions of the opposite score: last week's losers."""
    return assemble.predictions(spark, sf).withColumn("p_up", 1.0 - F.col("p_up"))


REV = "rev AS (SELECT * REPLACE (1.0::DOUBLE - p_up AS p_up) FROM preds)"
Z = "ln(greatest(least(p_up, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) / (1.0 - greatest(least(p_up, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE)))"


def _sig(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END)"


def temperature_sql(src: str, tag: str = "t") -> str:
    """Bisection of the loss's slope in the logarithm of 1/T: independent of the operator's steps."""
    out = [f"{tag}m AS MATERIALIZED (SELECT fold, z, count(*) AS n, sum(y_true) AS y FROM (SELECT *, {Z} AS z FROM {src}) GROUP BY 1, 2)",
           f"{tag}0 AS MATERIALIZED (SELECT fold, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi FROM {tag}m GROUP BY 1)"]
    s = _sig("pow(2, (lo + hi) / 2) * z")
    for i in range(52):
        out.append(f"""{tag}{i + 1} AS MATERIALIZED (SELECT fold, CASE WHEN g > 0 THEN lo ELSE (lo + hi) / 2 END AS lo, CASE WHEN g > 0 THEN (lo + hi) / 2 ELSE hi END AS hi FROM (
  SELECT m.fold, any_value(lo) AS lo, any_value(hi) AS hi, sum((n * {s} - y) * z) AS g FROM {tag}m m JOIN {tag}{i} USING (fold) GROUP BY 1))""")
    out.append(f"{tag}fit AS (SELECT fold, pow(2, -(lo + hi) / 2) AS temperature, abs((lo + hi) / 2) < 19.999999 AS converged FROM {tag}52)")
    return ",\n".join(out)


#: Newton steps of the reference text, several times what any of its fits needs.
PLATT_STEPS = 30


def platt_sql(src: str, tag: str = "p") -> str:
    out = [f"{tag}m AS MATERIALIZED (SELECT fold, p_up AS p, count(*) AS n, sum(y_true) AS y FROM {src} GROUP BY 1, 2)",
           f"{tag}0 AS MATERIALIZED (SELECT fold, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM {tag}m GROUP BY 1)"]
    s = _sig("b0 + b1 * p")
    for i in range(PLATT_STEPS):
        out.append(f"""{tag}{i + 1} AS MATERIALIZED (SELECT fold, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM (
  SELECT m.fold, any_value(b0) AS b0, any_value(b1) AS b1, sum(n * {s} - y) AS g0, sum((n * {s} - y) * p) + 1e-6 * any_value(b1) AS g1, sum(n * {s} * (1 - {s})) AS h00,
    sum(n * {s} * (1 - {s}) * p) AS h01, sum(n * {s} * (1 - {s}) * p * p) + 1e-6 AS h11 FROM {tag}m m JOIN {tag}{i} USING (fold) GROUP BY 1))""")
    out.append(f"{tag}fit AS (SELECT fold, b1 AS coefficient, b0 AS intercept FROM {tag}{PLATT_STEPS})")
    return ",\n".join(out)


@query("calibration_temperature", P + f", {REV}, {temperature_sql('rev')} SELECT fold, {S.r6('temperature')} AS temperature, converged FROM tfit")
def _(spark, sf):
    return tidy(cal.fit_temperature(_reversal(spark, sf), CELL))


@query("calibration_temperature_plain", P + f", {temperature_sql('preds')} SELECT fold, {S.r6('temperature')} AS temperature, converged FROM tfit")
def _(spark, sf):
    return tidy(cal.fit_temperature(assemble.predictions(spark, sf), CELL))


@query("calibration_platt_plain", P + f", {platt_sql('preds')} SELECT fold, {S.r6('coefficient')} AS coefficient, {S.r6('intercept')} AS intercept FROM pfit")
def _(spark, sf):
    return tidy(cal.fit_platt(assemble.predictions(spark, sf), CELL))


@query("calibration_platt", P + f", {REV}, {platt_sql('rev')} SELECT fold, {S.r6('coefficient')} AS coefficient, {S.r6('intercept')} AS intercept FROM pfit")
def _(spark, sf):
    return tidy(cal.fit_platt(_reversal(spark, sf), CELL))


@query("calibrated_predictions", P + f", {REV}, {temperature_sql('rev')}" + f"""
SELECT ticker, origin_date, fold, {S.r6('p_up')} AS p_up, {S.r6('p')} AS p_calibrated, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction, {S.r6('CASE WHEN p >= 0.5 THEN p ELSE 1 - p END')} AS confidence
FROM (SELECT *, {_sig(f'({Z} / temperature)')} AS p FROM rev JOIN tfit USING (fold))""")
def _(spark, sf):
    pred = _reversal(spark, sf)
    out = dec.assemble_predictions(cal.apply_temperature(pred, cal.fit_temperature(pred, CELL), CELL))
    return tidy(out.select("ticker", "origin_date", "fold", "p_up", "p_calibrated", "direction", "confidence"))


def isotonic_sql(src: str, tag: str = "i") -> str:
    """CTEs with {tag}fit(fold, p, v): the largest of the smallest means over spans that hold a score, a form without pools."""
    return f"""{tag}d AS (SELECT fold, p_up AS p, count(*) AS n, sum(y_true) AS y, row_number() OVER (PARTITION BY fold ORDER BY p_up) AS i FROM {src} GROUP BY 1, 2),
{tag}c AS MATERIALIZED (SELECT *, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM {tag}d WINDOW w AS (PARTITION BY fold ORDER BY i)),
{tag}ab AS (SELECT a.fold, a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM {tag}c a JOIN {tag}c b ON b.fold = a.fold AND b.i >= a.i),
{tag}mn AS (SELECT fold, a, b, min(m) OVER (PARTITION BY fold, a ORDER BY b DESC) AS m FROM {tag}ab),
{tag}iso AS (SELECT fold, b AS i, max(m) AS v FROM {tag}mn GROUP BY 1, 2), {tag}fit AS MATERIALIZED (SELECT fold, p, v FROM {tag}c JOIN {tag}iso USING (fold, i))"""


@query("calibration_isotonic", P + f", {REV}, {isotonic_sql('rev')} SELECT fold, {S.r6('p')} AS p_up, {S.r6('v')} AS p_calibrated FROM ifit")
def _(spark, sf):
    pred = _reversal(spark, sf)
    out = cal.apply_isotonic_cells(cal.fit_isotonic_cells(pred, CELL), pred.select("fold", "p_up").distinct(), CELL)
    return tidy(out.select("fold", "p_up", "p_calibrated"))


_BINS = " + ".join(f"CAST(q >= {i}::DOUBLE * 0.1::DOUBLE AS INTEGER)" for i in range(1, 10))


_PARTS = """dc AS (SELECT fold, origin_date, count(*) AS c FROM rev GROUP BY 1, 2),
cu AS (SELECT *, sum(c) OVER (PARTITION BY fold ORDER BY origin_date) AS cum, sum(c) OVER (PARTITION BY fold) AS n FROM dc),
e AS (SELECT fold, min(origin_date) FILTER (cum >= greatest(1, least(floor(n * 0.6::DOUBLE), n - 1))) AS fit_end, min(origin_date) FILTER (cum >= greatest(1, least(floor(n * 0.6::DOUBLE), n - 1)) + 1) AS score_start FROM cu GROUP BY 1),
fitp AS (SELECT r.* FROM rev r JOIN e USING (fold) WHERE origin_date <= fit_end), scp AS (SELECT r.* FROM rev r JOIN e USING (fold) WHERE origin_date >= score_start)"""
_COMPARED = f"""bb AS (SELECT fold, method, {_BINS} AS bin, count(*) AS n, avg(q) AS mp, avg(y_true) AS mo FROM al GROUP BY 1, 2, 3), ec AS (SELECT fold, method, sum(n * abs(mp - mo)) / sum(n) AS ece FROM bb GROUP BY 1, 2),
nf AS (SELECT fold, count(*) AS n_fit FROM fitp GROUP BY 1)
SELECT fold, method, count(*) AS n_score, {S.r6('avg((q - y_true) * (q - y_true))')} AS brier, {S.r6('avg(CAST((q >= 0.5) = (y_true = 1) AS INTEGER))')} AS accuracy, {S.r6('any_value(ece)')} AS ece, any_value(n_fit) AS n_fit
FROM al JOIN ec USING (fold, method) JOIN nf USING (fold) GROUP BY 1, 2"""


@query("calibration_comparison", P + f", {REV}, {_PARTS}," + f"""
{temperature_sql('fitp')}, {platt_sql('fitp')},
al AS (SELECT fold, y_true, p_up AS q, 'none' AS method FROM scp UNION ALL SELECT fold, y_true, {_sig(f'({Z} / temperature)')}, 'temperature' FROM scp JOIN tfit USING (fold)
  UNION ALL SELECT fold, y_true, {_sig('(coefficient * p_up + intercept)')}, 'platt' FROM scp JOIN pfit USING (fold)),
{_COMPARED}""")
def _(spark, sf):
    split = splits.calibration_split(_reversal(spark, sf), CELL)
    return tidy(cal.compare_methods(split, CELL, ("none", "temperature", "platt")))


@query("calibration_comparison_isotonic", P + f", {REV}, {_PARTS}, {isotonic_sql('fitp')}," + f"""
nb AS (SELECT s.fold, s.y_true, s.p_up, l.p AS x0, l.v AS v0, r.p AS x1, r.v AS v1 FROM scp s ASOF LEFT JOIN ifit l ON l.fold = s.fold AND l.p <= s.p_up ASOF LEFT JOIN ifit r ON r.fold = s.fold AND r.p >= s.p_up),
al AS (SELECT fold, y_true, p_up AS q, 'none' AS method FROM scp
  UNION ALL SELECT fold, y_true, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR v0 = v1 THEN v0 ELSE v0 + (v1 - v0) * (p_up - x0) / (x1 - x0) END, 'isotonic' FROM nb),
{_COMPARED}""")
def _(spark, sf):
    split = splits.calibration_split(_reversal(spark, sf), CELL)
    return tidy(cal.compare_methods(split, CELL, ("none", "isotonic")))


# ---- screens ---------------------------------------------------------------

_X = ["log_return_5", "realized_vol_20", "drawdown_20"]


def _samples(spark, sf):
    """Fold samples with stock features at the origin."""
    bars = views.bars(spark, sf)
    rows = targets.next_day_targets(bars, calendar="own").select(
        "ticker", "origin_date", "target_date", F.col("y_direction").alias("y_true"), F.col("raw_next_return").alias("future_log_return"))
    placed = splits.assign_folds(rows, assemble.FOLDS)
    return frozen(smp.origin_snapshot(placed, pf.panel_features(bars, _X), _X))


@query("class_weights", PT + f"SELECT fold, {S.r6('sum(1 - y_true) / sum(y_true)')} AS positive_weight FROM train GROUP BY 1")
def _(spark, sf):
    return tidy(md.class_weights(assemble.training_labels(spark, sf), ("fold",)))


@query("majority_model", PT + f"SELECT fold, {S.r6('avg(y_true)')} AS p_up FROM train GROUP BY 1")
def _(spark, sf):
    return tidy(md.majority_model(assemble.training_labels(spark, sf), CELL))


_FOLDS = tuple(f"Y{y}" for y in range(assemble.FIRST_YEAR, assemble.LAST_YEAR + 1))


def _by_fold(spark, sf):
    """(fold, training rows, validation rows) of every fold."""
    samples = _samples(spark, sf)
    for fold in _FOLDS:
        s = samples.where(F.col("fold") == fold)
        yield fold, s.where(F.col("split") == "train"), s.where(F.col("split") == "val")


def _screened(spark, sf, kind):
    """Validation rows of every fold scored by a model fitted on its training rows, at the full settings."""
    return md.screen_grid(_samples(spark, sf), [{"model": kind, "family": "X1", "fold": y} for y in _FOLDS], {"X1": _X})


def _solved(n: int, source: str) -> str:
    """Gaussian elimination of the systems (a00 .. , r0 .. ) of ``source``, one row each, and x0 .. by substitution."""
    rows = source
    for k in range(n - 1):
        cols = [f"a{i}{j}" if i <= k else f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in range(n) for j in range(n)]
        rhs = [f"r{i}" if i <= k else f"r{i} - a{i}{k} / a{k}{k} * r{k} AS r{i}" for i in range(n)]
        rows = f"(SELECT * EXCLUDE ({', '.join([f'a{i}{j}' for i in range(n) for j in range(n)] + [f'r{i}' for i in range(n)])}), {', '.join(cols + rhs)} FROM {rows})"
    for k in reversed(range(n)):
        known = "".join(f" - a{k}{j} * x{j}" for j in range(k + 1, n))
        rows = f"(SELECT *, (r{k}{known}) / a{k}{k} AS x{k} FROM {rows})"
    return rows


#: Newton steps of the reference text, more than its fits need.
NEWTON_STEPS = 9


def newton_sql(source: str, d: int = 3, tag: str = "nw") -> str:
    """CTEs that fit (cell, y, w, f0 .. ) of ``source`` by Newton steps: ``{tag}fit`` has cell, c0 .. (raw weights) and icept."""
    n, ix = d + 1, range(d)
    z = ["1.0::DOUBLE", *[f"z{i}" for i in ix]]
    out = [f"{tag}s AS MATERIALIZED (SELECT cell, {', '.join(f'avg(f{i}) AS m{i}, CASE WHEN stddev_pop(f{i}) > 0 THEN stddev_pop(f{i}) ELSE 1.0 END AS s{i}' for i in ix)} FROM {source} GROUP BY 1)",
           f"{tag}z AS MATERIALIZED (SELECT cell, y, w, {', '.join(f'(f{i} - m{i}) / s{i} AS z{i}' for i in ix)} FROM {source} JOIN {tag}s USING (cell))",
           f"{tag}0 AS MATERIALIZED (SELECT cell, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(n))} FROM {tag}s)"]
    score = " + ".join(f"b{i} * {z[i]}" for i in range(n))
    for step in range(NEWTON_STEPS):
        hess = [f"sum(w * p * (1 - p) * {z[i]} * {z[j]}){' + 1.0' if i == j and i else ''} AS a{i}{j}" for i in range(n) for j in range(n)]
        grad = [f"-(sum(w * (p - y) * {z[i]}){f' + any_value(b{i})' if i else ''}) AS r{i}" for i in range(n)]
        sums = f"(SELECT cell, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(n))}, {', '.join(hess + grad)} FROM (SELECT *, {_sig(f'({score})')} AS p FROM {tag}z JOIN {tag}{step} USING (cell)) GROUP BY 1)"
        out.append(f"{tag}{step + 1} AS MATERIALIZED (SELECT cell, {', '.join(f'b{i} + x{i} AS b{i}' for i in range(n))} FROM {_solved(n, sums)})")
    raw = ", ".join(f"b{i + 1} / s{i} AS c{i}" for i in ix)
    icept = "b0" + "".join(f" - b{i + 1} * m{i} / s{i}" for i in ix)
    out.append(f"{tag}fit AS MATERIALIZED (SELECT cell, {raw}, {icept} AS icept FROM {tag}{NEWTON_STEPS} JOIN {tag}s USING (cell))")
    return ",\n".join(out)


_F = ", ".join(f"f.{c} AS f{i}" for i, c in enumerate(_X))
SAMPLED = f"""sampled AS MATERIALIZED (SELECT t.ticker, t.origin_date, k AS fold, y_direction AS y, {_F},
    CASE WHEN target_date <= make_date(k - 1, 12, 31) THEN 'train' WHEN year(origin_date) = k AND year(target_date) = k THEN 'val' END AS split
  FROM targets t JOIN feats f ON f.ticker = t.ticker AND f.date = t.origin_date CROSS JOIN (VALUES (1998), (1999), (2000)) v(k)
  WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL)"""
_SCORE = _sig("(icept + c0 * f0 + c1 * f1 + c2 * f2)")


@query("screen_logistic", S.with_(*S.features(_X), S.TARGETS_OWN, SAMPLED) + f""",
lt AS (SELECT fold AS cell, y, 1.0::DOUBLE AS w, f0, f1, f2 FROM sampled WHERE split = 'train'), {newton_sql('lt')}
SELECT 'Y' || fold AS fold, ticker, origin_date, CAST(y AS BIGINT) AS y_true, {S.r6(_SCORE, 4)} AS p_up FROM sampled JOIN nwfit ON cell = fold WHERE split = 'val'""")
def _(spark, sf):
    return tidy(_screened(spark, sf, "logistic").select("fold", "ticker", "origin_date", "y_true", "p_up"), 4)


@query("screen_boosted")
def _(spark, sf):
    scored = frozen(_screened(spark, sf, "boosted"))
    return tidy(roc_auc(scored, ["fold"]).join(direction_scores(scored, ["fold"]), "fold"), 4)


@query("screen_forest")
def _(spark, sf):
    scored = frozen(_screened(spark, sf, "forest"))
    return tidy(roc_auc(scored, ["fold"]).join(direction_scores(scored, ["fold"]), "fold"), 4)


@query("screen_components")
def _(spark, sf):
    return tidy(reduce(DataFrame.unionByName, [
        md.principal_components(train, _X, 2).withColumn("fold", F.lit(fold)) for fold, train, _val in _by_fold(spark, sf)]))


@query("permutation_importance")
def _(spark, sf):
    return tidy(reduce(DataFrame.unionByName, [
        md.permutation_importance(md.fit_screen(train, _X, "logistic"), val, _X, 5).withColumn("fold", F.lit(fold))
        for fold, train, val in _by_fold(spark, sf)]), 4)


@query("screen_grid_scores")
def _(spark, sf):
    fits = [{"model": m, "family": f, "fold": y} for m in ("logistic", "boosted") for f in ("X0", "X1") for y in _FOLDS]
    cells = ["model", "family", "fold"]
    scored = frozen(md.screen_grid(_samples(spark, sf), fits, {"X0": _X[:1], "X1": _X}))
    return tidy(direction_scores(scored, cells).join(roc_auc(scored, cells), cells), 4)


GRID = f"""gbase AS (SELECT t.ticker, t.origin_date, target_end_date, horizon, y, {_F} FROM htargets t JOIN feats f ON f.ticker = t.ticker AND f.date = t.origin_date),
gplaced AS (SELECT *, CASE WHEN target_end_date <= make_date(k - 1, 12, 31) THEN 'train' WHEN year(origin_date) = k AND year(target_end_date) = k THEN 'val' END AS split
  FROM gbase CROSS JOIN (VALUES (1998), (1999), (2000)) v(k)),
gcells AS MATERIALIZED (SELECT horizon || '|' || k || '|' || family || '|' || sview || '|' || model AS cell, horizon, k AS fold, family, sview, model, split, ticker, origin_date, y,
    f0, CASE WHEN family = 'X1' THEN f1 ELSE 0.0 END AS f1, CASE WHEN family = 'X1' THEN f2 ELSE 0.0 END AS f2
  FROM gplaced CROSS JOIN (VALUES ('X0'), ('X1')) a(family) CROSS JOIN (VALUES ('natural'), ('common')) b(sview) CROSS JOIN (VALUES ('logistic'), ('balanced'), ('majority')) c(model)
  WHERE split IS NOT NULL AND f0 IS NOT NULL AND ((family = 'X0' AND sview = 'natural') OR (f1 IS NOT NULL AND f2 IS NOT NULL))),
gcount AS MATERIALIZED (SELECT cell, count(*) AS n_train, sum(y) AS ups FROM gcells WHERE split = 'train' GROUP BY 1),
gt AS (SELECT cell, y, CASE WHEN model = 'logistic' THEN 1.0::DOUBLE WHEN y = 1 THEN n_train / (2.0::DOUBLE * ups) ELSE n_train / (2.0::DOUBLE * (n_train - ups)) END AS w, f0, f1, f2
  FROM gcells JOIN gcount USING (cell) WHERE split = 'train' AND model <> 'majority'), {newton_sql('gt')},
gscored AS MATERIALIZED (SELECT g.*, n_train, CASE WHEN model = 'majority' THEN ups / n_train ELSE {_SCORE} END AS p FROM gcells g JOIN gcount USING (cell) LEFT JOIN nwfit USING (cell) WHERE split = 'val'),
gauc AS (SELECT cell, sum(CASE WHEN y = 1 THEN below + ties / 2.0 END) / (sum(y) * sum(1 - y)) AS roc_auc FROM (
  SELECT *, sum(1 - y) OVER (PARTITION BY cell ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(1 - y) OVER (PARTITION BY cell, p) AS below, sum(1 - y) OVER (PARTITION BY cell, p) AS ties FROM gscored) GROUP BY 1),
gscores AS (SELECT cell, any_value(horizon) AS horizon, any_value(fold) AS fold, any_value(family) AS family, any_value(sview) AS sview, any_value(model) AS model, any_value(n_train) AS n_train, count(*) AS n,
    avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS accuracy, (avg(CASE WHEN y = 1 THEN CAST(p >= 0.5 AS INTEGER) END) + avg(CASE WHEN y = 0 THEN CAST(p < 0.5 AS INTEGER) END)) / 2 AS balanced_accuracy, avg((p - y) * (p - y)) AS brier
  FROM gscored GROUP BY 1)"""
_GRID_KEYS = ["model", "family", "view", "horizon", "fold"]


@query("screen_grid_axes", S.with_(*S.features(_X), S.horizon_targets()) + f""", {GRID},
gall AS (SELECT * FROM gscores JOIN gauc USING (cell))
SELECT a.model, a.family, a.sview AS view, CAST(a.horizon AS BIGINT) AS horizon, 'Y' || a.fold AS fold, a.n_train, a.n, {S.r6('a.accuracy', 4)} AS accuracy, {S.r6('a.balanced_accuracy', 4)} AS balanced_accuracy,
  {S.r6('a.brier', 4)} AS brier, {S.r6('a.roc_auc', 4)} AS roc_auc, {S.r6('a.roc_auc - o.roc_auc', 4)} AS incremental_auc
FROM gall a JOIN gall o ON o.model = a.model AND o.sview = a.sview AND o.horizon = a.horizon AND o.fold = a.fold AND o.family = 'X0'""")
def _(spark, sf):
    """Every model, family, horizon, fold and sample view in one fit and one scoring."""
    bars = views.bars(spark, sf)
    labels = targets.horizon_targets(bars).select("ticker", "origin_date", F.col("target_end_date").alias("target_date"), "horizon",
                                                  F.col("y").alias("y_true"))
    samples = frozen(smp.origin_snapshot(splits.assign_folds(labels, assemble.FOLDS), pf.panel_features(bars, _X), _X))
    train, val = samples.where(F.col("split") == "train"), samples.where(F.col("split") == "val")
    every = reduce(lambda a, c: a & F.col(c).isNotNull(), _X, F.lit(True))
    families = {"X0": (_X[0],), "X1": tuple(_X)}
    variants = [grid.Variant({"model": m, "family": f, "view": v}, cols, every if v == "common" else None, m == "balanced")
                for m in ("logistic", "balanced") for f, cols in families.items() for v in ("natural", "common")]
    fitted = grid.fit_grid(train, ["horizon", "fold"], variants)
    constant = grid.constant_grid(fitted.where(F.col("model") == "logistic"), "majority")
    plain = [grid.Variant({**v.names, "model": "majority"}, v.columns, v.rows) for v in variants if not v.balanced]
    scored = frozen(grid.score_grid(val, fitted.unionByName(constant), ["horizon", "fold"], variants + plain))
    scores = direction_scores(scored, _GRID_KEYS).join(roc_auc(scored, _GRID_KEYS), _GRID_KEYS).join(
        fitted.unionByName(constant).select(*_GRID_KEYS, "n_train"), _GRID_KEYS)
    scores = frozen(scores)
    base = scores.where(F.col("family") == "X0").select("model", "view", "horizon", "fold", F.col("roc_auc").alias("_x0"))
    return tidy(scores.join(base, ["model", "view", "horizon", "fold"]).withColumn("incremental_auc", F.col("roc_auc") - F.col("_x0"))
                .select(*_GRID_KEYS, "n_train", "n", "accuracy", "balanced_accuracy", "brier", "roc_auc", "incremental_auc"), 4)


# ---- decisions -------------------------------------------------------------

_ATR = f"snap AS (SELECT s.ticker, s.date, s.close, CASE WHEN s.rn >= 14 THEN trw END AS atr FROM steps s JOIN emas e ON e.ticker = s.ticker AND e.rn = s.rn)"
DECIDED = f"""dec0 AS (SELECT p.*, close, greatest(atr, 1e-8) AS atr, CASE WHEN p_up >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction, CASE WHEN p_up >= 0.5 THEN p_up ELSE 1 - p_up END AS confidence
  FROM preds p JOIN snap s ON s.ticker = p.ticker AND s.date = p.origin_date WHERE atr > 0),
dec1 AS (SELECT *, CASE WHEN confidence > 0.8 THEN 'HIGH' WHEN confidence > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, CASE WHEN confidence > 0.8 THEN 0.8::DOUBLE WHEN confidence > 0.6 THEN 1.0 ELSE 1.2 END AS lambda_sl,
  CASE WHEN confidence > 0.8 THEN 1.5::DOUBLE WHEN confidence > 0.6 THEN 1.0 ELSE 0.8 END AS lambda_tp, CASE WHEN direction = 'UP' THEN 1 ELSE -1 END AS sg FROM dec0),
dec2 AS (SELECT *, close - sg * lambda_sl * atr AS stop_loss, close + sg * lambda_tp * atr AS take_profit FROM dec1)"""
DEC = S.with_(*S.PREDICTIONS, S.EMAS, _ATR, DECIDED)


def _decisions(spark, sf):
    snapshot = base.base_features(views.bars(spark, sf), ["atr_14"]).select("ticker", F.col("date").alias("origin_date"), "close", "atr_14")
    return dec.risk_decisions(assemble.predictions(spark, sf), snapshot)


@query("risk_decisions", DEC + f"""
SELECT ticker, origin_date, direction, {S.r6('confidence')} AS confidence, confidence_level, lambda_sl, lambda_tp, {S.px('stop_loss')} AS stop_loss, {S.px('take_profit')} AS take_profit,
  {S.r6('abs(take_profit - close) / greatest(abs(close - stop_loss), 1e-8)')} AS rrr, {S.r6('confidence / atr', 9)} AS risk_score, 'direction=' || direction || ';confidence_level=' || confidence_level || ';lambda_SL=' || lambda_sl || ';lambda_tp=' || lambda_tp AS codes FROM dec2""")
def _(spark, sf):
    from ..functions.numeric import rounded
    out = _decisions(spark, sf).withColumns({"codes": F.array_join("reason_codes", ";"), "risk_score": rounded(F.col("risk_score"), 9)})
    cols = ["ticker", "origin_date", "direction", "confidence", "confidence_level", "lambda_sl", "lambda_tp", "stop_loss", "take_profit", "rrr", "risk_score", "codes"]
    return tidy(out.select(*cols), prices=("stop_loss", "take_profit"), exact=("risk_score",))


@query("latest_predictions", P + f"SELECT ticker, origin_date, fold, {S.r6('p_up')} AS p_up, CASE WHEN p_up >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction FROM preds QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY origin_date DESC) = 1")
def _(spark, sf):
    pred = dec.assemble_predictions(assemble.predictions(spark, sf), "p_up")
    return tidy(dec.latest_per_ticker(pred.select("ticker", "origin_date", "fold", "p_up", "direction")))


_ATTR = ["log_return_1", "log_return_5", "realized_vol_20", "drawdown_20"]


def _attributions(spark, sf):
    feats = spread(pf.panel_features(views.bars(spark, sf), _ATTR).select("ticker", F.col("date").alias("origin_date"), *_ATTR),
                   ["ticker", "origin_date"])
    return feats.select("ticker", "origin_date", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in _ATTR]))).where(F.col("value").isNotNull())


ATTR = "attr AS (" + " UNION ALL ".join(f"SELECT ticker, date AS origin_date, '{c}' AS feature, {c} AS value FROM feats WHERE {c} IS NOT NULL" for c in _ATTR) + ")"


@query("mean_attributions", S.with_(*S.features(_ATTR), ATTR) + f"""
SELECT ticker, feature, {S.r6('mean_abs')} AS mean_abs, place FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY mean_abs DESC, feature) AS place FROM (SELECT ticker, feature, avg(abs(value)) AS mean_abs FROM attr GROUP BY 1, 2)) WHERE place <= 3""")
def _(spark, sf):
    return tidy(dec.mean_attributions(_attributions(spark, sf), ["ticker"], 3))


@query("reason_text", S.with_(*S.features(["log_return_1", "log_return_5", "realized_vol_20", "drawdown_20"]), S.TARGETS_OWN, S.PRED, S.EMAS, _ATR, DECIDED, ATTR) + f""",
tp AS (SELECT *, row_number() OVER (PARTITION BY ticker, origin_date ORDER BY abs(value) DESC, feature) AS place FROM attr),
ls AS (SELECT ticker, origin_date, string_agg(feature || ' (|attribution|=' || printf('%.4f', abs(value)) || ')', ', ' ORDER BY place) AS l FROM tp WHERE place <= 3 GROUP BY 1, 2)
SELECT d.ticker, d.origin_date, CASE WHEN l IS NULL THEN 'No dominant features identified.' ELSE d.ticker || ' on ' || d.origin_date || ': ' || direction || ' with confidence ' || printf('%.1f', confidence * 100) || '%. The prediction is primarily driven by ' || l || '.' END AS reason
FROM dec2 d LEFT JOIN ls ON ls.ticker = d.ticker AND ls.origin_date = d.origin_date""")
def _(spark, sf):
    top = dec.mean_attributions(_attributions(spark, sf), ["ticker", "origin_date"], 3)
    return dec.reason_text(_decisions(spark, sf), top).select("ticker", "origin_date", "reason")


# ---- stored tables ---------------------------------------------------------

def _folder(spark, name: str) -> str:
    """A fresh folder beside the checkpoints, in the storage that the cluster names."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _store(spark, sf):
    """A store written from the bars and loaded again."""
    root, names = _folder(spark, "store"), ["log_return_1", "log_return_5", "drawdown_20", "volume_z_20"]
    # Nothing needs the bars after the store is written.
    with passing_table(views.bars(spark, sf)) as bars:
        # Four of the tables are made of these rows.
        stock = frozen(pf.panel_features(bars, names))
        panel = stock.select("ticker", "date", "log_return_1", "volume_z_20")
        store.write_store({
            "stock_features": stock, "market_context": cs.market_by_date(panel),
            "sector_context": cs.add_sector_context(panel, views.sector_map(spark, sf)),
            "cross_sectional_features": cs.add_ranks(panel, ("log_return_1",)),
            "targets": targets.next_day_targets(bars, calendar="own")}, root, {"source": "lineitem"})
    return store.load_store(spark, root)


@query("feature_store", S.with_(*S.features(["log_return_5", "drawdown_20", "volume_z_20"]))
       + f"SELECT ticker, date, {S.r6('log_return_5')} AS log_return_5, {S.r6('drawdown_20')} AS drawdown_20, {S.r6('volume_z_20')} AS volume_z_20 FROM feats")
def _(spark, sf):
    return tidy(_store(spark, sf)["stock_features"].drop("log_return_1"))


@query("feature_store_panel", S.with_(*S.features(["log_return_1", "drawdown_20"]), S.SECTORS, S.TARGETS_OWN) + f""",
mk AS (SELECT date, avg(log_return_1) AS m FROM feats WHERE log_return_1 IS NOT NULL GROUP BY 1)
SELECT f.ticker, f.date, {S.r6('f.drawdown_20')} AS drawdown_20, coalesce(sector, 'UNKNOWN') AS sector, {S.r6(S.avg_rank('f.log_return_1', 'f.date'))} AS rank_log_return_1,
  CAST(y_direction AS BIGINT) AS y_direction, {S.r6('m')} AS market_return_mean
FROM feats f LEFT JOIN sectors s ON s.ticker = f.ticker LEFT JOIN targets t ON t.ticker = f.ticker AND t.origin_date = f.date LEFT JOIN mk ON mk.date = f.date""")
def _(spark, sf):
    return tidy(store.store_panel(_store(spark, sf)).select(
        "ticker", "date", "drawdown_20", "sector", "rank_log_return_1", "y_direction", "market_return_mean"))


@query("horizon_target_cache", S.with_(S.BARS, S.horizon_targets(boundary="2000-12-31"))
       + f"SELECT ticker, origin_date, target_end_date, CAST(horizon AS BIGINT) AS horizon, {S.r6('future_log_return')} AS future_log_return, CAST(y AS BIGINT) AS y FROM htargets")
def _(spark, sf):
    path = _folder(spark, "targets")
    store.write_targets(targets.horizon_targets(views.bars(spark, sf), boundary="2000-12-31"), path)
    return tidy(store.load_targets(spark, path, "2000-12-31").drop("close_t", "close_t_plus_h"))


LEDGER_COLUMNS = ("experiment_id", "variant", "fold", "seed", "best_epoch", "validation_accuracy", "test_evaluated")


@query("experiment_ledger", P + """
SELECT count(*) AS total_experiments, CAST(1 AS BIGINT) AS variants, count(DISTINCT fold) AS folds, CAST(2 AS BIGINT) AS seeds, CAST(0 AS BIGINT) AS forbidden_claims, max(CAST(n % 11 AS BIGINT)) AS max_best_epoch
FROM (SELECT ticker, fold, s, count(*) AS n FROM preds, (VALUES (11), (42)) v(s) GROUP BY 1, 2, 3)""")
def _(spark, sf):
    runs = assemble.predictions(spark, sf).groupBy("ticker", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(((F.col("p_up") >= 0.5) == (F.col("y_true") == 1)).cast("double")).alias("validation_accuracy"))
    path = _folder(spark, "ledger")
    for seed in (11, 42):
        rows = runs.select(F.concat_ws("-", "ticker", "fold", F.lit(seed)).alias("experiment_id"), F.lit("MOMENTUM").alias("variant"), "fold",
                           F.lit(seed).alias("seed"), (F.col("n") % 11).alias("best_epoch"), "validation_accuracy", F.lit("no").alias("test_evaluated"))
        store.append_ledger(rows, path, LEDGER_COLUMNS, ("test_evaluated",))
    return tidy(store.ledger_summary(store.read_ledger(spark, path), "test_evaluated"))


@query("report_tables", P + f"SELECT ticker, fold, count(*) AS n, {S.r6('avg(p_up)')} AS mean_p FROM preds GROUP BY 1, 2")
def _(spark, sf):
    rows = tidy(assemble.predictions(spark, sf).groupBy("ticker", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("p_up").alias("mean_p")))
    kinds = "ticker string, fold bigint, n bigint, mean_p double"
    a, b = _folder(spark, "csv"), _folder(spark, "json")
    store.write_report(rows, a, "csv")
    store.write_report(spark.read.schema(kinds).option("header", True).csv(a), b, "json")
    return spark.read.schema(kinds).json(b)


@query("file_manifest")
def _(spark, sf):
    return store.file_manifest(spark, sf)


@query("file_manifest_fingerprint")
def _(spark, sf):
    return store.manifest_hash(store.file_manifest(spark, sf))
