"""Evaluation of predictions and decisions over score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as bs
from ..operators import gates as g
from ..operators import metrics as m
from ..operators import panel_features as pf
from ..plans import assemble, views
from ..plans.skew import frozen
from . import sql as S
from .quality import FOLDS_SQL
from .registry import ORACLES, query
from .tidy import tidy

P = S.with_(*S.PREDICTIONS)
H = "p_up >= 0.5"
CONF = f"""count(*) FILTER ({H} AND y_true = 1) AS tp, count(*) FILTER ({H} AND y_true = 0) AS fp,
  count(*) FILTER (NOT ({H}) AND y_true = 0) AS tn, count(*) FILTER (NOT ({H}) AND y_true = 1) AS fn"""
ACC = "(tp + tn) / nullif(tp + tn + fp + fn, 0)"
F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"
BAL = "(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2"
CELL = ["fold"]
HIT = "CAST((p_up >= 0.5) = (y_true = 1) AS INTEGER)"


def _p(spark, sf):
    return assemble.predictions(spark, sf)


@query("predictions", P + f"""SELECT ticker, origin_date, target_date, fold, CAST(y_true AS BIGINT) AS y_true, {S.r6('p_up')} AS p_up,
  {S.r6('future_log_return')} AS future_log_return FROM preds""")
def _(spark, sf):
    return tidy(_p(spark, sf))


@query("direction_scores", P + f""",
s AS (SELECT fold, count(*) AS n, count(DISTINCT ticker) AS n_tickers, {CONF}, avg((p_up - y_true) * (p_up - y_true)) AS b, avg(y_true) AS pr,
  avg(abs(p_up - 0.5)) AS mc FROM preds GROUP BY 1)
SELECT fold, n, n_tickers, {S.r6(ACC)} AS accuracy, {S.r6(F1)} AS f1, {S.r6(BAL)} AS balanced_accuracy, {S.r6('b')} AS brier,
  {S.r6('pr')} AS positive_rate, {S.r6('mc')} AS mean_confidence FROM s""")
def _(spark, sf):
    return tidy(m.direction_scores(_p(spark, sf), CELL))


AUC = """aucs AS (SELECT fold, sum(CASE WHEN y_true = 1 THEN below + ties / 2.0 END) / (sum(y_true) * sum(1 - y_true)) AS roc_auc FROM (
  SELECT *, sum(1 - y_true) OVER (PARTITION BY fold ORDER BY p_up RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(1 - y_true) OVER (PARTITION BY fold, p_up) AS below, sum(1 - y_true) OVER (PARTITION BY fold, p_up) AS ties FROM preds) GROUP BY 1)"""


@query("roc_auc", P + f", {AUC} SELECT fold, {S.r6('roc_auc')} AS roc_auc FROM aucs")
def _(spark, sf):
    return tidy(m.roc_auc(_p(spark, sf), CELL))


BINNED = "binned AS (SELECT *, " + " + ".join(f"CAST(p_up >= {i}::DOUBLE * 0.1::DOUBLE AS INTEGER)" for i in range(1, 10)) + " AS bin FROM preds)"


@query("reliability_table", P + f""", {BINNED}
SELECT fold, CAST(bin AS BIGINT) AS bin, count(*) AS n, {S.r6('avg(p_up)')} AS mean_probability, {S.r6('avg(y_true)')} AS mean_outcome FROM binned GROUP BY fold, bin""")
def _(spark, sf):
    return tidy(m.reliability(_p(spark, sf), CELL))


ECE = f"""{BINNED}, rel AS (SELECT fold, bin, count(*) AS n, avg(p_up) AS mp, avg(y_true) AS mo FROM binned GROUP BY 1, 2),
eces AS (SELECT fold, sum(n * abs(mp - mo)) / sum(n) AS ece FROM rel GROUP BY 1)"""


@query("calibration_error", P + f", {ECE} SELECT fold, {S.r6('ece')} AS ece FROM eces")
def _(spark, sf):
    return tidy(m.calibration_error(_p(spark, sf), CELL))


@query("confusion_matrix", P + f"""SELECT fold, CAST(y_true AS BIGINT) AS y_true, CAST({H} AS BIGINT) AS predicted, count(*) AS n FROM preds GROUP BY ALL""")
def _(spark, sf):
    return tidy(m.confusion(_p(spark, sf), CELL))


@query("ticker_accuracy", P + f"SELECT fold, ticker, count(*) AS n, {S.r6(f'avg({HIT})')} AS accuracy, {S.r6('avg(y_true)')} AS positive_rate FROM preds GROUP BY 1, 2")
def _(spark, sf):
    return tidy(m.ticker_accuracy(_p(spark, sf), CELL))


@query("macro_ticker_accuracy", P + f"SELECT fold, {S.r6('avg(a)')} AS macro_ticker_accuracy FROM (SELECT fold, ticker, avg({HIT}) AS a FROM preds GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    return tidy(m.macro_accuracy(_p(spark, sf), CELL))


TRAIN = """train AS (SELECT t.ticker, t.y_direction AS y_true, CAST(substr(f.fold, 2) AS BIGINT) AS fold FROM targets t JOIN folds f
  ON f.split = 'train' AND origin_date BETWEEN lo AND hi AND target_date BETWEEN lo AND hi)"""
PT = S.with_(*S.PREDICTIONS, FOLDS_SQL, TRAIN)


@query("majority_baselines", PT + f""",
t AS (SELECT fold, avg(y_true) AS t, count(*) AS n_train FROM train GROUP BY 1), v AS (SELECT fold, avg(y_true) AS v, count(*) AS n_validation FROM preds GROUP BY 1)
SELECT fold, n_train, n_validation, {S.r6('greatest(t, 1 - t)')} AS train_majority_share,
  {S.r6('CASE WHEN t >= 0.5 THEN v ELSE 1 - v END')} AS train_majority_on_validation, {S.r6('greatest(v, 1 - v)')} AS validation_oracle_rate FROM t JOIN v USING (fold)""")
def _(spark, sf):
    return tidy(m.majority_baselines(assemble.training_labels(spark, sf), _p(spark, sf), CELL))


ENDS = """ends AS (
  SELECT *, 'up' AS side, CAST(y_true = 1 AS INTEGER) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY fold, target_date ORDER BY p_up DESC, ticker) AS r,
    count(*) OVER (PARTITION BY fold, target_date) AS na FROM preds) WHERE r <= 3
  UNION ALL SELECT *, 'down', CAST(y_true = 0 AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY fold, target_date ORDER BY p_up, ticker) AS r,
    count(*) OVER (PARTITION BY fold, target_date) AS na FROM preds) WHERE r <= 3),
sel AS (SELECT fold, target_date, any_value(na) AS n_available, avg(ok) FILTER (side = 'up') AS up_precision, avg(ok) FILTER (side = 'down') AS down_precision,
  string_agg(ticker, ',' ORDER BY r) FILTER (side = 'up') AS up_tickers, string_agg(ticker, ',' ORDER BY r) FILTER (side = 'down') AS down_tickers
  FROM ends GROUP BY 1, 2 HAVING any_value(na) >= 3)"""


@query("selections_at_3", P + f", {ENDS} SELECT fold, target_date, n_available, {S.r6('up_precision')} AS up_precision, {S.r6('down_precision')} AS down_precision, up_tickers, down_tickers FROM sel")
def _(spark, sf):
    return tidy(m.selections_at_k(_p(spark, sf), CELL))


@query("precision_at_3", P + f", {ENDS} SELECT fold, {S.r6('avg(up_precision)')} AS precision_at_3_up, {S.r6('avg(down_precision)')} AS precision_at_3_down, count(*) AS n_dates FROM sel GROUP BY 1")
def _(spark, sf):
    return tidy(m.precision_at_k(_p(spark, sf), CELL))


@query("precision_at_3_pooled", P + f", {ENDS} SELECT fold, {S.r6('''avg(ok) FILTER (side = 'up')''')} AS precision_at_3_up, {S.r6('''avg(ok) FILTER (side = 'down')''')} AS precision_at_3_down FROM ends GROUP BY 1")
def _(spark, sf):
    return tidy(m.pooled_precision_at_k(_p(spark, sf), CELL))


CURVE = f"""lv AS (SELECT unnest([1.0::DOUBLE, 0.75, 0.5, 0.3, 0.2, 0.1]) AS level),
o AS (SELECT *, abs(p_up - 0.5) AS c, row_number() OVER (PARTITION BY fold ORDER BY abs(p_up - 0.5) DESC, ticker, origin_date) AS rn, count(*) OVER (PARTITION BY fold) AS nn FROM preds),
cv AS (SELECT fold, level AS coverage_target, count(*) AS n, any_value(nn) AS nn, count(DISTINCT ticker) AS n_tickers, avg(c) AS mean_confidence, {CONF}
  FROM o JOIN lv ON rn <= greatest(CAST(round_even(level * nn, 0) AS BIGINT), 1) GROUP BY 1, 2),
curve AS (SELECT *, n / nn AS coverage_retained, {ACC} AS accuracy FROM cv)"""


@query("coverage_curve", P + f""", {CURVE} SELECT fold, coverage_target, n, {S.r6('coverage_retained')} AS coverage_retained, {S.r6('accuracy')} AS accuracy,
  {S.r6(BAL)} AS balanced_accuracy, {S.r6(F1)} AS f1, n_tickers, {S.r6('mean_confidence')} AS mean_confidence FROM curve""")
def _(spark, sf):
    return tidy(m.coverage_curve(_p(spark, sf), CELL))


_AT = 0.62
ATACC = f"""at0 AS (SELECT fold, {_AT}::DOUBLE AS threshold, max(accuracy) AS max_accuracy_seen,
  max(row(coverage_retained, accuracy, coverage_target, n)) FILTER (accuracy >= {_AT} AND n >= 200 AND coverage_retained >= 0.1) AS b FROM curve GROUP BY 1),
at_acc AS (SELECT fold, threshold, struct_extract(b, 3) AS coverage_target, struct_extract(b, 1) AS coverage, struct_extract(b, 2) AS accuracy, struct_extract(b, 4) AS n, max_accuracy_seen,
  CASE WHEN b IS NOT NULL THEN 'ESTABLISHED' ELSE 'NOT_ESTABLISHED' END AS status FROM at0)"""


@query("coverage_at_accuracy", P + f""", {CURVE}, {ATACC} SELECT fold, threshold, {S.r6('coverage_target')} AS coverage_target, {S.r6('coverage')} AS coverage,
  {S.r6('accuracy')} AS accuracy, n, {S.r6('max_accuracy_seen')} AS max_accuracy_seen, status FROM at_acc""")
def _(spark, sf):
    return tidy(m.coverage_at_accuracy(m.coverage_curve(_p(spark, sf), CELL), CELL, _AT))


@query("coverage_across_folds", P + f""", {CURVE}, {ATACC} SELECT 'momentum' AS model, threshold, {S.r6('CASE WHEN count(coverage) = 3 THEN avg(coverage) END')} AS coverage_mean,
  {S.r6('CASE WHEN count(coverage) = 3 THEN avg(accuracy) END')} AS accuracy_mean FROM at_acc GROUP BY threshold""")
def _(spark, sf):
    points = m.coverage_at_accuracy(m.coverage_curve(_p(spark, sf), CELL), CELL, _AT).withColumn("model", F.lit("momentum"))
    return tidy(m.coverage_across_folds(points, ["model"], 3))


@query("confidence_floors", P + f""",
fl AS (SELECT unnest([0.0::DOUBLE, 0.55, 0.6, 0.7, 0.8]) AS threshold),
s AS (SELECT fold, threshold, count(*) FILTER (greatest(p_up, 1 - p_up) >= threshold) AS n, count(*) AS al,
  count(*) FILTER (greatest(p_up, 1 - p_up) >= threshold AND {H} AND y_true = 1) AS tp, count(*) FILTER (greatest(p_up, 1 - p_up) >= threshold AND {H} AND y_true = 0) AS fp,
  count(*) FILTER (greatest(p_up, 1 - p_up) >= threshold AND NOT ({H}) AND y_true = 0) AS tn, count(*) FILTER (greatest(p_up, 1 - p_up) >= threshold AND NOT ({H}) AND y_true = 1) AS fn
  FROM preds, fl GROUP BY 1, 2)
SELECT fold, threshold, n, {S.r6('n / al * 100')} AS retained_pct, {S.r6(ACC)} AS accuracy, {S.r6(f'CASE WHEN n > 0 THEN {F1} END')} AS f1 FROM s""")
def _(spark, sf):
    return tidy(m.confidence_floors(_p(spark, sf), CELL))


@query("aggregation_conventions", P + f""",
pf AS (SELECT *, {ACC} AS a, {F1} AS f FROM (SELECT fold, count(*) AS n, {CONF} FROM preds GROUP BY 1)),
al AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn FROM pf)
SELECT 'micro' AS convention, {S.r6(ACC)} AS accuracy, {S.r6(F1)} AS f1, tp + fp + tn + fn AS n_units FROM al
UNION ALL SELECT 'equal_fold_average', {S.r6('avg(a)')}, {S.r6('avg(f)')}, count(*) FROM pf
UNION ALL SELECT 'sample_weighted_fold_average', {S.r6('sum(a * n) / sum(n)')}, {S.r6('sum(f * n) / sum(n)')}, count(*) FROM pf
UNION ALL SELECT 'macro_ticker', {S.r6('avg(a)')}, NULL, count(*) FROM (SELECT ticker, avg({HIT}) AS a FROM preds GROUP BY 1)
UNION ALL SELECT 'macro_date', {S.r6('avg(a)')}, NULL, count(*) FROM (SELECT target_date, avg({HIT}) AS a FROM preds GROUP BY 1)""")
def _(spark, sf):
    return tidy(m.aggregation_conventions(_p(spark, sf)))


BREADTH = f"""breadth AS (SELECT a.*, greatest(b.t, 1 - b.t) AS baseline, a.accuracy > greatest(b.t, 1 - b.t) AS beats FROM
  (SELECT fold, ticker, count(*) AS n, avg({HIT}) AS accuracy FROM preds GROUP BY 1, 2) a
  LEFT JOIN (SELECT fold, ticker, avg(y_true) AS t FROM train GROUP BY 1, 2) b ON b.fold = a.fold AND b.ticker = a.ticker)"""


def _breadth(spark, sf):
    return m.ticker_breadth(_p(spark, sf), assemble.training_labels(spark, sf), CELL)


@query("ticker_breadth", PT + f", {BREADTH} SELECT fold, ticker, n, {S.r6('accuracy')} AS accuracy, {S.r6('baseline')} AS baseline, beats FROM breadth")
def _(spark, sf):
    return tidy(_breadth(spark, sf))


@query("ticker_breadth_summary", PT + f""", {BREADTH} SELECT fold, count(*) AS n_tickers, count(*) FILTER (beats) AS n_beating, {S.r6('avg(CAST(beats AS INTEGER))')} AS fraction_beating,
  {S.r6('quantile_cont(accuracy, 0.25)')} AS p25_accuracy, {S.r6('median(accuracy)')} AS median_accuracy, {S.r6('quantile_cont(accuracy, 0.75)')} AS p75_accuracy FROM breadth GROUP BY 1""")
def _(spark, sf):
    return tidy(m.breadth_summary(_breadth(spark, sf), CELL))


@query("ticker_extremes", PT + f""", {BREADTH}
SELECT * FROM (SELECT fold, ticker, {S.r6('accuracy')} AS accuracy, row_number() OVER (PARTITION BY fold ORDER BY accuracy DESC, ticker) AS place, 'best' AS "end" FROM breadth) WHERE place <= 5
UNION ALL SELECT * FROM (SELECT fold, ticker, {S.r6('accuracy')} AS accuracy, row_number() OVER (PARTITION BY fold ORDER BY accuracy, ticker) AS place, 'worst' AS "end" FROM breadth) WHERE place <= 5""")
def _(spark, sf):
    return tidy(m.breadth_extremes(_breadth(spark, sf), CELL).select("fold", "ticker", "accuracy", "place", "end"))


@query("return_magnitude", P + f"""SELECT fold, {S.r6('avg(future_log_return)')} AS future_return_mean, {S.r6('stddev_samp(future_log_return)')} AS future_return_std,
  {S.r6('avg(abs(future_log_return))')} AS abs_future_return_mean, {S.r6('stddev_samp(abs(future_log_return))')} AS abs_future_return_std,
  {S.r6('avg(CAST(future_log_return > 0 AS INTEGER))')} AS up_fraction, {S.r6('median(future_log_return)')} AS future_return_median,
  {S.r6('median(abs(future_log_return))')} AS abs_future_return_median FROM preds GROUP BY 1""")
def _(spark, sf):
    return tidy(m.return_magnitude(_p(spark, sf), CELL))


def _rank(x, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


@query("confidence_vs_magnitude", P + f""",
c AS (SELECT fold, abs(p_up - 0.5) AS c, abs(future_log_return) AS g FROM preds), r AS (SELECT *, {_rank('c', 'fold')} AS rc, {_rank('g', 'fold')} AS rg FROM c)
SELECT fold, count(*) AS n, {S.r6('corr(c, g)')} AS pearson, {S.r6('corr(rc, rg)')} AS spearman FROM r GROUP BY 1""")
def _(spark, sf):
    return tidy(m.confidence_magnitude(_p(spark, sf), CELL))


@query("return_scores", P + f""",
c AS (SELECT fold, (p_up - 0.5) / 10 AS f, future_log_return AS y FROM preds), r AS (SELECT *, {_rank('f', 'fold')} AS rf, {_rank('y', 'fold')} AS ry FROM c)
SELECT fold, count(*) AS n, {S.r6('avg(abs(f - y))')} AS mae, {S.r6('sqrt(avg((f - y) * (f - y)))')} AS rmse, {S.r6('corr(f, y)')} AS pearson, {S.r6('corr(rf, ry)')} AS spearman FROM r GROUP BY 1""")
def _(spark, sf):
    rows = _p(spark, sf).withColumn("forecast", (F.col("p_up") - 0.5) / 10)
    return tidy(m.return_scores(rows, CELL, "forecast", "future_log_return"))


DAILY_IC = f"""r AS (SELECT *, {_rank('p_up', 'fold, target_date')} AS rf, {_rank('future_log_return', 'fold, target_date')} AS ry FROM preds),
ic AS (SELECT fold, target_date, count(*) AS n, CASE WHEN stddev_pop(rf) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rf, ry), 12) + 0.0 END AS rank_ic FROM r GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("daily_rank_ic", P + f", {DAILY_IC} SELECT fold, target_date, n, {S.r6('rank_ic')} AS rank_ic FROM ic")
def _(spark, sf):
    return tidy(m.daily_rank_ic(_p(spark, sf), CELL, "p_up", "future_log_return"))


@query("rank_ic_summary", P + f", {DAILY_IC} SELECT fold, {S.r6('avg(rank_ic)')} AS mean_rank_ic, {S.r6('stddev_samp(rank_ic)')} AS std_rank_ic, count(rank_ic) AS n_days, {S.r6('avg(CAST(rank_ic > 0 AS INTEGER))')} AS positive_fraction FROM ic WHERE rank_ic IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return tidy(m.rank_ic_summary(m.daily_rank_ic(_p(spark, sf), CELL, "p_up", "future_log_return"), CELL))


@query("head_agreement", P + f""",
h AS (SELECT *, p_up >= 0.5 AS a, future_log_return - 0.01 >= 0 AS b, p_up >= 0.6 AS c FROM preds)
SELECT fold, count(*) AS n, count(*) FILTER (a = b AND b = c) AS n_agree, {S.r6('avg(CAST(a = b AND b = c AS INTEGER))')} AS coverage,
  {S.r6('avg(CAST(a = (y_true = 1) AS INTEGER)) FILTER (a = b AND b = c)')} AS accuracy_when_agreeing, {S.r6('avg(CAST(a = (y_true = 1) AS INTEGER))')} AS accuracy_all,
  {S.r6('avg(CAST(a = b AS INTEGER))')} AS direction_vs_return, {S.r6('avg(CAST(a = c AS INTEGER))')} AS direction_vs_rank, {S.r6('avg(CAST(b = c AS INTEGER))')} AS return_vs_rank
FROM h GROUP BY 1""")
def _(spark, sf):
    rows = _p(spark, sf).withColumns({"logit": F.col("p_up") - 0.5, "ret": F.col("future_log_return") - 0.01,
                                      "rank": F.when(F.col("p_up") >= 0.6, 0.6).otherwise(0.4)})
    return tidy(m.head_agreement(rows, CELL, "logit", "ret", "rank"))


BLOCK = f"""sc AS (SELECT fold, count(*) AS n, count(DISTINCT ticker) AS n_tickers, {CONF}, avg((p_up - y_true) * (p_up - y_true)) AS b, avg(y_true) AS pr, avg(abs(p_up - 0.5)) AS mc FROM preds GROUP BY 1),
bl AS (SELECT fold, greatest(avg(y_true), 1 - avg(y_true)) AS base FROM train GROUP BY 1),
br AS (SELECT fold, avg(accuracy) AS macro, count(*) FILTER (beats) AS nb, avg(CAST(beats AS INTEGER)) AS fb FROM breadth GROUP BY 1)"""
_BLOCK_EXPR = {"accuracy": ACC, "f1": F1, "balanced_accuracy": BAL, "brier": "b", "positive_rate": "pr", "mean_confidence": "mc", "roc_auc": "roc_auc", "ece": "ece",
               "macro_ticker_accuracy": "macro", "ticker_fraction_beating_own_baseline": "fb", "train_majority_baseline": "base",
               "baseline_delta": f"{ACC} - base", "macro_baseline_delta": "macro - base"}


@query("direction_block", PT + f", {BREADTH}, {AUC}, {ECE}, {BLOCK} SELECT fold, n, n_tickers, nb AS tickers_beating_own_baseline, "
       + ", ".join(f"{S.r6(e)} AS {c}" for c, e in _BLOCK_EXPR.items())
       + " FROM sc JOIN bl USING (fold) JOIN br USING (fold) JOIN aucs USING (fold) JOIN eces USING (fold)")
def _(spark, sf):
    bars = assemble.stored_bars(spark, sf)
    return tidy(m.direction_block(assemble.predictions(spark, sf, bars=bars), assemble.training_labels(spark, sf, bars), CELL))


@query("direction_block_returns", f"""WITH a AS ({ORACLES['direction_block']}), b AS ({ORACLES['return_magnitude']}),
c AS (SELECT fold, pearson AS confidence_magnitude_pearson, spearman AS confidence_magnitude_spearman FROM ({ORACLES['confidence_vs_magnitude']}))
SELECT * FROM a LEFT JOIN b USING (fold) LEFT JOIN c USING (fold)""")
def _(spark, sf):
    bars = assemble.stored_bars(spark, sf)
    return tidy(m.direction_and_returns(assemble.predictions(spark, sf, bars=bars), assemble.training_labels(spark, sf, bars), CELL))


# ---- bootstrap -------------------------------------------------------------

DRAWS = """days AS (SELECT fold, origin_date, row_number() OVER (PARTITION BY fold ORDER BY origin_date) - 1 AS d, count(*) OVER (PARTITION BY fold) AS nd FROM (SELECT DISTINCT fold, origin_date FROM preds)),
sz AS (SELECT fold, any_value(nd) AS nd FROM days GROUP BY 1 HAVING any_value(nd) >= 21),
bl0 AS (SELECT fold, nd, r, unnest(range(CAST(ceil(nd / 21) AS BIGINT))) AS b FROM (SELECT fold, nd, unnest(range(400)) AS r FROM sz)),
bl1 AS (SELECT *, CAST(floor(CAST('0x' || substr(md5('42|' || fold || '|' || r || '|' || b), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * (nd - 20)) AS BIGINT) AS s, least(21, nd - b * 21) AS len FROM bl0),
dr AS (SELECT fold, r, d, count(*) AS w FROM (SELECT fold, r, unnest(range(s, s + len)) AS d FROM bl1) GROUP BY 1, 2, 3)"""


def _ci(name):
    return (f"{S.r6(f'avg({name})')} AS {name}_mean, {S.r6(f'stddev_samp({name})')} AS {name}_std, {S.r6(f'quantile_cont({name}, 0.025)')} AS {name}_low, "
            f"{S.r6(f'quantile_cont({name}, 0.975)')} AS {name}_high, count({name}) AS {name}_replicates")


@query("block_bootstrap", P + f", {DRAWS}," + f"""
dd AS (SELECT p.fold, d.d, {CONF}, sum((p_up - y_true) * (p_up - y_true)) AS sq FROM preds p JOIN days d ON d.fold = p.fold AND d.origin_date = p.origin_date GROUP BY 1, 2),
rs AS (SELECT dr.fold, r, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * tn) AS tn, sum(w * fn) AS fn, sum(w * sq) AS sq FROM dr JOIN dd ON dd.fold = dr.fold AND dd.d = dr.d GROUP BY 1, 2),
sc AS (SELECT fold, {ACC} AS accuracy, {BAL} AS balanced_accuracy, sq / (tp + fp + tn + fn) AS brier FROM rs)
SELECT fold, {_ci('accuracy')}, {_ci('balanced_accuracy')}, {_ci('brier')} FROM sc GROUP BY 1""")
def _(spark, sf):
    return tidy(bs.block_bootstrap(_p(spark, sf), CELL))


@query("block_bootstrap_auc", P + f", {DRAWS}," + f"""
x AS (SELECT dr.fold, dr.r, p.p_up, sum(w * y_true) AS pos, sum(w * (1 - y_true)) AS neg FROM preds p JOIN days d ON d.fold = p.fold AND d.origin_date = p.origin_date
  JOIN dr ON dr.fold = p.fold AND dr.d = d.d GROUP BY 1, 2, 3),
y AS (SELECT *, sum(neg) OVER (PARTITION BY fold, r ORDER BY p_up) - neg AS below FROM x),
a AS (SELECT fold, r, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM y GROUP BY 1, 2)
SELECT fold, {_ci('roc_auc')} FROM a GROUP BY 1""")
def _(spark, sf):
    return tidy(bs.block_bootstrap_area(_p(spark, sf), CELL))


# ---- score tables ----------------------------------------------------------

HC = ["horizon", "fold"]
HPRED = f"""hpreds AS (
  SELECT t.ticker, t.origin_date, t.target_end_date AS target_date, t.horizon, year(t.origin_date) AS fold, t.y AS y_true, f.p_up, t.future_log_return
  FROM htargets t JOIN (SELECT ticker, date, {S.avg_rank('log_return_5', 'date')} AS p_up FROM feats) f ON f.ticker = t.ticker AND f.date = t.origin_date
  WHERE f.p_up IS NOT NULL AND year(t.origin_date) BETWEEN 1998 AND 2000 AND year(t.target_end_date) = year(t.origin_date))"""
HTRAIN = """htrain AS (SELECT t.ticker, t.horizon, t.y AS y_true, CAST(substr(f.fold, 2) AS BIGINT) AS fold FROM htargets t JOIN folds f
  ON f.split = 'train' AND origin_date BETWEEN lo AND hi AND target_end_date BETWEEN lo AND hi)"""


def hscores(src: str, name: str) -> str:
    """Score block per (horizon, fold) of a prediction CTE."""
    return f"""{name}_sc AS (SELECT horizon, fold, count(*) AS n, {CONF}, avg((p_up - y_true) * (p_up - y_true)) AS brier FROM {src} GROUP BY 1, 2),
{name}_auc AS (SELECT horizon, fold, sum(CASE WHEN y_true = 1 THEN below + ties / 2.0 END) / (sum(y_true) * sum(1 - y_true)) AS roc_auc FROM (
  SELECT *, sum(1 - y_true) OVER (PARTITION BY horizon, fold ORDER BY p_up RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(1 - y_true) OVER (PARTITION BY horizon, fold, p_up) AS below,
    sum(1 - y_true) OVER (PARTITION BY horizon, fold, p_up) AS ties FROM {src}) GROUP BY 1, 2),
{name}_br AS (SELECT a.horizon, a.fold, avg(a.acc) AS macro, avg(CAST(a.acc > greatest(b.t, 1 - b.t) AS INTEGER)) AS fb FROM (SELECT horizon, fold, ticker, avg({HIT}) AS acc FROM {src} GROUP BY 1, 2, 3) a
  LEFT JOIN (SELECT horizon, fold, ticker, avg(y_true) AS t FROM htrain GROUP BY 1, 2, 3) b ON b.horizon = a.horizon AND b.fold = a.fold AND b.ticker = a.ticker GROUP BY 1, 2),
{name} AS (SELECT horizon, fold, n, {ACC} AS accuracy, {BAL} AS balanced_accuracy, brier, roc_auc, macro AS macro_ticker_accuracy, base AS train_majority_baseline, {ACC} - base AS baseline_delta,
  fb AS ticker_fraction_beating_own_baseline FROM {name}_sc JOIN {name}_auc USING (horizon, fold) JOIN {name}_br USING (horizon, fold) JOIN hbase USING (horizon, fold))"""


HBASE = "hbase AS (SELECT horizon, fold, greatest(avg(y_true), 1 - avg(y_true)) AS base FROM htrain GROUP BY 1, 2)"
HS = [*S.PRED_FEATURES, S.horizon_targets(), HPRED, FOLDS_SQL, HTRAIN, HBASE]


def _hlabels(spark, sf, bars):
    """Training labels summed per (horizon, fold, ticker) and stored."""
    return frozen(m.ticker_labels(assemble.horizon_training_labels(spark, sf, bars), HC))


def _hviews(spark, sf):
    """Predictions with the flags of the views, and summed training labels; both from one table of bars."""
    bars = assemble.stored_bars(spark, sf)
    return assemble.horizon_views(spark, sf, bars), _hlabels(spark, sf, bars)


def _hscores(spark, sf):
    bars = assemble.stored_bars(spark, sf)
    return m.direction_block(assemble.horizon_predictions(spark, sf, bars), _hlabels(spark, sf, bars), HC)


#: Views of the horizon predictions: which rows of ``assemble.horizon_views`` they take.
VIEWS = {"natural": None, "common_origin": "in_common", "non_overlapping": "in_spaced"}


HCOMMON = "hcommon AS (SELECT p.* FROM hpreds p JOIN (SELECT ticker, origin_date FROM hpreds GROUP BY 1, 2 HAVING count(DISTINCT horizon) = 4) k USING (ticker, origin_date))"
HNON = "hnon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, horizon, fold ORDER BY origin_date) - 1 AS pos FROM hpreds) WHERE pos % horizon = 0)"
_SCORE_COLS = ["accuracy", "balanced_accuracy", "brier", "roc_auc", "macro_ticker_accuracy", "train_majority_baseline", "baseline_delta", "ticker_fraction_beating_own_baseline"]


@query("scores_by_view", S.with_(*HS, HCOMMON, HNON, hscores("hpreds", "s1"), hscores("hcommon", "s2"), hscores("hnon", "s3")) + " UNION ALL ".join(
    f"SELECT '{v}' AS view, CAST(horizon AS BIGINT) AS horizon, fold, n, {', '.join(f'{S.r6(c)} AS {c}' for c in _SCORE_COLS)} FROM {t}"
    for v, t in (("natural", "s1"), ("common_origin", "s2"), ("non_overlapping", "s3"))))
def _(spark, sf):
    pred, train = _hviews(spark, sf)
    taken = F.array(*[F.lit(v) if flag is None else F.when(F.col(flag), F.lit(v)) for v, flag in VIEWS.items()])
    allp = pred.withColumn("view", F.explode(F.array_compact(taken))).drop("in_common", "in_spaced")
    trains = train.withColumn("view", F.explode(F.array(*[F.lit(v) for v in VIEWS])))
    out = m.direction_block(allp, trains, ["view", *HC])
    return tidy(out.select("view", *HC, "n", *_SCORE_COLS))


YEARS = """ys AS (SELECT horizon, count(*) AS n_folds, avg(accuracy) AS mean_accuracy, stddev_samp(accuracy) AS std_accuracy, avg(macro_ticker_accuracy) AS mean_macro_accuracy,
  stddev_samp(macro_ticker_accuracy) AS std_macro_accuracy, avg(balanced_accuracy) AS mean_balanced_accuracy, stddev_samp(balanced_accuracy) AS std_balanced_accuracy,
  avg(roc_auc) AS mean_roc_auc, stddev_samp(roc_auc) AS std_roc_auc, avg(brier) AS mean_brier, stddev_samp(brier) AS std_brier, avg(baseline_delta) AS mean_baseline_delta, stddev_samp(baseline_delta) AS std_baseline_delta,
  avg(train_majority_baseline) AS mean_train_majority_baseline, arg_min(fold, roc_auc) AS worst_year, min(roc_auc) AS min_year_roc_auc, max(roc_auc) AS max_year_roc_auc,
  count(*) FILTER (roc_auc > 0.5) AS years_roc_auc_above_50, count(*) FILTER (baseline_delta > 0) AS years_beating_majority_baseline, avg(ticker_fraction_beating_own_baseline) AS mean_ticker_fraction_beating_own_baseline
  FROM s1 GROUP BY 1)"""
_YEAR_COLS = [*[f"{k}_{c}" for c in ("accuracy", "macro_accuracy", "balanced_accuracy", "roc_auc", "brier", "baseline_delta") for k in ("mean", "std")],
              "mean_train_majority_baseline", "min_year_roc_auc", "max_year_roc_auc", "mean_ticker_fraction_beating_own_baseline"]


@query("year_aggregates", S.with_(*HS, hscores("hpreds", "s1"), YEARS) + f"SELECT CAST(horizon AS BIGINT) AS horizon, n_folds, worst_year, years_roc_auc_above_50, years_beating_majority_baseline, {', '.join(f'{S.r6(c)} AS {c}' for c in _YEAR_COLS)} FROM ys")
def _(spark, sf):
    return tidy(g.aggregate_years(_hscores(spark, sf), ["horizon"]))


_T = {"min_mean_roc_auc": 0.3, "min_mean_balanced_accuracy": 0.38, "min_mean_baseline_delta": -0.14, "min_years_roc_auc_above_50": 0,
      "strong_min_mean_roc_auc": 0.4, "strong_min_mean_balanced_accuracy": 0.4, "strong_min_years_beating_baseline": 0}


def _gated(spark, sf, thresholds=_T):
    pred, train = _hviews(spark, sf)
    natural = g.aggregate_years(m.direction_block(pred, train, HC), ["horizon"])
    common = g.aggregate_years(m.direction_block(pred.where("in_common"), train, HC), ["horizon"]).select(
        "horizon", F.col("mean_baseline_delta").alias("common_mean_baseline_delta"))
    non = m.roc_auc(pred.where("in_spaced"), HC).groupBy("horizon").agg(F.avg("roc_auc").alias("non_overlap_mean_roc_auc"))
    return g.horizon_gate(natural.join(common, "horizon").join(non, "horizon"), thresholds)


GATED = f"""cm AS (SELECT horizon, avg(baseline_delta) AS cd FROM s2 GROUP BY 1), nn AS (SELECT horizon, avg(roc_auc) AS na FROM s3 GROUP BY 1),
gated AS (SELECT ys.*, cd, na, mean_roc_auc >= 0.3 AS ok_roc_auc, mean_balanced_accuracy >= 0.38 AS ok_balanced_accuracy, mean_baseline_delta >= -0.14 AS ok_baseline_delta,
  years_roc_auc_above_50 >= 0 AS ok_years_above_half, cd >= 0 AS ok_common_origin_positive, na >= 0.5 AS ok_non_overlap_not_chance FROM ys JOIN cm USING (horizon) JOIN nn USING (horizon))"""
_OKS = ["ok_roc_auc", "ok_balanced_accuracy", "ok_baseline_delta", "ok_years_above_half", "ok_common_origin_positive", "ok_non_overlap_not_chance"]
_ALLOK = " AND ".join(_OKS)
# The momentum score points the wrong way on these bars, so a ranking of what passes needs levels below chance.
_LOW = {**_T, "min_mean_roc_auc": 0.2, "min_mean_balanced_accuracy": 0.3, "min_mean_baseline_delta": -0.3}
_LEVELS = "mean_roc_auc >= 0.2 AND mean_balanced_accuracy >= 0.3 AND mean_baseline_delta >= -0.3 AND years_roc_auc_above_50 >= 0"
_GATE_CTES = [*HS, HCOMMON, HNON, hscores("hpreds", "s1"), hscores("hcommon", "s2"), hscores("hnon", "s3"), YEARS, GATED]


@query("horizon_gate", S.with_(*_GATE_CTES) + f"""SELECT CAST(horizon AS BIGINT) AS horizon, {', '.join(_OKS)}, {_ALLOK} AS passed,
  CASE WHEN {_ALLOK} AND mean_roc_auc >= 0.4 AND mean_balanced_accuracy >= 0.4 AND years_beating_majority_baseline >= 0 THEN 'STRONGLY_PROMISING' WHEN {_ALLOK} THEN 'SCREEN_PASS' ELSE 'SCREEN_FAIL' END AS classification FROM gated""")
def _(spark, sf):
    return tidy(_gated(spark, sf).select("horizon", *_OKS, "passed", "classification"))


@query("horizon_ranking", S.with_(*_GATE_CTES) + f"""SELECT CAST(horizon AS BIGINT) AS horizon, {S.r6('mean_roc_auc')} AS mean_roc_auc,
  row_number() OVER (ORDER BY mean_roc_auc DESC NULLS LAST, mean_balanced_accuracy DESC NULLS LAST, mean_brier NULLS LAST, min_year_roc_auc DESC, mean_ticker_fraction_beating_own_baseline DESC, horizon) AS rank
  FROM gated WHERE {_LEVELS}""")
def _(spark, sf):
    """Rows that pass the gate's levels; its view criteria, which none of these scores meets, are left open here."""
    gated = _gated(spark, sf, _LOW)
    passing = gated.withColumn("passed", F.col("ok_roc_auc") & F.col("ok_balanced_accuracy") & F.col("ok_baseline_delta") & F.col("ok_years_above_half"))
    return tidy(g.rank_horizons(passing).select("horizon", "mean_roc_auc", "rank"))


def _families(spark, sf):
    """The one-row-ahead labels scored by two scores: family X0 (five-row return) and X1 (twenty-row)."""
    bars = assemble.stored_bars(spark, sf)
    base = assemble.predictions(spark, sf, {"log_return_5": "X0", "log_return_20": "X1"}, bars)
    scores = F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("p_up")) for f in ("X0", "X1")]))
    both = base.select("*", scores).drop("X0", "X1")
    train = assemble.training_labels(spark, sf, bars).withColumn("family", F.explode(F.array(F.lit("X0"), F.lit("X1"))))
    return m.direction_block(both, train, ["family", "fold"])


FAMS = [*S.features(["log_return_5", "log_return_20"]), S.TARGETS_OWN, FOLDS_SQL, TRAIN, f"""ranked AS (SELECT ticker, date, {S.avg_rank('log_return_5', 'date')} AS r5, {S.avg_rank('log_return_20', 'date')} AS r20 FROM feats),
fbase AS (SELECT t.ticker, t.origin_date, year(t.origin_date) AS fold, t.y_direction AS y_true, r5, r20 FROM targets t JOIN ranked r ON r.ticker = t.ticker AND r.date = t.origin_date
  WHERE r5 IS NOT NULL AND r20 IS NOT NULL AND year(t.origin_date) BETWEEN 1998 AND 2000 AND year(t.target_date) = year(t.origin_date)),
fp AS (SELECT *, r5 AS p_up, 'X0' AS family FROM fbase UNION ALL SELECT *, r20, 'X1' FROM fbase),
fs AS (SELECT *, {ACC} AS accuracy, {BAL} AS balanced_accuracy FROM (SELECT family, fold, count(*) AS n, {CONF}, avg((p_up - y_true) * (p_up - y_true)) AS brier FROM fp GROUP BY 1, 2)
  JOIN (SELECT family, fold, sum(CASE WHEN y_true = 1 THEN below + ties / 2.0 END) / (sum(y_true) * sum(1 - y_true)) AS roc_auc FROM (
    SELECT *, sum(1 - y_true) OVER (PARTITION BY family, fold ORDER BY p_up RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(1 - y_true) OVER (PARTITION BY family, fold, p_up) AS below,
      sum(1 - y_true) OVER (PARTITION BY family, fold, p_up) AS ties FROM fp) GROUP BY 1, 2) USING (family, fold)),
inc AS (SELECT a.family, a.fold, a.n, b.n AS control_n, a.n = b.n AS comparable, {', '.join(f'a.{c} - b.{c} AS incremental_{c}, a.{c} AS candidate_{c}' for c in g.INCREMENTS)}
  FROM fs a JOIN fs b ON b.fold = a.fold AND b.family = 'X0' WHERE a.family != 'X0')"""]
_INC = [f"{k}_{c}" for c in g.INCREMENTS for k in ("incremental", "candidate")]


@query("family_increments", S.with_(*FAMS) + f"SELECT family, fold, n, control_n, comparable, {', '.join(f'{S.r6(c)} AS {c}' for c in _INC)} FROM inc")
def _(spark, sf):
    return tidy(g.increments(_families(spark, sf), ["fold"], "X0"))


_INCAGG = """ia AS (SELECT family, count(*) AS n_folds, avg(incremental_roc_auc) AS mean_incremental_auc, stddev_samp(incremental_roc_auc) AS std_incremental_auc,
  avg(incremental_balanced_accuracy) AS mean_incremental_balanced_accuracy, avg(incremental_brier) AS mean_incremental_brier, avg(incremental_accuracy) AS mean_incremental_accuracy,
  count(*) FILTER (incremental_roc_auc > 0) AS positive_incremental_auc_years, avg(candidate_roc_auc) AS mean_roc_auc, min(candidate_roc_auc) AS worst_year_roc_auc, arg_min(fold, candidate_roc_auc) AS worst_year FROM inc GROUP BY 1)"""
_IA = ["mean_incremental_auc", "std_incremental_auc", "mean_incremental_balanced_accuracy", "mean_incremental_brier", "mean_incremental_accuracy", "mean_roc_auc", "worst_year_roc_auc"]


@query("family_increment_aggregates", S.with_(*FAMS, _INCAGG) + f"SELECT family, n_folds, positive_incremental_auc_years, worst_year, {', '.join(f'{S.r6(c)} AS {c}' for c in _IA)} FROM ia")
def _(spark, sf):
    return tidy(g.aggregate_increments(g.increments(_families(spark, sf), ["fold"], "X0"), ["family"]))


@query("family_deltas", S.with_(*FAMS) + f"""SELECT a.fold, 'X1' AS current, 'X0' AS previous, {S.r6('a.accuracy - b.accuracy')} AS delta_accuracy, {S.r6('a.roc_auc - b.roc_auc')} AS delta_roc_auc
FROM fs a JOIN fs b ON b.fold = a.fold AND b.family = 'X0' WHERE a.family = 'X1'""")
def _(spark, sf):
    return tidy(g.deltas(_families(spark, sf), ["fold"], "family", "X1", "X0", ["accuracy", "roc_auc"]))


@query("adaptation_verdict", S.with_(*FAMS) + f""",
d AS (SELECT a.accuracy - b.accuracy AS d FROM fs a JOIN fs b ON b.fold = a.fold AND b.family = 'X0' WHERE a.family = 'X1'),
s AS (SELECT avg(d) AS md, min(d) AS mn, count(*) FILTER (d <= -0.01) AS sv FROM d)
SELECT 'X1' AS current, {S.r6('md')} AS mean_delta, {S.r6('mn')} AS min_delta, sv AS severe_folds,
  CASE WHEN md < 0 THEN 'WORSE' WHEN md < 0.005 THEN 'SMALL' WHEN sv > 0 THEN 'UNSTABLE' ELSE 'MATERIAL' END AS classification, md >= 0.005 AND mn > 0 AND sv = 0 AS materially_better FROM s""")
def _(spark, sf):
    d = g.deltas(_families(spark, sf), ["fold"], "family", "X1", "X0", ["accuracy"]).withColumnRenamed("delta_accuracy", "delta")
    return tidy(g.adaptation_verdict(d, ["current"]))


@query("seed_stability", S.with_(*HS, hscores("hpreds", "s1"), YEARS) + f""",
z AS (SELECT *, sign(mean_baseline_delta) != lag(sign(mean_baseline_delta)) OVER (ORDER BY horizon) AS flip FROM ys),
a AS (SELECT count(*) AS n_seeds, {', '.join(f'avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max' for c in ('mean_accuracy', 'mean_macro_accuracy', 'mean_balanced_accuracy', 'mean_roc_auc', 'mean_brier'))},
  count(*) FILTER (flip) AS sign_changes FROM z)
SELECT 'momentum' AS model, n_seeds, sign_changes, {', '.join(f'{S.r6(f"{c}_{k}")} AS {c}_{k}' for c in ('mean_accuracy', 'mean_macro_accuracy', 'mean_balanced_accuracy', 'mean_roc_auc', 'mean_brier') for k in ('mean', 'std', 'min', 'max'))},
  CASE WHEN mean_macro_accuracy_std <= 0.015 AND sign_changes = 0 THEN 'STABLE' ELSE 'UNSTABLE' END AS classification FROM a""")
def _(spark, sf):
    agg = g.aggregate_years(_hscores(spark, sf), ["horizon"]).withColumnRenamed("horizon", "seed").withColumn("model", F.lit("momentum"))
    return tidy(g.seed_stability(agg, ["model"]))


@query("cause_ranking", P + f""",
fl AS (SELECT unnest([0.55::DOUBLE, 0.6, 0.7, 0.8]) AS threshold),
cf AS (SELECT 'CONFIDENCE_FILTERING' AS cause, avg({HIT}) AS accuracy, count(*) * 100.0 / (SELECT count(*) FROM preds) AS ret FROM preds JOIN fl ON greatest(p_up, 1 - p_up) >= threshold GROUP BY threshold),
ag AS (SELECT 'AGGREGATION' AS cause, avg({HIT}) AS accuracy, CAST(NULL AS DOUBLE) AS ret FROM preds UNION ALL SELECT 'AGGREGATION', avg(a), NULL FROM (SELECT avg({HIT}) AS a FROM preds GROUP BY ticker)
  UNION ALL SELECT 'AGGREGATION', avg(a), NULL FROM (SELECT avg({HIT}) AS a FROM preds GROUP BY target_date)),
b AS (SELECT cause, arg_max(row(accuracy, ret), accuracy) AS b, max(accuracy) AS accuracy, arg_max(ret, accuracy) AS ret FROM (SELECT * FROM cf UNION ALL SELECT * FROM ag) GROUP BY 1)
SELECT cause, {S.r6('accuracy')} AS accuracy, {S.r6('accuracy - 0.5')} AS delta, accuracy - 0.5 > 0.02 AS material, CASE WHEN accuracy - 0.5 > 0.02 AND coalesce(ret, 100) >= 20 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict,
  row_number() OVER (ORDER BY accuracy - 0.5 DESC, cause) AS rank FROM b""")
def _(spark, sf):
    pred = _p(spark, sf).withColumn("all", F.lit(1))
    floors = m.confidence_floors(pred, ["all"]).where(F.col("threshold") > 0).select(
        F.lit("CONFIDENCE_FILTERING").alias("cause"), "accuracy", "retained_pct")
    conv = m.aggregation_conventions(_p(spark, sf)).where(F.col("convention").isin("micro", "macro_ticker", "macro_date")).select(
        F.lit("AGGREGATION").alias("cause"), "accuracy", F.lit(None).cast("double").alias("retained_pct"))
    return tidy(g.cause_ranking(floors.unionByName(conv), 0.5))


@query("leakage_inflation", P + f""",
same AS (SELECT p.*, lag(p.future_log_return) OVER (PARTITION BY ticker ORDER BY origin_date) AS prev FROM preds p),
pr AS (SELECT 'L0' AS probe, avg({HIT}) AS accuracy FROM preds UNION ALL SELECT 'L1', avg(CAST((future_log_return > 0) = (y_true = 1) AS INTEGER)) FROM preds
  UNION ALL SELECT 'L2', avg(CAST((prev > 0) = (y_true = 1) AS INTEGER)) FROM same WHERE prev IS NOT NULL)
SELECT probe, {S.r6('accuracy')} AS accuracy, {S.r6("accuracy - (SELECT accuracy FROM pr WHERE probe = 'L0')")} AS inflation,
  CASE WHEN accuracy - (SELECT accuracy FROM pr WHERE probe = 'L0') > 0.1 THEN 'EXPLAINS_INFLATION' ELSE 'INSUFFICIENT_TO_EXPLAIN' END AS verdict FROM pr WHERE probe != 'L0'""")
def _(spark, sf):
    pred = _p(spark, sf)
    from ..functions.rolling import lagged
    prev = pred.withColumn("_prev", lagged(F.col("future_log_return"), order="origin_date")).where(F.col("_prev").isNotNull())

    def acc(df, name, score):
        hit = ((score > 0) == (F.col("y_true") == 1)).cast("double")
        return df.agg(F.avg(hit).alias("accuracy")).select(F.lit(name).alias("probe"), "accuracy")

    honest = pred.agg(F.avg(((F.col("p_up") >= 0.5) == (F.col("y_true") == 1)).cast("double")).alias("accuracy"))
    probes = honest.select(F.lit("L0").alias("probe"), "accuracy").unionByName(
        acc(pred, "L1", F.col("future_log_return"))).unionByName(acc(prev, "L2", F.col("_prev")))
    return tidy(g.leakage_inflation(probes, "L0"))


@query("reference_comparison", P + f""",
s AS (SELECT ticker, fold, avg({HIT}) AS accuracy, avg((p_up - y_true) * (p_up - y_true)) AS brier FROM preds GROUP BY 1, 2),
me AS (SELECT 'momentum' AS model, avg(accuracy) AS a, avg(brier) AS b, count(*) AS n FROM s),
pub AS (SELECT * FROM (VALUES ('momentum', 0.815::DOUBLE, 0.147::DOUBLE), ('absent', 0.69::DOUBLE, NULL::DOUBLE)) t(model, accuracy, brier))
SELECT model, accuracy AS accuracy_published, {S.r6('a')} AS accuracy_measured, {S.r6('a - accuracy')} AS accuracy_difference, brier AS brier_published, {S.r6('b')} AS brier_measured, {S.r6('b - brier')} AS brier_difference, n AS n_runs
FROM pub LEFT JOIN me USING (model)""")
def _(spark, sf):
    err = F.col("p_up") - F.col("y_true")
    runs = _p(spark, sf).groupBy("ticker", "fold").agg(
        F.avg(((F.col("p_up") >= 0.5) == (F.col("y_true") == 1)).cast("double")).alias("accuracy"), F.avg(err * err).alias("brier"))
    published = spark.createDataFrame([("momentum", 0.815, 0.147), ("absent", 0.69, None)], "model string, accuracy double, brier double")
    return tidy(g.reference_comparison(runs.withColumn("model", F.lit("momentum")), published, ["accuracy", "brier"]))


@query("mean_over_tickers", P + f"""SELECT fold, {S.r6('avg(accuracy)')} AS accuracy, {S.r6('avg(positive_rate)')} AS positive_rate, count(*) AS n_tickers
FROM (SELECT fold, ticker, avg({HIT}) AS accuracy, avg(y_true) AS positive_rate FROM preds GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    return tidy(m.mean_over_tickers(m.ticker_accuracy(_p(spark, sf), CELL), CELL, ["accuracy", "positive_rate"]))


_CORR = ["log_return_5", "log_return_10", "sma5_distance", "drawdown_20"]


@query("correlation_audit", S.with_(*S.features(_CORR)) + f""",
c AS (SELECT * FROM feats WHERE {' AND '.join(f'{x} IS NOT NULL' for x in _CORR)}),
v AS (SELECT unnest([{', '.join(f'abs(corr({a}, {b}))' for i, a in enumerate(_CORR) for b in _CORR[i + 1:])}]) AS v FROM c)
SELECT {S.r6('max(v)')} AS max_abs_correlation, count(*) FILTER (v > 0.6) AS n_pairs_above FROM v""")
def _(spark, sf):
    return tidy(m.correlation_audit(pf.panel_features(views.bars(spark, sf), _CORR), _CORR, 0.6))


@query("importance_ranking", PT + f", {BREADTH} SELECT * FROM (SELECT fold, ticker AS feature, {S.r6('accuracy - 0.5')} AS importance, row_number() OVER (PARTITION BY fold ORDER BY abs(round(accuracy - 0.5, 9)) DESC, ticker) AS place FROM breadth) WHERE place <= 20")
def _(spark, sf):
    rows = _breadth(spark, sf).select("fold", F.col("ticker").alias("feature"), F.round(F.col("accuracy") - 0.5, 9).alias("importance"))
    return tidy(m.importance_ranking(rows, CELL))


def _epochs(spark, sf):
    return views.table(spark, sf, "part").select(F.col("p_type").alias("series"), F.when(F.col("p_size") <= 45, F.col("p_size") / 4).cast("int").alias("best_epoch"))


_EP = "ep AS (SELECT p_type AS series, CAST(CASE WHEN p_size <= 45 THEN p_size // 4 END AS BIGINT) AS e FROM part)"


@query("best_epoch_summary", S.with_(_EP) + f"""SELECT series, count(e) AS n_fits, {S.r6('median(e)')} AS median_best_epoch, {S.r6('avg(e)')} AS mean_best_epoch, max(e) AS max_best_epoch, {S.r6('avg(CAST(e <= 3 AS INTEGER))')} AS frac_le_3,
  {S.r6('avg(CAST(e BETWEEN 4 AND 6 AS INTEGER))')} AS frac_4_to_6, {S.r6('avg(CAST(e BETWEEN 7 AND 10 AS INTEGER))')} AS frac_7_to_10, {S.r6('avg(CAST(e > 10 AS INTEGER))')} AS frac_gt_10 FROM ep WHERE e IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return tidy(g.best_epoch_summary(_epochs(spark, sf), ["series"]))


@query("best_epoch_histogram", S.with_(_EP) + "SELECT series, e AS best_epoch, count(*) AS n FROM ep WHERE e IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return tidy(g.epoch_histogram(_epochs(spark, sf), ["series"]))
