"""Gates at their published thresholds and rankings of what passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as g
from . import metrics as mt
from . import sql as S
from .registry import query
from .tidy import tidy


def _verdict(oks: dict[str, str], strong: str = "false", words: tuple[str, str, str] = ("STRONGLY_PROMISING", "PASS", "FAIL")) -> str:
    """Criteria, ``passed`` and ``classification`` as SQL columns."""
    every = " AND ".join(f"coalesce({c}, false)" for c in oks.values())
    return (", ".join(f"coalesce({c}, false) AS ok_{n}" for n, c in oks.items()) + f", {every} AS passed, "
            f"CASE WHEN {every} AND {strong} THEN '{words[0]}' WHEN {every} THEN '{words[1]}' ELSE '{words[2]}' END AS classification")


def _shown(df, key: str, oks):
    return tidy(df.select(key, *[f"ok_{n}" for n in oks], "passed", "classification"))


# ---- horizons --------------------------------------------------------------

_YEARS = [*mt.HS, mt.hscores("hpreds", "s1"), mt.YEARS]
_OUTER = """outer3 AS (SELECT horizon, avg(baseline_delta) AS nbd FROM s3 GROUP BY 1)"""
NEURAL = {"roc_auc": "mean_roc_auc >= 0.55", "balanced_accuracy": "mean_balanced_accuracy >= 0.53", "baseline_delta": "mean_baseline_delta >= 0.01",
          "years_positive": "years_beating_majority_baseline >= 4", "no_weak_year": "min_year_roc_auc >= 0.49", "non_overlap_positive": "nbd >= 0"}
BREADTH = {"macro_accuracy": "mean_macro_accuracy >= 0.54", "roc_auc": "mean_roc_auc >= 0.53",
           "beats_baseline_every_fold": "years_beating_majority_baseline = n_folds", "roc_auc_every_fold": "min_year_roc_auc >= 0.5",
           "ticker_fraction": "mean_ticker_fraction_beating_own_baseline >= 0.55"}


@query("neural_gate", S.with_(*mt.HS, mt.HNON, mt.hscores("hpreds", "s1"), mt.hscores("hnon", "s3"), mt.YEARS, _OUTER)
       + f"SELECT CAST(horizon AS BIGINT) AS horizon, {_verdict(NEURAL)} FROM ys JOIN outer3 USING (horizon)")
def _(spark, sf):
    pred, train = mt._hviews(spark, sf)
    non = mt.m.direction_block(pred.where("in_spaced"), train, mt.HC).groupBy("horizon").agg(
        F.avg("baseline_delta").alias("non_overlap_mean_baseline_delta"))
    years = g.aggregate_years(mt.m.direction_block(pred, train, mt.HC), ["horizon"]).join(non, "horizon")
    return _shown(g.neural_gate(years, g.NEURAL_THRESHOLDS), "horizon", NEURAL)


@query("breadth_gate", S.with_(*_YEARS) + f"SELECT CAST(horizon AS BIGINT) AS horizon, {_verdict(BREADTH)} FROM ys")
def _(spark, sf):
    years = g.aggregate_years(mt._hscores(spark, sf), ["horizon"])
    return _shown(g.breadth_gate(years, g.BREADTH_THRESHOLDS), "horizon", BREADTH)


@query("schedule_gate", S.with_(*mt.HS, mt.hscores("hpreds", "s1")) + f""",
f AS (SELECT horizon, fold, {mt.F1} AS f1 FROM s1_sc),
a AS (SELECT horizon, avg(accuracy) AS ma, avg(train_majority_baseline) AS mm, avg(f1) AS mf, avg(brier) AS mb, 100.0 * avg(CAST(baseline_delta > 0 AS INTEGER)) AS bp FROM s1 JOIN f USING (horizon, fold) GROUP BY 1),
v AS (SELECT *, CASE WHEN ma - mm > 0.005 AND (bp >= 55 OR mf >= 0.52) AND mb < 0.25 AND bp > 0 THEN 'PROMISING' WHEN ma - mm > 0 OR mf >= 0.52 THEN 'WEAK' ELSE 'ABSENT' END AS verdict FROM a)
SELECT CAST(horizon AS BIGINT) AS horizon, {S.r6('ma - mm')} AS accuracy_over_majority, {S.r6('mf')} AS mean_f1, verdict, verdict = 'PROMISING' AS proceed FROM v""")
def _(spark, sf):
    table = mt._hscores(spark, sf).groupBy("horizon").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.avg("train_majority_baseline").alias("mean_majority_accuracy"),
        F.avg("f1").alias("mean_f1"), F.avg("brier").alias("mean_brier"),
        (100 * F.avg((F.col("baseline_delta") > 0).cast("int"))).alias("beating_majority_pct"))
    return tidy(g.schedule_gate(table).select("horizon", "accuracy_over_majority", "mean_f1", "verdict", "proceed"))


PUBLISHED = {"roc_auc": "mean_roc_auc >= 0.54", "balanced_accuracy": "mean_balanced_accuracy >= 0.52", "baseline_delta": "mean_baseline_delta >= 0.005",
             "years_above_half": "years_roc_auc_above_50 >= 4", "common_origin_positive": "cd >= 0", "non_overlap_not_chance": "na >= 0.5"}


@query("horizon_gate_published", S.with_(*mt._GATE_CTES) + "SELECT CAST(horizon AS BIGINT) AS horizon, " + _verdict(
    PUBLISHED, "mean_roc_auc >= 0.56 AND mean_balanced_accuracy >= 0.54 AND years_beating_majority_baseline >= 4",
    ("STRONGLY_PROMISING", "SCREEN_PASS", "SCREEN_FAIL")) + " FROM gated")
def _(spark, sf):
    return _shown(mt._gated(spark, sf, g.HORIZON_THRESHOLDS), "horizon", PUBLISHED)


# ---- families --------------------------------------------------------------

_FAMS = [*mt.FAMS, mt._INCAGG, f"""fm AS (SELECT family, fold, avg(acc) AS macro FROM (SELECT family, fold, ticker, avg({mt.HIT}) AS acc FROM fp GROUP BY 1, 2, 3) GROUP BY 1, 2),
fb AS (SELECT fold, greatest(avg(y_true), 1 - avg(y_true)) AS base FROM train GROUP BY 1),
fz AS (SELECT fs.*, macro, accuracy - base AS delta FROM fs JOIN fm USING (family, fold) JOIN fb USING (fold)),
fy AS (SELECT family, count(*) AS n_folds, avg(roc_auc) AS mean_roc_auc, avg(balanced_accuracy) AS mean_balanced_accuracy, avg(delta) AS mean_baseline_delta, avg(macro) AS mean_macro_accuracy,
  avg(brier) AS mean_brier, min(roc_auc) AS min_year_roc_auc, bool_and(delta > 0) AS beats FROM fz GROUP BY 1)"""]
FAMILY = {"roc_auc": "mean_roc_auc >= 0.55", "increment": "ci >= 0.015", "balanced_accuracy": "mean_balanced_accuracy >= 0.53", "baseline_delta": "mean_baseline_delta >= 0.01",
          "years": "cy >= 4", "common_level": "cr >= 0.55", "non_overlap": "true"}
_FG = "fg AS (SELECT fy.*, ia.mean_incremental_auc AS ci, ia.positive_incremental_auc_years AS cy, ia.mean_roc_auc AS cr FROM fy JOIN ia USING (family))"


def _family_table(spark, sf):
    """Year aggregates of each family with its increments over the control; no non-overlapping view is scored."""
    scores = mt.frozen(mt._families(spark, sf))
    common = g.aggregate_increments(g.increments(scores, ["fold"], "X0"), ["family"]).select(
        "family", F.col("mean_incremental_auc").alias("common_mean_incremental_auc"),
        F.col("positive_incremental_auc_years").alias("common_positive_incremental_auc_years"),
        F.col("mean_roc_auc").alias("common_mean_roc_auc"))
    years = g.aggregate_years(scores, ["family"]).withColumn("non_overlap_mean_roc_auc", F.lit(None).cast("double"))
    return scores, years.join(common, "family", "left")


@query("family_gate", S.with_(*_FAMS, _FG) + "SELECT family, " + _verdict(
    FAMILY, "mean_roc_auc >= 0.57 AND ci >= 0.025 AND cy >= 4", ("STRONGLY_PROMISING", "SIGNAL_PASS", "SIGNAL_FAIL")) + " FROM fg")
def _(spark, sf):
    table = _family_table(spark, sf)[1].where(F.col("family") != "X0")
    return _shown(g.family_gate(table, g.FAMILY_THRESHOLDS), "family", FAMILY)


@query("family_ranking", S.with_(*_FAMS) + f"""
SELECT family, {S.r6('fy.mean_roc_auc')} AS mean_roc_auc, row_number() OVER (ORDER BY ia.mean_roc_auc DESC NULLS LAST, ia.mean_incremental_auc DESC NULLS LAST, mean_balanced_accuracy DESC NULLS LAST, mean_brier NULLS LAST, min_year_roc_auc DESC NULLS LAST) AS rank
FROM fy LEFT JOIN ia USING (family)""")
def _(spark, sf):
    return tidy(g.ranked(_family_table(spark, sf)[1], g.FAMILY_ORDER).select("family", "mean_roc_auc", "rank"))


@query("variant_ranking", S.with_(*_FAMS) + f"""
SELECT family, {S.r6('mean_macro_accuracy')} AS mean_macro_accuracy, row_number() OVER (ORDER BY mean_macro_accuracy DESC NULLS LAST, mean_roc_auc DESC NULLS LAST, mean_brier NULLS LAST) AS rank FROM fy""")
def _(spark, sf):
    return tidy(g.ranked(_family_table(spark, sf)[1], g.WINNER_ORDER).select("family", "mean_macro_accuracy", "rank"))


@query("context_gate", S.with_(*_FAMS) + f""",
c AS (SELECT a.family, a.mean_macro_accuracy AS m, a.mean_roc_auc AS r, a.beats, a.mean_macro_accuracy - b.mean_macro_accuracy AS d FROM fy a JOIN fy b ON b.family = 'X0' WHERE a.family = 'X1')
SELECT family, {S.r6('d')} AS delta_over_base, m >= 0.55 AND beats AS ok_level, d >= 0.015 AND beats AND r >= 0.54 AS ok_gain, (m >= 0.55 AND beats) OR (d >= 0.015 AND beats AND r >= 0.54) AS passed FROM c""")
def _(spark, sf):
    scores, years = _family_table(spark, sf)
    beats = scores.groupBy("family").agg(F.bool_and(F.col("baseline_delta") > 0).alias("beats_every_fold"))
    base = years.where(F.col("family") == "X0").select(F.col("mean_macro_accuracy").alias("base_mean_macro_accuracy"), F.lit("X1").alias("family"))
    pairs = years.where(F.col("family") == "X1").join(beats, "family").join(base, "family")
    return tidy(g.context_gate(pairs, *g.CONTEXT_THRESHOLDS.values()).select("family", "delta_over_base", "ok_level", "ok_gain", "passed"))


@query("multitask_gate", S.with_(*_FAMS) + f""",
d AS (SELECT a.family, avg(a.macro - b.macro) AS mg, avg(a.roc_auc - b.roc_auc) AS ag, avg(b.brier - a.brier) AS bg, min(a.accuracy - b.accuracy) AS wf FROM fz a JOIN fz b ON b.fold = a.fold AND b.family = 'X0' WHERE a.family = 'X1' GROUP BY 1)
SELECT family, {S.r6('mg')} AS macro_gain, {S.r6('ag')} AS auc_gain, {S.r6('bg')} AS brier_gain, {S.r6('wf')} AS worst_fold_delta, (mg >= 0.005 OR ag >= 0.01 OR bg >= 0.002) AND wf >= -0.01 AS improves FROM d""")
def _(spark, sf):
    scores = mt.frozen(mt._families(spark, sf))
    old, new = (scores.where(F.col("family") == f).select("fold", *[
        F.col(c).alias(f"{c}_{f}") for c in ("macro_ticker_accuracy", "roc_auc", "brier", "accuracy")]) for f in ("X0", "X1"))
    gain = (lambda c: F.col(f"{c}_X1") - F.col(f"{c}_X0"))
    deltas = new.join(old, "fold").agg(F.avg(gain("macro_ticker_accuracy")).alias("macro_gain"), F.avg(gain("roc_auc")).alias("auc_gain"),
                                       F.avg(-gain("brier")).alias("brier_gain"), F.min(gain("accuracy")).alias("worst_fold_delta"))
    return tidy(g.multitask_gate(deltas).withColumn("family", F.lit("X1")).select(
        "family", "macro_gain", "auc_gain", "brier_gain", "worst_fold_delta", "improves"))
