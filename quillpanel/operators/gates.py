"""Decisions over stored score tables: year aggregates, increments, gates, rankings.

These tables have one row per model, family, horizon, fold, view or seed, so
their size is set by the experiment grid, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_where

# Thresholds of the gates.
HORIZON_THRESHOLDS = {
    "min_mean_roc_auc": 0.54, "min_mean_balanced_accuracy": 0.52, "min_mean_baseline_delta": 0.005,
    "min_years_roc_auc_above_50": 4, "strong_min_mean_roc_auc": 0.56, "strong_min_mean_balanced_accuracy": 0.54,
    "strong_min_years_beating_baseline": 4}
NEURAL_THRESHOLDS = {
    "min_mean_roc_auc": 0.55, "min_mean_balanced_accuracy": 0.53, "min_mean_accuracy_delta": 0.01,
    "min_years_positive_baseline_delta": 4, "min_year_roc_auc": 0.49}
FAMILY_THRESHOLDS = {
    "min_mean_roc_auc": 0.55, "min_min_incremental_auc": 0.015, "min_mean_balanced_accuracy": 0.53,
    "min_mean_accuracy_delta": 0.01, "min_years_positive_incremental_auc": 4, "strong_min_mean_roc_auc": 0.57,
    "strong_min_incremental_auc": 0.025, "strong_min_years_positive_incremental_auc": 4}
BREADTH_THRESHOLDS = {
    "min_mean_macro_accuracy": 0.54, "min_mean_roc_auc": 0.53, "min_auc_per_fold": 0.50,
    "min_fraction_tickers_beating_baseline": 0.55}
CONTEXT_THRESHOLDS = {"mean_macro": 0.55, "min_delta": 0.015, "min_auc": 0.54}

INCREMENTS = ("roc_auc", "balanced_accuracy", "brier", "accuracy")


def aggregate_years(scores: DataFrame, cells: list[str], fold: str = "fold") -> DataFrame:
    """Means and deviations over years, the worst year, and robustness counts."""
    auc, delta = F.col("roc_auc"), F.col("baseline_delta")
    spread = []
    for name, col in (("accuracy", "accuracy"), ("macro_accuracy", "macro_ticker_accuracy"),
                      ("balanced_accuracy", "balanced_accuracy"), ("roc_auc", "roc_auc"), ("brier", "brier"),
                      ("baseline_delta", "baseline_delta")):
        spread += [F.avg(col).alias(f"mean_{name}"), F.stddev_samp(col).alias(f"std_{name}")]
    return scores.where(F.col("n") > 0).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_folds"), *spread,
        F.avg("train_majority_baseline").alias("mean_train_majority_baseline"),
        F.min_by(fold, F.when(auc.isNotNull(), F.struct(auc, F.col(fold)))).alias("worst_year"),
        F.min(auc).alias("min_year_roc_auc"), F.max(auc).alias("max_year_roc_auc"),
        count_where(auc > 0.5).alias("years_roc_auc_above_50"),
        count_where(delta > 0).alias("years_beating_majority_baseline"),
        F.avg("ticker_fraction_beating_own_baseline").alias("mean_ticker_fraction_beating_own_baseline"))


def increments(scores: DataFrame, keys: list[str], control: str, family: str = "family") -> DataFrame:
    """Candidate minus control on the same cell; comparable only with equal row counts."""
    cols = [*keys, "n", *INCREMENTS]
    base = scores.where(F.col(family) == control).select(
        *keys, F.col("n").alias("control_n"), *[F.col(m).alias(f"control_{m}") for m in INCREMENTS])
    cand = scores.where(F.col(family) != control).select(family, *cols)
    df = cand.join(base, keys)
    return df.select(family, *keys, "n", "control_n", (F.col("n") == F.col("control_n")).alias("comparable"),
                     *[(F.col(m) - F.col(f"control_{m}")).alias(f"incremental_{m}") for m in INCREMENTS],
                     *[F.col(m).alias(f"candidate_{m}") for m in INCREMENTS])


def aggregate_increments(rows: DataFrame, cells: list[str]) -> DataFrame:
    inc, auc = F.col("incremental_roc_auc"), F.col("candidate_roc_auc")
    return rows.where(F.col("n") > 0).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg(inc).alias("mean_incremental_auc"),
        F.stddev_samp(inc).alias("std_incremental_auc"),
        F.avg("incremental_balanced_accuracy").alias("mean_incremental_balanced_accuracy"),
        F.avg("incremental_brier").alias("mean_incremental_brier"),
        F.avg("incremental_accuracy").alias("mean_incremental_accuracy"),
        count_where(inc > 0).alias("positive_incremental_auc_years"), F.avg(auc).alias("mean_roc_auc"),
        F.min(auc).alias("worst_year_roc_auc"), F.min_by("fold", F.when(auc.isNotNull(), F.struct(auc, F.col("fold")))).alias("worst_year"))


def at_least(column: str, floor: float) -> Column:
    """The value is present, finite and reaches the floor."""
    c = F.col(column)
    return F.coalesce(~F.isnan(c.cast("double")) & (c.cast("double") < F.lit(float("inf"))) & (c >= F.lit(floor)), F.lit(False))


def gate(df: DataFrame, criteria: dict[str, Column], strong: dict[str, Column] | None = None,
         words: tuple[str, str, str] = ("STRONGLY_PROMISING", "PASS", "FAIL")) -> DataFrame:
    """Add each criterion, ``passed`` and ``classification``; every criterion must hold."""
    every = F.lit(True)
    for c in criteria.values():
        every = every & F.coalesce(c, F.lit(False))
    df = df.withColumns({f"ok_{n}": F.coalesce(c, F.lit(False)) for n, c in criteria.items()}).withColumn("passed", every)
    best = F.lit(False)
    if strong:
        best = F.col("passed")
        for c in strong.values():
            best = best & F.coalesce(c, F.lit(False))
    return df.withColumn("classification", F.when(best, words[0]).when(F.col("passed"), words[1]).otherwise(words[2]))


def horizon_gate(df: DataFrame, t: dict[str, float]) -> DataFrame:
    """Screening gate of a horizon over natural, common-origin and non-overlapping aggregates.

    ``df`` has the year aggregates plus ``common_mean_baseline_delta`` and
    ``non_overlap_mean_roc_auc``, each computed on its own view.
    """
    return gate(df, {
        "roc_auc": at_least("mean_roc_auc", t["min_mean_roc_auc"]),
        "balanced_accuracy": at_least("mean_balanced_accuracy", t["min_mean_balanced_accuracy"]),
        "baseline_delta": at_least("mean_baseline_delta", t["min_mean_baseline_delta"]),
        "years_above_half": at_least("years_roc_auc_above_50", t["min_years_roc_auc_above_50"]),
        "common_origin_positive": at_least("common_mean_baseline_delta", 0.0),
        "non_overlap_not_chance": at_least("non_overlap_mean_roc_auc", 0.5),
    }, {
        "roc_auc": at_least("mean_roc_auc", t["strong_min_mean_roc_auc"]),
        "balanced_accuracy": at_least("mean_balanced_accuracy", t["strong_min_mean_balanced_accuracy"]),
        "years": at_least("years_beating_majority_baseline", t["strong_min_years_beating_baseline"]),
    }, ("STRONGLY_PROMISING", "SCREEN_PASS", "SCREEN_FAIL"))


def neural_gate(df: DataFrame, t: dict[str, float]) -> DataFrame:
    """Signal gate of a trained model's year aggregates."""
    return gate(df, {
        "roc_auc": at_least("mean_roc_auc", t["min_mean_roc_auc"]),
        "balanced_accuracy": at_least("mean_balanced_accuracy", t["min_mean_balanced_accuracy"]),
        "baseline_delta": at_least("mean_baseline_delta", t["min_mean_accuracy_delta"]),
        "years_positive": at_least("years_beating_majority_baseline", t["min_years_positive_baseline_delta"]),
        "no_weak_year": at_least("min_year_roc_auc", t["min_year_roc_auc"]),
        "non_overlap_positive": at_least("non_overlap_mean_baseline_delta", 0.0),
    })


def family_gate(df: DataFrame, t: dict[str, float]) -> DataFrame:
    """Gate of a feature family: level on the natural view, increment on the common view.

    The non-overlap criterion applies only where that view was scored.
    """
    non_overlap = F.col("non_overlap_mean_roc_auc").isNull() | at_least("non_overlap_mean_roc_auc", 0.5)
    return gate(df, {
        "roc_auc": at_least("mean_roc_auc", t["min_mean_roc_auc"]),
        "increment": at_least("common_mean_incremental_auc", t["min_min_incremental_auc"]),
        "balanced_accuracy": at_least("mean_balanced_accuracy", t["min_mean_balanced_accuracy"]),
        "baseline_delta": at_least("mean_baseline_delta", t["min_mean_accuracy_delta"]),
        "years": at_least("common_positive_incremental_auc_years", t["min_years_positive_incremental_auc"]),
        "common_level": at_least("common_mean_roc_auc", t["min_mean_roc_auc"]),
        "non_overlap": non_overlap,
    }, {
        "roc_auc": at_least("mean_roc_auc", t["strong_min_mean_roc_auc"]),
        "increment": at_least("common_mean_incremental_auc", t["strong_min_incremental_auc"]),
        "years": at_least("common_positive_incremental_auc_years", t["strong_min_years_positive_incremental_auc"]),
    }, ("STRONGLY_PROMISING", "SIGNAL_PASS", "SIGNAL_FAIL"))


def breadth_gate(df: DataFrame, t: dict[str, float]) -> DataFrame:
    """Signal gate with ticker breadth and every fold above chance and baseline."""
    return gate(df, {
        "macro_accuracy": at_least("mean_macro_accuracy", t["min_mean_macro_accuracy"]),
        "roc_auc": at_least("mean_roc_auc", t["min_mean_roc_auc"]),
        "beats_baseline_every_fold": F.col("years_beating_majority_baseline") == F.col("n_folds"),
        "roc_auc_every_fold": at_least("min_year_roc_auc", t["min_auc_per_fold"]),
        "ticker_fraction": at_least("mean_ticker_fraction_beating_own_baseline", t["min_fraction_tickers_beating_baseline"]),
    })


def schedule_gate(df: DataFrame) -> DataFrame:
    """Three-way verdict of a training schedule against its majority baseline.

    Needs mean_accuracy, mean_majority_accuracy, mean_f1, mean_brier and beating_majority_pct.
    """
    over = F.col("mean_accuracy") - F.col("mean_majority_accuracy")
    useful = F.col("mean_f1") >= 0.52
    promising = ((over > 0.005) & ((F.col("beating_majority_pct") >= 55.0) | useful) & (F.col("mean_brier") < 0.25)
                 & (F.col("beating_majority_pct") > 0))
    verdict = F.when(promising, "PROMISING").when((over > 0) | useful, "WEAK").otherwise("ABSENT")
    return df.withColumns({"accuracy_over_majority": over, "verdict": verdict}).withColumn(
        "proceed", F.col("verdict") == "PROMISING")


def context_gate(pairs: DataFrame, mean_macro: float, min_delta: float, min_auc: float) -> DataFrame:
    """Whether a variant with context is worth its complexity over the one without.

    ``pairs``: mean_macro_accuracy, mean_roc_auc and beats_every_fold of the
    variant, base_mean_macro_accuracy of its base.
    """
    delta = F.col("mean_macro_accuracy") - F.col("base_mean_macro_accuracy")
    level = at_least("mean_macro_accuracy", mean_macro) & F.col("beats_every_fold")
    gain = (delta >= min_delta) & F.col("beats_every_fold") & at_least("mean_roc_auc", min_auc)
    return pairs.withColumns({"delta_over_base": delta, "ok_level": F.coalesce(level, F.lit(False)),
                              "ok_gain": F.coalesce(gain, F.lit(False))}).withColumn(
        "passed", F.col("ok_level") | F.col("ok_gain"))


def adaptation_verdict(deltas: DataFrame, cells: list[str], material: float = 0.005, small: float = 0.005,
                       severe: float = -0.01) -> DataFrame:
    """Classify a variant by its per-fold gains over its predecessor (column ``delta``)."""
    d = F.col("delta")
    out = deltas.groupBy(*cells).agg(F.avg(d).alias("mean_delta"), F.min(d).alias("min_delta"),
                                     count_where(d <= severe).alias("severe_folds"))
    word = (F.when(F.col("mean_delta").isNull(), "UNKNOWN").when(F.col("mean_delta") < 0, "WORSE")
            .when(F.col("mean_delta") < small, "SMALL").when(F.col("severe_folds") > 0, "UNSTABLE").otherwise("MATERIAL"))
    better = (F.col("mean_delta") >= material) & (F.col("min_delta") > 0) & (F.col("severe_folds") == 0)
    return out.withColumns({"classification": word, "materially_better": F.coalesce(better, F.lit(False))})


def multitask_gate(deltas: DataFrame, min_macro: float = 0.005, min_auc: float = 0.01, min_brier: float = 0.002,
                   max_drop: float = 0.01) -> DataFrame:
    """A real gain in one figure and no fold falling by more than ``max_drop``."""
    gain = ((F.col("macro_gain") >= min_macro) | F.coalesce(F.col("auc_gain") >= min_auc, F.lit(False))
            | F.coalesce(F.col("brier_gain") >= min_brier, F.lit(False)))
    return deltas.withColumn("improves", gain & (F.col("worst_fold_delta") >= -max_drop))


def ranked(df: DataFrame, by: list[tuple[str, str]], cells: list[str] | None = None) -> DataFrame:
    """Add ``rank`` by the given (column, direction) keys in order; a missing figure ranks last."""
    order = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in by]
    part = cells if cells else [F.lit(0)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


# Ranking keys.
HORIZON_ORDER = [("mean_roc_auc", "desc"), ("mean_balanced_accuracy", "desc"), ("mean_brier", "asc"),
                 ("min_year_roc_auc", "desc"), ("mean_ticker_fraction_beating_own_baseline", "desc"), ("horizon", "asc")]
FAMILY_ORDER = [("common_mean_roc_auc", "desc"), ("common_mean_incremental_auc", "desc"),
                ("mean_balanced_accuracy", "desc"), ("mean_brier", "asc"), ("min_year_roc_auc", "desc")]
WINNER_ORDER = [("mean_macro_accuracy", "desc"), ("mean_roc_auc", "desc"), ("mean_brier", "asc")]


def rank_horizons(gated: DataFrame) -> DataFrame:
    """Passing horizons in order of quality."""
    return ranked(gated.where("passed"), HORIZON_ORDER)


def seed_stability(aggregates: DataFrame, cells: list[str], max_std: float = 0.015) -> DataFrame:
    """Spread over seeds, sign changes of the baseline gain along the seeds, and the verdict."""
    w = Window.partitionBy(*cells).orderBy("seed")
    flipped = F.signum("mean_baseline_delta") != F.lag(F.signum("mean_baseline_delta")).over(w)
    df = aggregates.withColumn("_flip", F.coalesce(flipped, F.lit(False)))
    spread = []
    for c in ("mean_accuracy", "mean_macro_accuracy", "mean_balanced_accuracy", "mean_roc_auc", "mean_brier"):
        spread += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
                   F.max(c).alias(f"{c}_max")]
    out = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n_seeds"), *spread, F.count_if("_flip").alias("sign_changes"))
    stable = (F.col("mean_macro_accuracy_std") <= max_std) & (F.col("sign_changes") == 0)
    return out.withColumn("classification", F.when(F.coalesce(stable, F.lit(False)), "STABLE").otherwise("UNSTABLE"))


def deltas(scores: DataFrame, keys: list[str], label: str, current: str, previous: str, metrics: list[str]) -> DataFrame:
    """Metric differences between two variants on the same keys."""
    a = scores.where(F.col(label) == current).select(*keys, *metrics)
    b = scores.where(F.col(label) == previous).select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    return a.join(b, keys).select(*keys, F.lit(current).alias("current"), F.lit(previous).alias("previous"),
                         *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics])


def reference_comparison(scores: DataFrame, published: DataFrame, metrics: list[str]) -> DataFrame:
    """Unweighted means over (ticker, fold) rows per model next to published figures."""
    means = scores.groupBy("model").agg(*[F.avg(m).alias(f"{m}_measured") for m in metrics],
                                        F.count(F.lit(1)).alias("n_runs"))
    ref = published.select("model", *[F.col(m).alias(f"{m}_published") for m in metrics])
    df = ref.join(means, "model", "left")
    return df.withColumns({f"{m}_difference": F.col(f"{m}_measured") - F.col(f"{m}_published") for m in metrics})


def best_epoch_summary(runs: DataFrame, cells: list[str]) -> DataFrame:
    """Best-epoch statistics and shares of the four buckets."""
    e = F.col("best_epoch")
    return runs.where(e.isNotNull()).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_fits"), F.percentile("best_epoch", F.lit(0.5)).alias("median_best_epoch"),
        F.avg(e).alias("mean_best_epoch"), F.max(e).alias("max_best_epoch"),
        F.avg((e <= 3).cast("double")).alias("frac_le_3"), F.avg(e.between(4, 6).cast("double")).alias("frac_4_to_6"),
        F.avg(e.between(7, 10).cast("double")).alias("frac_7_to_10"), F.avg((e > 10).cast("double")).alias("frac_gt_10"))


def epoch_histogram(runs: DataFrame, cells: list[str]) -> DataFrame:
    return runs.where(F.col("best_epoch").isNotNull()).groupBy(*cells, "best_epoch").agg(F.count(F.lit(1)).alias("n"))


def cause_ranking(causes: DataFrame, legitimate: float, margin: float = 0.02, min_retained: float = 20.0) -> DataFrame:
    """Candidate causes with their accuracy gain over the legitimate figure; the best of each cause counts.

    ``causes``: cause, accuracy, retained_pct.  A gain on too thin a slice does
    not support a cause.
    """
    best = causes.groupBy("cause").agg(F.max_by(F.struct("accuracy", "retained_pct"), F.struct("accuracy", "retained_pct")).alias("_b"))
    gain = F.col("_b.accuracy") - F.lit(legitimate)
    enough = F.coalesce(F.col("_b.retained_pct"), F.lit(100.0)) >= min_retained
    out = best.select("cause", F.col("_b.accuracy").alias("accuracy"), gain.alias("delta"),
                      (gain > margin).alias("material"),
                      F.when((gain > margin) & enough, "SUPPORTED").otherwise("NOT_SUPPORTED").alias("verdict"))
    return ranked(out, [("delta", "desc"), ("cause", "asc")])


def leakage_inflation(probes: DataFrame, control: str, explains: float = 0.10) -> DataFrame:
    """Accuracy of each deliberately wrong probe above the correct control."""
    base = F.max(F.when(F.col("probe") == control, F.col("accuracy"))).over(Window.partitionBy(F.lit(0)))
    df = probes.withColumn("_base", base).where(F.col("probe") != control)
    return df.select("probe", "accuracy", (F.col("accuracy") - F.col("_base")).alias("inflation"),
                     F.when(F.col("accuracy") - F.col("_base") > explains, "EXPLAINS_INFLATION").otherwise(
                         "INSUFFICIENT_TO_EXPLAIN").alias("verdict"))
