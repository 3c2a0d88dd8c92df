"""Evaluation of prediction tables.

A prediction table has ticker, origin_date, target_date, y_true (0/1), p_up and
optionally future_log_return; ``cells`` are the columns whose combinations are
scored apart (model, fold, horizon, view).  All cells are scored together.
Figures that an empty or one-class cell leaves undefined are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, count_where, ratio
from ..plans.skew import average_ranks, frozen, join_groups, positions, quantiles, running

COVERAGE_LEVELS = (1.0, 0.75, 0.5, 0.3, 0.2, 0.1)
CONFIDENCE_FLOORS = (0.55, 0.60, 0.70, 0.80)
BINS = 10

def _called() -> Column:
    """1 where the call is up."""
    return (F.col("p_up") >= 0.5).cast("int")


def _hit() -> Column:
    return (_called() == F.col("y_true")).cast("int")


def _edges(bins: int) -> list[float]:
    """Bin edges as multiples of the width, the way an even grid is laid."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def confusion_sums() -> list[Column]:
    """True and false positives and negatives as partial sums."""
    p, y = _called() == 1, F.col("y_true") == 1
    return [count_where(p & y).alias("tp"), count_where(p & ~y).alias("fp"), count_where(~p & ~y).alias("tn"),
            count_where(~p & y).alias("fn")]


def accuracy_of() -> Column:
    return ratio((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def f1_of() -> Column:
    """F1, 0 where it is undefined for want of positives."""
    return F.coalesce(ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def balanced_of() -> Column:
    """Mean of the two recalls; NULL unless both classes occur."""
    up = ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    down = ratio(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    return (up + down) / 2.0


def direction_scores(pred: DataFrame, cells: list[str]) -> DataFrame:
    """Accuracy, F1, balanced accuracy, Brier, positive rate and mean confidence per cell."""
    err = F.col("p_up") - F.col("y_true")
    sums = pred.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("n_tickers"), *confusion_sums(),
        F.avg(err * err).alias("_brier"), F.avg(F.col("y_true").cast("double")).alias("positive_rate"),
        F.avg(F.abs(F.col("p_up") - 0.5)).alias("mean_confidence"))
    two = (F.col("positive_rate") > 0) & (F.col("positive_rate") < 1)
    return sums.select(*cells, "n", "n_tickers", accuracy_of().alias("accuracy"), f1_of().alias("f1"),
                       balanced_of().alias("balanced_accuracy"), F.when(two, F.col("_brier")).alias("brier"),
                       "positive_rate", "mean_confidence")


def roc_auc(pred: DataFrame, cells: list[str]) -> DataFrame:
    """Area under the curve with ties at half weight; NULL unless both classes occur.

    Scores are merged first; the running count of negatives below a score is
    taken over distinct scores, in slices when a cell is large.
    """
    scores = pred.groupBy(*cells, "p_up").agg(F.sum(F.col("y_true").cast("bigint")).alias("_pos"),
                                              F.sum((1 - F.col("y_true")).cast("bigint")).alias("_neg"))
    below = running(scores, cells, [F.col("p_up").asc()], {"_below": F.col("_neg")})
    out = below.groupBy(*cells).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return out.select(*cells, ratio(F.col("_u"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def _binned(pred: DataFrame, bins: int) -> DataFrame:
    """Add ``bin``: equal width, closed on the left, the last closed on both sides."""
    index = F.lit(0)
    for e in _edges(bins):
        index = index + (F.col("p_up") >= F.lit(e)).cast("int")
    return pred.where(F.col("p_up").between(0.0, 1.0)).withColumn("bin", index)


def reliability(pred: DataFrame, cells: list[str], bins: int = BINS) -> DataFrame:
    """Per non-empty bin: rows, mean probability, mean outcome."""
    return _binned(pred, bins).groupBy(*cells, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_up").alias("mean_probability"),
        F.avg(F.col("y_true").cast("double")).alias("mean_outcome"))


def calibration_error(pred: DataFrame, cells: list[str], bins: int = BINS) -> DataFrame:
    """Expected calibration error."""
    gap = F.abs(F.col("mean_outcome") - F.col("mean_probability"))
    return reliability(pred, cells, bins).groupBy(*cells).agg(
        ratio(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"))


def confusion(pred: DataFrame, cells: list[str]) -> DataFrame:
    return pred.groupBy(*cells, "y_true", _called().alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def ticker_accuracy(pred: DataFrame, cells: list[str]) -> DataFrame:
    return pred.groupBy(*cells, "ticker").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_hit().cast("double")).alias("accuracy"),
        F.avg(F.col("y_true").cast("double")).alias("positive_rate"))


def macro_accuracy(pred: DataFrame, cells: list[str]) -> DataFrame:
    """Mean of the tickers' accuracies: every ticker counts once."""
    return ticker_accuracy(pred, cells).groupBy(*cells).agg(F.avg("accuracy").alias("macro_ticker_accuracy"))


def majority_baselines(train: DataFrame, validation: DataFrame, cells: list[str], label: str = "y_true") -> DataFrame:
    """Three notions kept apart: train majority share, its class scored on validation, validation's own rate."""
    t = train.groupBy(*cells).agg(F.avg(F.col(label).cast("double")).alias("_t"), F.count(F.lit(1)).alias("n_train"))
    v = validation.groupBy(*cells).agg(F.avg(F.col(label).cast("double")).alias("_v"),
                                       F.count(F.lit(1)).alias("n_validation"))
    df = t.join(v, cells)
    return df.select(
        *cells, "n_train", "n_validation", F.greatest(F.col("_t"), 1.0 - F.col("_t")).alias("train_majority_share"),
        F.when(F.col("_t") >= 0.5, F.col("_v")).otherwise(1.0 - F.col("_v")).alias("train_majority_on_validation"),
        F.greatest(F.col("_v"), 1.0 - F.col("_v")).alias("validation_oracle_rate"))


def _ends(pred: DataFrame, cells: list[str], k: int, date: str) -> DataFrame:
    """The k highest and k lowest of each date.

    The row-number filter is applied in every map task before the shuffle, so
    a date of any size sends only a few rows.
    """
    by = [*cells, date]
    top = Window.partitionBy(*by).orderBy(F.col("p_up").desc(), "ticker")
    low = Window.partitionBy(*by).orderBy(F.col("p_up").asc(), "ticker")
    cols = [*by, "ticker", "y_true", "p_up"]
    up = pred.select(*cols).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k).withColumn(
        "side", F.lit("up"))
    down = pred.select(*cols).withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= k).withColumn(
        "side", F.lit("down"))
    right = F.when(F.col("side") == "up", F.col("y_true") == 1).otherwise(F.col("y_true") == 0)
    return up.unionByName(down).withColumn("_right", right.cast("double"))


def selections_at_k(pred: DataFrame, cells: list[str], k: int = 3, date: str = "target_date") -> DataFrame:
    """Per date with at least k rows: precision of both ends and the chosen tickers, best first."""
    picks = _ends(pred, cells, k, date)
    sizes = pred.groupBy(*cells, date).agg(F.count(F.lit(1)).alias("n_available"))

    def side(s: str) -> list[Column]:
        mine = F.col("side") == s
        chosen = F.array_sort(F.collect_list(F.when(mine, F.struct("_r", "ticker"))))
        return [F.avg(F.when(mine, F.col("_right"))).alias(f"{s}_precision"),
                F.array_join(F.transform(chosen, lambda x: x["ticker"]), ",").alias(f"{s}_tickers")]

    out = picks.groupBy(*cells, date).agg(*side("up"), *side("down"))
    return out.join(sizes, [*cells, date]).where(F.col("n_available") >= k)


def precision_at_k(pred: DataFrame, cells: list[str], k: int = 3, date: str = "target_date") -> DataFrame:
    """Mean over dates of the share of right calls among the k highest and k lowest; short dates skipped."""
    per_date = selections_at_k(pred, cells, k, date)
    return per_date.groupBy(*cells).agg(F.avg("up_precision").alias(f"precision_at_{k}_up"),
                                        F.avg("down_precision").alias(f"precision_at_{k}_down"),
                                        F.count(F.lit(1)).alias("n_dates"))


def pooled_precision_at_k(pred: DataFrame, cells: list[str], k: int = 3, date: str = "target_date") -> DataFrame:
    """Share of right calls over all picks together, short dates included."""
    mine = F.col("side") == "up"
    return _ends(pred, cells, k, date).groupBy(*cells).agg(
        F.avg(F.when(mine, F.col("_right"))).alias(f"precision_at_{k}_up"),
        F.avg(F.when(~mine, F.col("_right"))).alias(f"precision_at_{k}_down"))


def coverage_curve(pred: DataFrame, cells: list[str], levels: tuple[float, ...] = COVERAGE_LEVELS) -> DataFrame:
    """Scores of the most confident share of rows, one row per cell and level.

    Rows are ordered by confidence, then ticker and date; a level keeps
    ``round(level * n)`` rows (half to even, at least one).
    """
    if not cells:
        return coverage_curve(pred.withColumn("_all", F.lit(0)), ["_all"], levels).drop("_all")
    conf = F.abs(F.col("p_up") - 0.5)
    ordered = positions(pred.withColumn("_conf", conf), cells,
                        [F.col("_conf").desc(), F.col("ticker").asc(), F.col("origin_date").asc()], "_i")
    sizes = pred.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    df = ordered.join(sizes, cells)
    kept = F.array_compact(F.array(*[F.when(
        F.col("_i") < F.greatest(F.bround(F.lit(v) * F.col("_n")).cast("bigint"), F.lit(1)), F.lit(v)) for v in levels]))
    # A row is sent to the levels that keep it, already summed per cell and level.
    df = df.withColumn("coverage_target", F.explode(kept))
    out = df.groupBy(*cells, "coverage_target").agg(
        F.count(F.lit(1)).alias("n"), F.max("_n").alias("_n"), F.count_distinct("ticker").alias("n_tickers"),
        F.avg("_conf").alias("mean_confidence"), *confusion_sums())
    return out.select(*cells, "coverage_target", "n", (F.col("n") / F.col("_n")).alias("coverage_retained"),
                      accuracy_of().alias("accuracy"), balanced_of().alias("balanced_accuracy"), f1_of().alias("f1"),
                      "n_tickers", "mean_confidence")


def coverage_at_accuracy(curve: DataFrame, cells: list[str], threshold: float, min_rows: int = 200,
                         min_coverage: float = 0.10) -> DataFrame:
    """Highest coverage whose accuracy reaches the threshold with enough rows and coverage."""
    ok = (F.col("accuracy") >= threshold) & (F.col("n") >= min_rows) & (F.col("coverage_retained") >= min_coverage)
    best = F.max_by(F.struct("coverage_target", "coverage_retained", "accuracy", "n"),
                    F.when(ok, F.struct("coverage_retained", "accuracy")))
    out = curve.groupBy(*cells).agg(best.alias("_b"), F.max("accuracy").alias("max_accuracy_seen"))
    return out.select(*cells, F.lit(threshold).alias("threshold"), F.col("_b.coverage_target").alias("coverage_target"),
                      F.col("_b.coverage_retained").alias("coverage"), F.col("_b.accuracy").alias("accuracy"),
                      F.col("_b.n").alias("n"), "max_accuracy_seen",
                      F.when(F.col("_b").isNotNull(), "ESTABLISHED").otherwise("NOT_ESTABLISHED").alias("status"))


def coverage_across_folds(points: DataFrame, cells: list[str], n_folds: int) -> DataFrame:
    """Mean coverage over folds, only where every fold reached the accuracy."""
    return points.groupBy(*cells, "threshold").agg(
        F.count("coverage").alias("_k"), F.avg("coverage").alias("_c"), F.avg("accuracy").alias("_a")).select(
        *cells, "threshold", F.when(F.col("_k") == n_folds, F.col("_c")).alias("coverage_mean"),
        F.when(F.col("_k") == n_folds, F.col("_a")).alias("accuracy_mean"))


def confidence_floors(pred: DataFrame, cells: list[str], floors: tuple[float, ...] = CONFIDENCE_FLOORS) -> DataFrame:
    """Scores of the rows whose ``max(p, 1-p)`` reaches each floor; floor 0 is all rows."""
    conf = F.greatest(F.col("p_up"), 1.0 - F.col("p_up"))
    rows = []
    for f in (0.0, *floors):
        keep = conf >= f
        p, y = _called() == 1, F.col("y_true") == 1
        rows.append(F.struct(F.lit(f).alias("threshold"), count_where(keep).alias("n"),
                             count_where(keep & p & y).alias("tp"), count_where(keep & p & ~y).alias("fp"),
                             count_where(keep & ~p & ~y).alias("tn"), count_where(keep & ~p & y).alias("fn")))
    out = pred.groupBy(*cells).agg(F.count(F.lit(1)).alias("_all"), F.array(*rows).alias("_r"))
    out = out.select(*cells, "_all", F.inline("_r"))
    return out.select(*cells, "threshold", "n", (F.col("n") / F.col("_all") * 100).alias("retained_pct"),
                      accuracy_of().alias("accuracy"), F.when(F.col("n") > 0, f1_of()).alias("f1"))


def aggregation_conventions(pred: DataFrame, fold: str = "fold", date: str = "target_date") -> DataFrame:
    """Accuracy (and F1) under every averaging convention, side by side."""
    per_fold = pred.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *confusion_sums()).withColumns(
        {"accuracy": accuracy_of(), "f1": f1_of()})
    folds = per_fold.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("tn").alias("tn"), F.sum("fn").alias("fn"),
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_folds"), F.avg("accuracy").alias("_eq_a"),
        F.avg("f1").alias("_eq_f"), (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("_w_a"),
        (F.sum(F.col("f1") * F.col("n")) / F.sum("n")).alias("_w_f"))

    def row(name, acc, f1, n) -> Column:
        return F.struct(F.lit(name).alias("convention"), acc.alias("accuracy"), f1.cast("double").alias("f1"),
                        n.cast("bigint").alias("n_units"))

    none = F.lit(None)
    by_fold = folds.select(F.inline(F.array(
        row("micro", accuracy_of(), f1_of(), F.col("_n")),
        row("equal_fold_average", F.col("_eq_a"), F.col("_eq_f"), F.col("_folds")),
        row("sample_weighted_fold_average", F.col("_w_a"), F.col("_w_f"), F.col("_folds")))))

    def macro(key: str, name: str) -> DataFrame:
        each = pred.groupBy(key).agg(F.avg(_hit().cast("double")).alias("_a"))
        return each.agg(F.avg("_a").alias("_a"), F.count(F.lit(1)).alias("_k")).select(
            F.inline(F.array(row(name, F.col("_a"), none, F.col("_k")))))

    return by_fold.unionByName(macro("ticker", "macro_ticker")).unionByName(macro(date, "macro_date"))


def ticker_labels(train: DataFrame, cells: list[str]) -> DataFrame:
    """Training labels summed per cell and ticker, all that a baseline needs; sums stay as they are."""
    if {"_up", "_rows"} <= set(train.columns):
        return train
    return train.groupBy(*cells, "ticker").agg(F.sum(F.col("y_true").cast("bigint")).alias("_up"),
                                               F.count(F.lit(1)).alias("_rows"))


def _majority(up: Column, rows: Column) -> Column:
    share = up / rows
    return F.greatest(share, 1.0 - share)


def ticker_breadth(pred: DataFrame, train: DataFrame, cells: list[str]) -> DataFrame:
    """Each ticker's accuracy against its own train-majority share."""
    base = ticker_labels(train, cells).select(*cells, "ticker", _majority(F.col("_up"), F.col("_rows")).alias("baseline"))
    return ticker_accuracy(pred, cells).join(base, [*cells, "ticker"], "left").withColumn(
        "beats", F.col("accuracy") > F.col("baseline")).drop("positive_rate")


def breadth_summary(breadth: DataFrame, cells: list[str]) -> DataFrame:
    """Tickers beating their own baseline and quartiles of ticker accuracy."""
    spread = quantiles(breadth, cells, "accuracy", {"p25_accuracy": 0.25, "median_accuracy": 0.5, "p75_accuracy": 0.75})
    counts = breadth.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_tickers"), count_where(F.col("beats")).alias("n_beating"),
        F.avg(F.col("beats").cast("double")).alias("fraction_beating"))
    return counts.join(spread, cells)


def breadth_extremes(breadth: DataFrame, cells: list[str], k: int = 5) -> DataFrame:
    """The k best and k worst tickers of a cell."""
    hi = Window.partitionBy(*cells).orderBy(F.col("accuracy").desc(), "ticker")
    lo = Window.partitionBy(*cells).orderBy(F.col("accuracy").asc(), "ticker")
    best = breadth.withColumn("place", F.row_number().over(hi)).where(F.col("place") <= k).withColumn("end", F.lit("best"))
    worst = breadth.withColumn("place", F.row_number().over(lo)).where(F.col("place") <= k).withColumn("end", F.lit("worst"))
    return best.unionByName(worst)


def return_magnitude(pred: DataFrame, cells: list[str], ret: str = "future_log_return") -> DataFrame:
    """Size of the move to be called: medians, means and deviations, signed and absolute."""
    rows = pred.where(F.col(ret).isNotNull()).withColumn("_abs", F.abs(ret))
    sums = rows.groupBy(*cells).agg(
        F.avg(ret).alias("future_return_mean"), F.stddev_samp(ret).alias("future_return_std"),
        F.avg("_abs").alias("abs_future_return_mean"), F.stddev_samp("_abs").alias("abs_future_return_std"),
        F.avg((F.col(ret) > 0).cast("double")).alias("up_fraction"))
    signed = quantiles(rows, cells, ret, {"future_return_median": 0.5})
    size = quantiles(rows, cells, "_abs", {"abs_future_return_median": 0.5})
    return sums.join(signed, cells).join(size, cells)


def confidence_magnitude(pred: DataFrame, cells: list[str], ret: str = "future_log_return") -> DataFrame:
    """Correlation of confidence with the size of the move, plain and by rank (at least three rows)."""
    rows = pred.where(F.col(ret).isNotNull() & F.col("p_up").isNotNull()).withColumns(
        {"confidence": F.abs(F.col("p_up") - 0.5), "magnitude": F.abs(ret)})
    ranked = average_ranks(rows, cells, {"confidence": "_rc", "magnitude": "_rm"}, percent=False)
    return ranked.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, correlation(F.col("confidence"), F.col("magnitude"))).alias("pearson"),
        F.when(F.count(F.lit(1)) >= 3, correlation(F.col("_rc"), F.col("_rm"))).alias("spearman"))


def return_scores(pred: DataFrame, cells: list[str], predicted: str, actual: str) -> DataFrame:
    """Errors and correlations of a return forecast; correlations need three rows and some spread."""
    rows = pred.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    ranked = average_ranks(rows, cells, {predicted: "_rp", actual: "_ra"}, percent=False)
    err = F.col(predicted) - F.col(actual)
    ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop(predicted) > 0) & (F.stddev_pop(actual) > 0)
    return ranked.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(ok, correlation(F.col(predicted), F.col(actual))).alias("pearson"), F.when(ok, correlation(F.col("_rp"), F.col("_ra"))).alias("spearman"))


def daily_rank_ic(pred: DataFrame, cells: list[str], predicted: str, actual: str, date: str = "target_date"
                  ) -> DataFrame:
    """Rank correlation of forecast and outcome on each date with at least three rows."""
    by = [*cells, date]
    rows = pred.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    ranked = average_ranks(rows, by, {predicted: "_rp", actual: "_ra"}, percent=False)
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_rp").alias("_sp"),
                                  F.stddev_pop("_ra").alias("_sa"), correlation(F.col("_rp"), F.col("_ra")).alias("_ic"))
    flat = (F.col("_sp") == 0) | (F.col("_sa") == 0)
    # Twelve digits: a correlation of ranks that is zero must not count as positive for its last bits.
    return out.where(F.col("n") >= 3).select(*by, "n", F.when(~flat, F.round("_ic", 12) + F.lit(0.0)).alias("rank_ic"))


def rank_ic_summary(daily: DataFrame, cells: list[str]) -> DataFrame:
    ic = F.col("rank_ic")
    return daily.where(ic.isNotNull()).groupBy(*cells).agg(
        F.avg(ic).alias("mean_rank_ic"), F.stddev_samp(ic).alias("std_rank_ic"), F.count(ic).alias("n_days"),
        F.avg((ic > 0).cast("double")).alias("positive_fraction"))


def head_agreement(pred: DataFrame, cells: list[str], logit: str, ret: str, rank: str) -> DataFrame:
    """Coverage and accuracy where three heads point the same way, and pairwise agreement."""
    rows = pred.where(F.col(logit).isNotNull() & F.col(ret).isNotNull() & F.col(rank).isNotNull())
    a, b, c = F.col(logit) >= 0, F.col(ret) >= 0, F.col(rank) >= 0.5
    agree, right = (a == b) & (b == c), a.cast("int") == F.col("y_true")
    return rows.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), count_where(agree).alias("n_agree"),
        F.avg(agree.cast("double")).alias("coverage"), F.avg(F.when(agree, right.cast("double"))).alias("accuracy_when_agreeing"),
        F.avg(right.cast("double")).alias("accuracy_all"), F.avg((a == b).cast("double")).alias("direction_vs_return"),
        F.avg((a == c).cast("double")).alias("direction_vs_rank"), F.avg((b == c).cast("double")).alias("return_vs_rank"))


def direction_block(pred: DataFrame, train: DataFrame, cells: list[str]) -> DataFrame:
    """The full score block of every cell in one row.

    ``train`` holds training labels or their stored ``ticker_labels``; labels are
    summed once and the sums stored, as two parts of the block read them.
    """
    if "_up" not in train.columns:
        train = frozen(ticker_labels(train, cells))
    baseline = train.groupBy(*cells).agg(
        _majority(F.sum("_up"), F.sum("_rows")).alias("train_majority_baseline"))
    breadth = ticker_breadth(pred, train, cells).groupBy(*cells).agg(
        F.avg("accuracy").alias("macro_ticker_accuracy"), count_where(F.col("beats")).alias("tickers_beating_own_baseline"),
        F.avg(F.col("beats").cast("double")).alias("ticker_fraction_beating_own_baseline"))
    out = direction_scores(pred, cells)
    for part in (roc_auc(pred, cells), calibration_error(pred, cells), breadth):
        out = out.join(part, cells)
    out = out.join(baseline, cells, "left")
    return out.withColumns({"baseline_delta": F.col("accuracy") - F.col("train_majority_baseline"),
                            "macro_baseline_delta": F.col("macro_ticker_accuracy") - F.col("train_majority_baseline")})


def direction_and_returns(pred: DataFrame, train: DataFrame, cells: list[str]) -> DataFrame:
    """The score block with the size of the moves and how confidence goes with it, one row per cell.

    A cell without a return keeps its scores, with NULL for the rest.
    """
    moves = confidence_magnitude(pred, cells).select(
        *cells, F.col("pearson").alias("confidence_magnitude_pearson"), F.col("spearman").alias("confidence_magnitude_spearman"))
    out = direction_block(pred, train, cells)
    for part in (return_magnitude(pred, cells), moves):
        out = join_groups(out, part, cells, "left")
    return out


def mean_over_tickers(scores: DataFrame, cells: list[str], columns: list[str]) -> DataFrame:
    """Plain means over tickers; absent figures are skipped."""
    return scores.groupBy(*cells).agg(*[F.avg(c).alias(c) for c in columns],
                                      F.count_distinct("ticker").alias("n_tickers"))


def correlation_audit(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """Widest absolute correlation between two columns and pairs beyond the threshold, over complete rows.

    All pairs come out of one pass; the number of pairs is fixed by the schema.
    """
    complete = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = complete.agg(F.array(*[F.abs(correlation(F.col(a), F.col(b))) for a, b in pairs]).alias("_c"))
    present = F.filter("_c", lambda x: x.isNotNull() & ~F.isnan(x))
    return wide.select(F.array_max(present).alias("max_abs_correlation"),
                       F.size(F.filter(present, lambda x: x > threshold)).alias("n_pairs_above"))


def importance_ranking(values: DataFrame, cells: list[str], value: str = "importance", k: int = 20) -> DataFrame:
    """The k features of largest absolute importance."""
    w = Window.partitionBy(*cells).orderBy(F.abs(value).desc(), "feature")
    return values.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

