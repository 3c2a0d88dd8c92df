"""Standard assemblies: from bars to scored predictions.

Predictions are a stored table, as every metric passes over them more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cross_section import add_ranks
from ..operators.panel_features import panel_features
from ..operators.splits import anchored_folds, assign_folds
from ..operators.targets import HORIZONS, horizon_targets, next_day_targets, view_flags
from . import views
from .skew import frozen

FIRST_YEAR, LAST_YEAR = 1998, 2000
FOLDS = anchored_folds("Y", "1995-01-01", range(FIRST_YEAR, LAST_YEAR + 1))


def momentum_scores(bars: DataFrame, names: dict[str, str]) -> DataFrame:
    """(ticker, date, names): the date percentiles of features as scores without parameters; rows that have them all."""
    feats = add_ranks(panel_features(bars, list(names)), tuple(names))
    return feats.select("ticker", "date", *[F.col(f"rank_{source}").alias(n) for source, n in names.items()]).dropna(
        subset=list(names.values()))


def momentum_score(bars: DataFrame, source: str = "log_return_5") -> DataFrame:
    """(ticker, origin_date, p_up): the date percentile of a feature as a score without parameters."""
    return momentum_scores(bars, {source: "p_up"}).withColumnRenamed("date", "origin_date")


def _scored_bars(bars: DataFrame, names: dict[str, str]) -> DataFrame:
    """Closes with their scores, NULL where a bar has none: a bar is joined once, before its labels are taken.

    Labels are looked up along a ticker, so what is made of these rows lies together by ticker.
    """
    return bars.select("ticker", "date", "close").join(momentum_scores(bars, names), ["ticker", "date"], "left")


def stored_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Stored daily bars: labels, score, the size check of the ranks and training labels all read them."""
    return frozen(views.bars(spark, sf))


def _folded(df: DataFrame) -> DataFrame:
    """Rows whose origin and target lie in the same evaluation year, with ``fold`` = that year."""
    year = F.year("origin_date")
    return df.where(year.between(FIRST_YEAR, LAST_YEAR) & (F.year("target_date") == year)).withColumn("fold", year)


#: The score of the predictions.
SCORE = {"log_return_5": "p_up"}


def predictions(spark: SparkSession, sf: str, names: dict[str, str] = SCORE, bars: DataFrame | None = None) -> DataFrame:
    """One-row-ahead predictions of the own calendar, folds 1998 to 2000; ``names``: a score column for each feature."""
    scores = tuple(names.values())
    labels = next_day_targets(_scored_bars(bars or stored_bars(spark, sf), names), calendar="own", carry=scores).select(
        "ticker", "origin_date", "target_date", F.col("y_direction").alias("y_true"),
        F.col("raw_next_return").alias("future_log_return"), *scores)
    return frozen(_folded(labels.dropna(subset=list(scores))))


def _horizon_rows(bars: DataFrame) -> DataFrame:
    labels = horizon_targets(_scored_bars(bars, SCORE), carry=("p_up",)).select(
        "ticker", "origin_date", F.col("target_end_date").alias("target_date"), "horizon",
        F.col("y").alias("y_true"), "future_log_return", "p_up")
    return _folded(labels.where(F.col("p_up").isNotNull()))


def horizon_predictions(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """The same score against the label of every horizon."""
    return frozen(_horizon_rows(bars or stored_bars(spark, sf)))


def horizon_views(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """The same predictions with ``in_common`` and ``in_spaced``: views of one stored table, not copies of it."""
    return frozen(view_flags(_horizon_rows(bars or stored_bars(spark, sf)), len(HORIZONS), ("ticker", "horizon", "fold")))


def training_labels(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """Training labels of every fold (own next bar)."""
    labels = next_day_targets(bars or views.bars(spark, sf), calendar="own").select(
        "ticker", "origin_date", "target_date", F.col("y_direction").alias("y_true"))
    placed = assign_folds(labels, FOLDS).where(F.col("split") == "train")
    return placed.withColumn("fold", F.substring("fold", 2, 4).cast("int")).drop("split")


def horizon_training_labels(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    labels = horizon_targets(bars or views.bars(spark, sf)).select(
        "ticker", "origin_date", F.col("target_end_date").alias("target_date"), "horizon", F.col("y").alias("y_true"))
    placed = assign_folds(labels, FOLDS).where(F.col("split") == "train")
    return placed.withColumn("fold", F.substring("fold", 2, 4).cast("int")).drop("split")
