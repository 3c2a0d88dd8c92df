"""Forward-looking labels."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, ln, ratio
from ..functions.rolling import ahead
from ..plans.skew import average_ranks, with_date_table

HORIZONS = (1, 3, 5, 10)
VOL_FLOOR = 1e-4
RETURN_CLIP = 5.0


def next_day_targets(bars: DataFrame, features: DataFrame | None = None, calendar: str = "union",
                     max_date: dt.date | str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Direction, return, volatility-scaled return and rank of the next bar.

    ``calendar="union"``: the next date on which any security traded; a
    security without a bar there has no label.  ``calendar="own"``: the
    security's own next bar.  Columns of the bars named in ``carry`` come along
    where no features are given.
    """
    if calendar not in ("union", "own"):
        raise ValueError(f"unknown calendar {calendar!r}")
    rows = bars.select("ticker", F.col("date").alias("origin_date"), F.col("close").alias("close_t"), *carry).withColumns({
        "target_date": ahead(F.col("origin_date"), 1, order="origin_date"),
        "close_next": ahead(F.col("close_t"), 1, order="origin_date")})
    if calendar == "union":
        # A bar on the panel's next date is the security's own next bar, so one
        # lead and a table of dates (one bounded task) stand in for a self-join.
        days = bars.select(F.col("date").alias("origin_date")).distinct()
        nexts = days.withColumn("_next", F.lead("origin_date").over(Window.partitionBy(F.lit(0)).orderBy("origin_date")))
        rows = with_date_table(rows, nexts, "origin_date", "inner").where(F.col("target_date") == F.col("_next")).drop("_next")
    rows = rows.where(F.col("close_next").isNotNull() & F.col("target_date").isNotNull())
    if max_date is not None:
        rows = rows.where(F.col("target_date") <= F.lit(max_date).cast("date"))
    rows = rows.withColumns({
        "raw_next_return": ln(ratio(F.col("close_next"), F.col("close_t"))),
        "y_direction": (F.col("close_next") > F.col("close_t")).cast("int")})
    if features is None:
        return rows.select("ticker", "origin_date", "target_date", "close_t", "close_next", "raw_next_return",
                           "y_direction", *carry)
    vol = features.select("ticker", F.col("date").alias("origin_date"), "realized_vol_20")
    rows = rows.join(vol, ["ticker", "origin_date"], "left")
    scale = F.greatest(F.col("realized_vol_20"), F.lit(VOL_FLOOR))
    rows = rows.withColumn("y_return", F.when(
        F.col("realized_vol_20").isNotNull(), clip(F.col("raw_next_return") / scale, -RETURN_CLIP, RETURN_CLIP)))
    rows = average_ranks(rows, ["target_date"], {"raw_next_return": "y_rank"})
    return rows.select("ticker", "origin_date", "target_date", "realized_vol_20", "raw_next_return", "y_direction",
                       "y_return", "y_rank")


def horizon_targets(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS,
                    boundary: dt.date | str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The H-th future bar of the security itself, long by horizon.

    Bars past ``boundary`` are cut first, so no later close can finish a label;
    securities with fewer than ``max(horizons) + 1`` bars are left out.  Columns
    of the bars named in ``carry`` come along, so that what belongs to an origin
    is joined to a bar once and not to each of its labels.
    """
    if any(h < 1 for h in horizons):
        raise ValueError(f"horizons must be at least 1, got {horizons}")
    df = bars if boundary is None else bars.where(F.col("date") <= F.lit(boundary).cast("date"))
    c, d = F.col("close"), F.col("date")
    ends = F.array(*[F.struct(F.lit(h).alias("horizon"), ahead(d, h).alias("target_end_date"),
                              ahead(c, h).alias("close_t_plus_h")) for h in horizons])
    df = df.select("ticker", "date", "close", *carry, ends.alias("_ends"),
                   F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("_n"))
    df = df.where(F.col("_n") > max(horizons)).select("ticker", "date", "close", *carry, F.inline("_ends"))
    return df.where(F.col("target_end_date").isNotNull()).select(
        "ticker", F.col("date").alias("origin_date"), "target_end_date", "horizon",
        ln(ratio(F.col("close_t_plus_h"), c)).alias("future_log_return"),
        (F.col("close_t_plus_h") > c).cast("int").alias("y"), c.alias("close_t"), "close_t_plus_h", *carry)


def target_schema(targets: DataFrame) -> DataFrame:
    """Rows, tickers, date spans and positive rate of each horizon."""
    return targets.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"),
        F.min("origin_date").alias("first_origin_date"), F.max("origin_date").alias("last_origin_date"),
        F.max("target_end_date").alias("last_target_end_date"), F.avg("y").alias("positive_rate"))


def common_origins(targets: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Keys (ticker, origin_date) that have a label at every horizon.

    A flag a horizon: a distinct count would first hold every (key, horizon) as a group of its own.
    """
    return (targets.where(F.col("horizon").isin(*horizons)).groupBy("ticker", "origin_date")
            .agg(*[F.bool_or(F.col("horizon") == h).alias(f"_h{h}") for h in sorted(set(horizons))])
            .where(reduce(lambda a, h: a & F.col(f"_h{h}"), set(horizons), F.lit(True))).select("ticker", "origin_date"))


def keep_common(frame: DataFrame, keys: DataFrame) -> DataFrame:
    return frame.join(keys, ["ticker", "origin_date"], "left_semi")


def non_overlapping(frame: DataFrame, by: tuple[str, ...] = ("ticker", "horizon")) -> DataFrame:
    """Positions 0, H, 2H, ... of each series, so that holding periods do not overlap."""
    w = Window.partitionBy(*by).orderBy("origin_date")
    return (frame.withColumn("_pos", F.row_number().over(w) - 1)
            .where(F.col("_pos") % F.col("horizon") == 0).drop("_pos"))


def view_flags(frame: DataFrame, n_horizons: int, by: tuple[str, ...] = ("ticker", "horizon")) -> DataFrame:
    """Rows with ``in_common`` (their origin has a row at every horizon) and ``in_spaced`` (``non_overlapping`` keeps them).

    Both look at rows of one ticker only, so rows that lie together by ticker are not moved, and a view is a filter of one table.
    """
    at_origin = F.size(F.collect_set("horizon").over(Window.partitionBy("ticker", "origin_date")))
    pos = F.row_number().over(Window.partitionBy(*by).orderBy("origin_date")) - 1
    return frame.withColumns({"in_common": at_origin == n_horizons, "in_spaced": pos % F.col("horizon") == 0})


def overlap_spacing(frame: DataFrame) -> DataFrame:
    """Origins, tickers and smallest calendar gap between origins, per horizon."""
    w = Window.partitionBy("ticker", "horizon").orderBy("origin_date")
    gaps = frame.withColumn("_gap", F.date_diff(F.col("origin_date"), F.lag("origin_date").over(w)))
    return gaps.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_origins"), F.count_distinct("ticker").alias("n_tickers"),
        F.min("_gap").alias("min_gap_days"))


def control_mismatches(horizon_frame: DataFrame, next_day: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Agreement of the one-row horizon with another one-day label on shared keys."""
    a = horizon_frame.where(F.col("horizon") == 1).select(
        "ticker", "origin_date", "target_end_date", "y", "future_log_return")
    b = next_day.select("ticker", "origin_date", "target_date", "y_direction", "raw_next_return")
    shared = a.join(b, ["ticker", "origin_date"])
    return shared.agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.count_if(F.col("y") != F.col("y_direction")).alias("label_mismatches"),
        F.count_if(F.col("target_end_date") != F.col("target_date")).alias("date_mismatches"),
        F.count_if(F.abs(F.col("future_log_return") - F.col("raw_next_return")) > tolerance).alias(
            "return_mismatches"))


def alignment_audit(bars: DataFrame, targets: DataFrame) -> DataFrame:
    """Recompute next date and label of every stored target from raw bars and count differences."""
    truth = bars.select("ticker", F.col("date").alias("origin_date"),
                        ahead(F.col("date")).alias("true_date"),
                        (ahead(F.col("close")) > F.col("close")).cast("int").alias("true_y"))
    both = targets.join(truth, ["ticker", "origin_date"], "left")
    return both.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if(~F.col("target_date").eqNullSafe(F.col("true_date"))).alias("date_mismatches"),
        F.count_if(~F.col("y_direction").eqNullSafe(F.col("true_y"))).alias("label_mismatches"))
