"""Cross-sectional context: what a security is told about everyone else on a date.

Leave-one-out values come from per-date (or per sector and date) sums joined
back onto the rows, never from a self-join or from a window over a date, so a
date with any share of the rows is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.rolling import roll_max, roll_std, roll_sum
from ..plans.skew import average_ranks, frozen, quantiles, with_date_table
from ..session import passing_table

# Context schema, in order.
MARKET_FEATURES = (
    "market_return_mean", "market_return_median", "market_breadth", "market_dispersion", "market_momentum_5",
    "market_momentum_20", "market_realized_vol_20", "market_drawdown_60", "market_mean_volume_surprise",
    "market_available_count")
MARKET_LOO_FEATURES = (
    "market_return_mean_loo", "market_breadth_loo", "market_dispersion_loo", "market_momentum_5_loo",
    "market_momentum_20_loo", "market_realized_vol_20_loo", "market_drawdown_60_loo", "market_loo_available_count")
SECTOR_FEATURES = (
    "sector_return_mean", "sector_breadth", "sector_available_count", "sector_return_mean_loo",
    "sector_breadth_loo", "sector_dispersion_loo", "sector_momentum_5_loo", "sector_momentum_20_loo",
    "sector_realized_vol_20_loo", "sector_loo_available_count")
RELATIVE_FEATURES = (
    "stock_minus_market_return", "stock_minus_sector_return", "momentum_5_minus_market", "momentum_20_minus_market",
    "momentum_5_minus_sector", "momentum_20_minus_sector")
RANK_SOURCES = (
    "log_return_1", "log_return_5", "log_return_20", "rsi_14_centered", "volume_z_20", "realized_vol_20",
    "stock_minus_market_return", "stock_minus_sector_return")
RANK_FEATURES = tuple(f"rank_{c}" for c in RANK_SOURCES)
REGIME_FEATURES = (
    "market_return_mean_loo", "market_momentum_5_loo", "market_momentum_20_loo", "market_realized_vol_20_loo",
    "market_breadth_loo", "market_dispersion_loo", "market_drawdown_60_loo")
PANEL_COLUMNS = ("log_return_1", "log_return_5", "log_return_20", "rsi_14_centered", "volume_z_20",
                 "realized_vol_20")

R = "log_return_1"


def _moments(prefix: str) -> list[Column]:
    r = F.col(R)
    return [F.count(r).alias(f"{prefix}c"), F.sum(r).alias(f"{prefix}s"), F.sum(r * r).alias(f"{prefix}ss"),
            F.count_if(r > 0).alias(f"{prefix}p")]


def _leave_one_out(prefix: str, names: dict[str, str]) -> dict[str, Column]:
    """Mean, share of positives, dispersion and count of the others, from sums over all."""
    r, c = F.col(R), F.col(f"{prefix}c")
    s, ss, p = F.col(f"{prefix}s"), F.col(f"{prefix}ss"), F.col(f"{prefix}p")
    others = c - 1
    present = r.isNotNull() & (others > 0)
    spread = (ss - r * r) - ratio((s - r) * (s - r), others)
    # The identity subtracts close numbers; a tiny negative left-over is zero.
    spread = F.greatest(spread, F.lit(0.0))
    own_up = F.when(r > 0, 1).otherwise(0)
    return {
        names["mean"]: F.when(present, ratio(s - r, others)),
        names["breadth"]: F.when(present, ratio((p - own_up).cast("double"), others)),
        names["dispersion"]: F.when(r.isNotNull() & (c > 2), F.sqrt(ratio(spread, c - 2))),
        names["count"]: F.when(present, others.cast("double")),
    }


def market_by_date(panel: DataFrame) -> DataFrame:
    """One row per date with a return: mean, median, breadth, dispersion, count, volume surprise."""
    r = F.col(R)
    sums = panel.groupBy("date").agg(
        F.avg(r).alias("market_return_mean"), F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias(
            "market_breadth"),
        F.stddev_samp(r).alias("market_dispersion"), F.avg("volume_z_20").alias("market_mean_volume_surprise"),
        F.count(r).cast("double").alias("market_available_count")).where(F.col("market_available_count") > 0)
    median = quantiles(panel, ["date"], R, {"market_return_median": 0.5})
    return sums.join(median, "date")


def _roll_by_date(c: Column, agg, n: int) -> Column:
    """Trailing aggregate of a series with one row per calendar date (bounded, so one task)."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def market_context(panel: DataFrame) -> DataFrame:
    """Market aggregates plus their trailing sums, volatility and drawdown.

    The drawdown is taken on the return series itself, as the reference does;
    a peak of zero gives NULL.
    """
    proxy = F.col("market_return_mean")
    return market_by_date(panel).withColumns({
        "market_momentum_5": _roll_by_date(proxy, F.sum, 5),
        "market_momentum_20": _roll_by_date(proxy, F.sum, 20),
        "market_realized_vol_20": _roll_by_date(proxy, F.stddev_samp, 20),
        "market_drawdown_60": ratio(proxy, _roll_by_date(proxy, F.max, 60)) - 1.0,
    }).select("date", *MARKET_FEATURES)


def add_market_loo(panel: DataFrame) -> DataFrame:
    """Add the eight leave-one-out market columns.

    Each stock's own leave-one-out series is rolled along its own rows.
    """
    sums = panel.groupBy("date").agg(*_moments("_m"))
    df = with_date_table(panel, sums).withColumns(_leave_one_out("_m", {
        "mean": "market_return_mean_loo", "breadth": "market_breadth_loo",
        "dispersion": "market_dispersion_loo", "count": "market_loo_available_count"}))
    proxy = F.col("market_return_mean_loo")
    return df.withColumns({
        "market_momentum_5_loo": _own(roll_sum(proxy, 5)),
        "market_momentum_20_loo": _own(roll_sum(proxy, 20)),
        "market_realized_vol_20_loo": _own(roll_std(proxy, 20)),
        "market_drawdown_60_loo": _own(ratio(proxy, roll_max(proxy, 60)) - 1.0),
    }).drop("_mc", "_ms", "_mss", "_mp")


def _own(c: Column) -> Column:
    """Only rows with a return of their own take part in the context."""
    return F.when(F.col(R).isNotNull(), c)


def add_sector_context(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """Add sector and the ten sector columns; a ticker without a sector is UNKNOWN.

    ``sector_breadth`` is the row's own up flag over the sector count, as in the
    reference.  A sector with one available member gives NULL, never its own return.
    """
    # Both tables are stored, so that the planner knows how small they are and need not move the rows to meet them.
    sectors = frozen(sectors.select("ticker", F.col("sector").alias("_sector")))
    known = F.coalesce("_sector", F.lit("UNKNOWN"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(sectors, "ticker", "left").withColumn("sector", known).drop("_sector")

    sums = frozen(placed(panel.select("ticker", "date", R)).groupBy("sector", "date").agg(*_moments("_s")))
    df = placed(panel).join(sums, ["sector", "date"], "left")
    r, c = F.col(R), F.col("_sc").cast("double")
    df = df.withColumns({
        "sector_return_mean": _own(ratio(F.col("_ss"), c)),
        "sector_breadth": _own(ratio(F.when(r > 0, 1.0).otherwise(0.0), c)),
        "sector_available_count": _own(c),
        **_leave_one_out("_s", {"mean": "sector_return_mean_loo", "breadth": "sector_breadth_loo",
                                "dispersion": "sector_dispersion_loo", "count": "sector_loo_available_count"}),
    })
    proxy = F.col("sector_return_mean_loo")
    return df.withColumns({
        "sector_momentum_5_loo": _own(roll_sum(proxy, 5)),
        "sector_momentum_20_loo": _own(roll_sum(proxy, 20)),
        "sector_realized_vol_20_loo": _own(roll_std(proxy, 20)),
    }).drop("_sc", "_ss", "_sss", "_sp")


def add_relative(df: DataFrame) -> DataFrame:
    """Stock minus market and stock minus sector, at one, five and twenty rows."""
    return df.withColumns({
        "stock_minus_market_return": F.col("log_return_1") - F.col("market_return_mean_loo"),
        "stock_minus_sector_return": F.col("log_return_1") - F.col("sector_return_mean_loo"),
        "momentum_5_minus_market": F.col("log_return_5") - F.col("market_momentum_5_loo"),
        "momentum_20_minus_market": F.col("log_return_20") - F.col("market_momentum_20_loo"),
        "momentum_5_minus_sector": F.col("log_return_5") - F.col("sector_momentum_5_loo"),
        "momentum_20_minus_sector": F.col("log_return_20") - F.col("sector_momentum_20_loo"),
    })


def add_ranks(df: DataFrame, sources: tuple[str, ...] = RANK_SOURCES) -> DataFrame:
    """Add the average-tie percentile of each source among present values of the date."""
    missing = [c for c in sources if c not in df.columns]
    if missing:
        raise KeyError(f"rank sources {missing} are not in the frame")
    return average_ranks(df, ["date"], {c: f"rank_{c}" for c in sources})


def regime(df: DataFrame) -> DataFrame:
    """The regime vector: seven leave-one-out market columns at the origin date."""
    missing = [c for c in REGIME_FEATURES if c not in df.columns]
    if missing:
        raise KeyError(f"regime columns {missing} are not in the frame")
    return df.select("ticker", "date", *REGIME_FEATURES)


def assemble_context(features: DataFrame, sectors: DataFrame) -> DataFrame:
    """Every context and rank column, one row per (ticker, date) of the features.

    Rows are moved twice, narrow both times: by date for the ranks, of which the
    sources need no window, then stored, and by ticker for the windows.  A ticker
    listed for several sectors has a row for each, all of which the ranks count;
    the ranks then come last.
    """
    rows = features.select("ticker", "date", *PANEL_COLUMNS)

    def context(panel: DataFrame) -> DataFrame:
        return add_relative(add_sector_context(add_market_loo(panel), sectors))

    if sectors.where("ticker IS NOT NULL").groupBy("ticker").count().where("count > 1").isEmpty():
        with passing_table(rows) as stored:
            sources = context(stored).select(*rows.columns, *[c for c in RANK_SOURCES if c not in PANEL_COLUMNS])
            panel = frozen(add_ranks(sources).select(*rows.columns, *RANK_FEATURES))
        df = context(panel)
    else:
        panel = frozen(rows)
        df = add_ranks(context(panel))
    df = with_date_table(df, market_context(panel.select(*rows.columns)))
    return df.select("ticker", "date", "sector", *PANEL_COLUMNS, *MARKET_FEATURES, *MARKET_LOO_FEATURES,
                     *SECTOR_FEATURES, *RELATIVE_FEATURES, *RANK_FEATURES)


def context_diagnostics(context: DataFrame) -> DataFrame:
    """Row, ticker and date spans, market counts and rows without a leave-one-out value."""
    n = F.col("market_available_count")
    return context.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min(n).alias("market_count_min"), F.max(n).alias("market_count_max"), F.avg(n).alias("market_count_mean"),
        F.count_if(F.col("market_return_mean_loo").isNull()).alias("market_loo_missing"),
        F.count_if(F.col("sector_return_mean_loo").isNull()).alias("sector_loo_missing"))


def sector_sizes(context: DataFrame) -> DataFrame:
    """Distinct tickers with a return, per sector."""
    return context.where(F.col("sector_available_count").isNotNull()).groupBy("sector").agg(
        F.count_distinct("ticker").alias("n_tickers"))
