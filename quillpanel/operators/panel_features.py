"""The 27 stationary per-security features of the shared panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ema import Ema, add_emas_over_gaps, number_rows, span, wilder
from ..functions.numeric import finite, ln, ratio
from ..functions.rolling import Rolled, lagged
from .base_features import true_range

# The feature schema, in order.
STOCK_FEATURES = (
    "log_return_1", "log_return_3", "log_return_5", "log_return_10", "log_return_20",
    "overnight_gap", "intraday_return", "high_low_range", "close_location",
    "realized_vol_5", "realized_vol_10", "realized_vol_20", "atr_14_pct", "rsi_14_centered",
    "macd_pct", "macd_signal_pct", "macd_hist_pct",
    "sma5_distance", "sma20_distance", "sma50_distance", "bollinger_percent_b",
    "volume_log", "volume_z_20", "volume_ratio_20", "drawdown_20", "drawdown_60", "obv_change_normalized",
)
RETURN_HORIZONS = (1, 3, 5, 10, 20)

EMA_FEATURES = {"rsi_14_centered", "macd_pct", "macd_signal_pct", "macd_hist_pct"}


def _lags() -> dict[str, Column]:
    """Features that look at single earlier rows or at the row itself."""
    c, o, h, low, lc = F.col("close"), F.col("open"), F.col("high"), F.col("low"), F.col("_lc")
    out = {f"log_return_{k}": lc - lagged(lc, k) for k in RETURN_HORIZONS}
    out["overnight_gap"] = ln(o) - ln(F.col("_prev"))
    out["intraday_return"] = lc - ln(o)
    out["high_low_range"] = ln(h) - ln(low)
    out["close_location"] = F.when(h - low > 0, (c - low) / (h - low)).otherwise(F.lit(0.5))
    out["volume_log"] = F.log1p(F.col("_vol"))
    return out


def _windowed(w: Rolled) -> dict[str, Callable[[], Column]]:
    """Features over trailing windows; a formula names its windows only when it is asked for."""
    c, vol = F.col("close"), F.col("_vol")

    def obv() -> Column:
        typical = w("mean", "_obv_size", 20)
        return F.when(typical > 0, F.col("_obv_step") / typical)

    out = {f"realized_vol_{n}": lambda n=n: w("std", "_lr", n) for n in (5, 10, 20)}
    out["atr_14_pct"] = lambda: w("mean", "_tr", 14) / c
    out.update({f"sma{n}_distance": lambda n=n: ratio(c, w("mean", "close", n)) - 1.0 for n in (5, 20, 50)})
    out["bollinger_percent_b"] = lambda: ratio(
        c - (w("mean", "close", 20) - 2.0 * w("std", "close", 20)), 4.0 * w("std", "close", 20))
    out["volume_z_20"] = lambda: ratio(vol - w("mean", "_vol", 20), w("std", "_vol", 20))
    out["volume_ratio_20"] = lambda: ratio(vol, w("mean", "_vol", 20))
    out.update({f"drawdown_{n}": lambda n=n: ratio(c, w("max", "close", n)) - 1.0 for n in (20, 60)})
    out["obv_change_normalized"] = obv
    return out


def _strength(gain: Column, loss: Column) -> Column:
    """Strength index centred on 0: lossless is 1, motionless 0, the first row 1."""
    index = 100.0 - 100.0 / (1.0 + ratio(gain, loss))
    index = F.when((gain == 0) & (loss == 0), F.lit(50.0)).when(loss > 0, index).otherwise(F.lit(100.0))
    return (index - 50.0) / 50.0


def panel_features(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Panel features of normalised bars, in schema order; causal at every date.

    Everything shares one exchange by ticker; the averages add one more sort,
    and are planned only when a feature that needs them is asked for.
    """
    names = list(STOCK_FEATURES if names is None else names)
    unknown = [n for n in names if n not in STOCK_FEATURES]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    c = F.col("close")
    df = number_rows(bars.withColumn("_prev", lagged(c)))
    delta = c - F.col("_prev")
    step = F.signum(delta) * F.coalesce(F.col("volume"), F.lit(0.0))
    df = df.withColumns({
        "_lc": ln(c),
        "_lr": ln(c) - ln(F.col("_prev")),
        "_vol": F.coalesce(F.col("volume"), F.lit(0.0)),
        "_tr": true_range(),
        "_obv_step": step,
        "_obv_size": F.abs(step),
        "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
        "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
    })
    rolled = Rolled({"_lr": 1, "_obv_size": 1}, gaps=("_tr",))
    lags, windowed = _lags(), _windowed(rolled)
    formulas = {n: windowed[n]() for n in names if n in windowed}
    # One window node for every lag and trailing aggregate, then plain arithmetic.
    df = df.withColumns({**{n: lags[n] for n in names if n in lags}, **rolled.columns}).withColumns(formulas)
    if EMA_FEATURES & set(names):
        df = add_emas_over_gaps(df, [
            Ema("_g", "_gain", wilder(14), skip=1), Ema("_l", "_loss", wilder(14), skip=1),
            Ema("_e12", "close", span(12)), Ema("_e26", "close", span(26))])
        df = df.withColumn("_macd", F.col("_e12") - F.col("_e26"))
        df = add_emas_over_gaps(df, [Ema("_signal", "_macd", span(9))])
        df = df.withColumns({
            "rsi_14_centered": _strength(F.col("_g"), F.col("_l")),
            "macd_pct": F.col("_macd") / c,
            "macd_signal_pct": F.col("_signal") / c,
            "macd_hist_pct": (F.col("_macd") - F.col("_signal")) / c,
        })
    return df.select("ticker", "date", *[finite(F.col(n)).alias(n) for n in names])


def attach_features(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Features put back onto their bars, one row per bar."""
    return bars.join(features, ["ticker", "date"], "left")


def feature_quality(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Warm-up figures per ticker and feature: present values and first date with one."""
    names = list(STOCK_FEATURES if names is None else names)
    per_ticker = features.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.array(*[F.struct(F.lit(n).alias("feature"), F.count(n).alias("n_valid"),
                           F.min(F.when(F.col(n).isNotNull(), F.col("date"))).alias("first_valid_date"))
                  for n in names]).alias("_f"))
    return per_ticker.select("ticker", "n_rows", "first_date", "last_date", F.inline("_f"))
