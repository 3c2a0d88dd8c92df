"""Named per-security indicators computed on daily bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ema import Ema, add_emas_over_gaps, number_rows, span, wilder
from ..functions.numeric import finite, ratio
from ..functions.rolling import Rolled, ahead, lagged, series

RSI_PERIOD = 14
OHLCV = ["open", "high", "low", "close", "volume"]
# The default selection, in order.
DEFAULT_INDICATORS = ["log_return", "realized_volatility_20", "rsi_14", "macd", "macd_signal", "macd_histogram",
                      "atr_14"]

EMAS = {
    "_gain_w": Ema("_gain_w", "_gain", wilder(14), skip=1),
    "_loss_w": Ema("_loss_w", "_loss", wilder(14), skip=1),
    "_gain_e": Ema("_gain_e", "_gain", span(14), skip=1),
    "_loss_e": Ema("_loss_e", "_loss", span(14), skip=1),
    "ema_12": Ema("ema_12", "close", span(12)),
    "ema_26": Ema("ema_26", "close", span(26)),
    "_tr_w": Ema("_tr_w", "_tr", wilder(14)),
    "macd_signal": Ema("macd_signal", "macd", span(9)),
}
# Averages each indicator needs; anything not listed needs none.
NEEDS = {
    "rsi_14": ["_gain_w", "_loss_w"], "rsi_14_ema": ["_gain_e", "_loss_e"], "atr_14": ["_tr_w"],
    "ema_12": ["ema_12"], "ema_26": ["ema_26"], "macd": ["ema_12", "ema_26"],
    "macd_signal": ["ema_12", "ema_26"], "macd_histogram": ["ema_12", "ema_26"],
}


def true_range() -> Column:
    """Widest of the three ranges; the first bar has only its own."""
    prev = F.col("_prev")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def _rsi(gain: Column, loss: Column, ready: Column | None = None) -> Column:
    """Strength index; anything undefined, warm-up and lossless runs included, is 50."""
    value = 100.0 - 100.0 / (1.0 + ratio(gain, loss))
    return F.coalesce(value if ready is None else F.when(ready, value), F.lit(50.0))


def _lags() -> dict[str, Column]:
    """Indicators that look at single earlier rows, the row itself, or everything so far."""
    c, v = F.col("close"), F.col("volume")
    to_date = series().rowsBetween(Window.unboundedPreceding, 0)
    signed = F.coalesce(F.signum(c - F.col("_prev")), F.lit(0.0)) * v
    return {
        "log_return": F.col("_lr"),
        "obv": F.when(v.isNotNull(), F.sum(signed).over(to_date)),
        "returns_1": ratio(c, lagged(c, 1)) - 1.0,
        "returns_5": ratio(c, lagged(c, 5)) - 1.0,
        "returns_10": ratio(c, lagged(c, 10)) - 1.0,
        "log_volume": F.log1p(v),
    }


def _windowed(w: Rolled) -> dict[str, Callable[[], Column]]:
    """Indicators over trailing windows; a formula names its windows only when it is asked for."""
    c = F.col("close")

    def band(sign: float, kind: str) -> Column:
        return w("mean", "close", 20) + sign * 2.0 * w(kind, "close", 20)

    return {
        "realized_volatility_20": lambda: w("std", "_lr", 20),
        "rsi_14_rolling": lambda: _rsi(w("mean", "_gain", RSI_PERIOD), w("mean", "_loss", RSI_PERIOD)),
        "sma_5": lambda: w("mean", "close", 5),
        "sma_20": lambda: w("mean", "close", 20),
        "sma_50": lambda: w("mean", "close", 50),
        "sma_5_minus_sma_20": lambda: ratio(w("mean", "close", 5) - w("mean", "close", 20), w("mean", "close", 20)),
        "bb_upper": lambda: band(1.0, "std"),
        "bb_lower": lambda: band(-1.0, "std"),
        "bb_width": lambda: ratio(4.0 * w("std", "close", 20), w("mean", "close", 20)),
        "bb_percent_b": lambda: F.coalesce(
            ratio(c - band(-1.0, "std_pop"), 4.0 * w("std_pop", "close", 20)), F.lit(0.5)),
    }


def _averaged() -> dict[str, Column]:
    """Indicators that need recursive averages."""
    enough_deltas = F.col("_deltas") >= RSI_PERIOD
    return {
        "rsi_14": _rsi(F.col("_gain_w"), F.col("_loss_w"), enough_deltas),
        "rsi_14_ema": _rsi(F.col("_gain_e"), F.col("_loss_e"), enough_deltas),
        "atr_14": F.when(F.col("_ranges") >= RSI_PERIOD, F.col("_tr_w")),
        "ema_12": F.col("ema_12"),
        "ema_26": F.col("ema_26"),
        "macd": F.col("ema_12") - F.col("ema_26"),
    }


# Every known indicator.
INDICATORS = (
    "log_return", "realized_volatility_20", "rsi_14", "rsi_14_rolling", "rsi_14_ema", "macd", "macd_signal",
    "macd_histogram", "atr_14", "sma_5", "sma_20", "sma_50", "sma_5_minus_sma_20", "ema_12", "ema_26", "bb_upper",
    "bb_lower", "bb_width", "bb_percent_b", "obv", "returns_1", "returns_5", "returns_10", "log_volume")

# Indicators that each feature family adds to the family before it (all carry OHLCV).
FAMILY_STEPS = (
    ("F0", ()),
    ("F1", tuple(DEFAULT_INDICATORS)),
    ("F2", ("sma_5", "sma_20", "sma_5_minus_sma_20", "bb_upper", "bb_lower", "bb_percent_b", "obv")),
    ("F3", ("returns_1", "returns_5", "returns_10", "sma_50", "ema_12", "ema_26")),
)
# Indicator used by each strength-index method.
RSI_METHODS = {"R0_rolling": "rsi_14_rolling", "R1_wilder": "rsi_14", "R2_ema": "rsi_14_ema"}


def family_indicators(family: str = "F1", rsi_method: str = "R1_wilder") -> list[str]:
    """Indicators of a family; the chosen strength index takes the place of the default one."""
    names = [f for f, _ in FAMILY_STEPS]
    if family not in names:
        raise KeyError(f"unknown feature family {family!r}")
    if rsi_method not in RSI_METHODS:
        raise KeyError(f"unknown strength-index method {rsi_method!r}")
    chosen = [i for _, extra in FAMILY_STEPS[: names.index(family) + 1] for i in extra]
    return [RSI_METHODS[rsi_method] if i == "rsi_14" else i for i in chosen]


def base_features(bars: DataFrame, indicators: list[str] | None = None, use_ohlcv: bool = True) -> DataFrame:
    """Selected indicators and next-row direction for every (ticker, date).

    One shuffle by ticker; only the averages an indicator needs are planned.
    ``target`` is 1.0 when the next close is higher, else 0.0, and NULL on the
    last row of a ticker.
    """
    chosen = list(DEFAULT_INDICATORS if indicators is None else indicators)
    unknown = [i for i in chosen if i not in INDICATORS]
    if unknown:
        raise ValueError(f"unknown indicators {unknown}")
    c = F.col("close")
    df = number_rows(bars.withColumn("_prev", lagged(c)))
    delta = c - F.col("_prev")
    df = df.withColumns({
        "_lr": finite(F.log(F.when(ratio(c, F.col("_prev")) > 0, ratio(c, F.col("_prev"))))),
        "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
        "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
        "_tr": true_range(),
        "target": F.when(ahead(c).isNotNull(), (ahead(c) > c).cast("double")),
    })
    # A log return is undefined where a price is not positive, so it is counted.
    rolled = Rolled({"_gain": 1, "_loss": 1}, gaps=("_lr",))
    lags, windowed = _lags(), _windowed(rolled)
    formulas = {i: windowed[i]() for i in chosen if i in windowed}
    df = df.withColumns({**{i: lags[i] for i in chosen if i in lags}, **rolled.columns}).withColumns(formulas)

    wanted = {e for i in chosen for e in NEEDS.get(i, [])}
    macd_parts = {"macd", "macd_signal", "macd_histogram"} & set(chosen)
    if wanted:
        # Present inputs so far; a gap does not count.  Counted before the averages, which sort by block.
        so_far = series().rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({"_deltas": F.count("_gain").over(so_far), "_ranges": F.count("_tr").over(so_far)})
        df = add_emas_over_gaps(df, [EMAS[e] for e in EMAS if e in wanted])
        averaged = _averaged()
        need = [i for i in averaged if i in chosen or (i == "macd" and macd_parts)]
        df = df.withColumns({i: averaged[i] for i in need})
    if macd_parts - {"macd"}:
        df = add_emas_over_gaps(df, [EMAS["macd_signal"]])
        df = df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    raw = OHLCV if use_ohlcv else []
    return df.select("ticker", "date", *raw, *[i for i in chosen if i not in raw], "target")


def volume_mode(df: DataFrame, mode: str = "raw") -> DataFrame:
    """Volume as given, or its log after negative values are raised to zero; raw volume is kept."""
    if mode not in ("raw", "log1p"):
        raise ValueError(f"unknown volume mode {mode!r}")
    v = F.col("volume")
    scaled = v if mode == "raw" else F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0.0))))
    return df.withColumn("volume_raw", v).withColumn("volume", scaled)
