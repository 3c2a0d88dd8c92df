"""Bars, per-security features, cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import base_features as base
from ..operators import cross_section as cs
from ..operators import panel_features as pf
from ..plans import views
from . import sql as S
from .registry import query
from .tidy import tidy

OHLC = ("open", "high", "low", "close")


@query("bars_daily", S.with_(S.BARS) + f"SELECT ticker, date, {', '.join(f'{S.px(c)} AS {c}' for c in OHLC)}, "
       f"{S.r6('volume')} AS volume FROM bars")
def _(spark, sf):
    return tidy(views.bars(spark, sf), prices=OHLC)


@query("bars_from_intraday", """
SELECT event_type AS ticker, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
       min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2""")
def _(spark, sf):
    return views.intraday_bars(spark, sf)


# ---- base indicators -------------------------------------------------------

BASE_PLAIN = {
    "log_return": "lr",
    "realized_volatility_20": S.full("stddev_samp", "lr", 20),
    "rsi_14_rolling": f"coalesce(100 - 100 / (1 + ({S.full('avg', 'gain', 14)}) / nullif(({S.full('avg', 'loss', 14)}), 0)), 50)",
    "sma_5_minus_sma_20": f"(({S.full('avg', 'close', 5)}) - ({S.full('avg', 'close', 20)})) / ({S.full('avg', 'close', 20)})",
    "bb_width": f"4 * ({S.full('stddev_samp', 'close', 20)}) / ({S.full('avg', 'close', 20)})",
    "bb_percent_b": f"coalesce((close - ({S.full('avg', 'close', 20)}) + 2 * ({S.full('stddev_pop', 'close', 20)})) "
                    f"/ nullif(4 * ({S.full('stddev_pop', 'close', 20)}), 0), 0.5)",
    "obv": "sum(coalesce(sign(close - prev), 0) * volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)",
    **{f"returns_{k}": f"close / ({S.lagged('close', k)}) - 1" for k in (1, 5, 10)},
    "log_volume": "ln(1 + volume)",
}
BASE_PRICES = {
    "sma_5": S.full("avg", "close", 5), "sma_20": S.full("avg", "close", 20), "sma_50": S.full("avg", "close", 50),
    "bb_upper": f"({S.full('avg', 'close', 20)}) + 2 * ({S.full('stddev_samp', 'close', 20)})",
    "bb_lower": f"({S.full('avg', 'close', 20)}) - 2 * ({S.full('stddev_samp', 'close', 20)})",
}
TARGET_SQL = "CAST(CAST(lead(close) OVER (PARTITION BY ticker ORDER BY date) > close AS INTEGER) AS DOUBLE)"


@query("indicators_trailing", S.with_(S.BARS, S.STEPS) + "SELECT ticker, date, "
       + ", ".join([f"{S.r6(e)} AS {n}" for n, e in BASE_PLAIN.items()]
                   + [f"{S.px(e)} AS {n}" for n, e in BASE_PRICES.items()])
       + f", {TARGET_SQL} AS target FROM steps")
def _(spark, sf):
    names = [*BASE_PLAIN, *BASE_PRICES]
    return tidy(base.base_features(views.bars(spark, sf), names, use_ohlcv=False), prices=tuple(BASE_PRICES))


@query("indicators_averaged", S.with_(S.BARS, S.STEPS, S.EMAS) + f"""
SELECT s.ticker, s.date,
  {S.r6('CASE WHEN s.rn > 14 THEN coalesce(100 - 100 / (1 + gw / nullif(lw, 0)), 50) ELSE 50 END')} AS rsi_14,
  {S.r6('CASE WHEN s.rn > 14 THEN coalesce(100 - 100 / (1 + ge / nullif(le, 0)), 50) ELSE 50 END')} AS rsi_14_ema,
  {S.px('e12')} AS ema_12, {S.px('e26')} AS ema_26, {S.px('e12 - e26')} AS macd, {S.px('sig')} AS macd_signal,
  {S.px('e12 - e26 - sig')} AS macd_histogram, {S.px('CASE WHEN s.rn >= 14 THEN trw END')} AS atr_14
FROM steps s JOIN emas e ON e.ticker = s.ticker AND e.rn = s.rn""")
def _(spark, sf):
    names = ["rsi_14", "rsi_14_ema", "ema_12", "ema_26", "macd", "macd_signal", "macd_histogram", "atr_14"]
    out = base.base_features(views.bars(spark, sf), names, use_ohlcv=False).drop("target")
    return tidy(out, prices=("ema_12", "ema_26", "macd", "macd_signal", "macd_histogram", "atr_14"))


_F2 = base.family_indicators("F2", "R0_rolling")



@query("indicators_over_gaps", S.with_(S.BARS, """gp AS (SELECT ticker, date, CASE WHEN CAST(volume AS BIGINT) % 5 <> 0 THEN close END AS x, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars),
ge AS (SELECT ticker, rn, x AS e12, x AS e26, CASE WHEN x IS NOT NULL THEN 0.0::DOUBLE END AS sig, CAST(0 AS BIGINT) AS gap FROM gp WHERE rn = 1
  UNION ALL SELECT ticker, rn, e12, e26, CASE WHEN e12 IS NULL THEN NULL WHEN sig IS NULL THEN e12 - e26 ELSE sig * 0.8 + 0.2 * (e12 - e26) END, gap FROM (
    SELECT g.ticker, g.rn, e.sig, CASE WHEN g.x IS NULL THEN e.gap + 1 ELSE 0 END AS gap,
      CASE WHEN g.x IS NULL THEN e.e12 WHEN e.e12 IS NULL THEN g.x ELSE (pow(11 / 13.0::DOUBLE, e.gap + 1) * e.e12 + 2 / 13.0::DOUBLE * g.x) / (pow(11 / 13.0::DOUBLE, e.gap + 1) + 2 / 13.0::DOUBLE) END AS e12,
      CASE WHEN g.x IS NULL THEN e.e26 WHEN e.e26 IS NULL THEN g.x ELSE (pow(25 / 27.0::DOUBLE, e.gap + 1) * e.e26 + 2 / 27.0::DOUBLE * g.x) / (pow(25 / 27.0::DOUBLE, e.gap + 1) + 2 / 27.0::DOUBLE) END AS e26
    FROM ge e JOIN gp g ON g.ticker = e.ticker AND g.rn = e.rn + 1))""") + f"""
SELECT g.ticker, g.date, {S.px('e12')} AS ema_12, {S.px('e26')} AS ema_26, {S.px('e12 - e26')} AS macd, {S.px('sig')} AS macd_signal FROM gp g JOIN ge e ON e.ticker = g.ticker AND e.rn = g.rn""")
def _(spark, sf):
    """Averages over closes that are missing on every day with a volume divisible by five."""
    names = ("ema_12", "ema_26", "macd", "macd_signal")
    bars = views.bars(spark, sf).withColumn("close", F.when(F.col("volume").cast("bigint") % 5 != 0, F.col("close")))
    return tidy(base.base_features(bars, list(names), use_ohlcv=False).drop("target"), prices=names)


@query("indicator_family", S.with_(S.BARS, S.STEPS, S.EMAS) + "SELECT s.ticker, s.date, " + ", ".join(
    [f"{S.px(c)} AS {c}" for c in OHLC] + [f"{S.r6('volume')} AS volume"]
    + [f"{S.r6(BASE_PLAIN[n])} AS {n}" for n in _F2 if n in BASE_PLAIN]
    + [f"{S.px(BASE_PRICES[n])} AS {n}" for n in _F2 if n in BASE_PRICES]
    + [f"{S.px('e12 - e26')} AS macd, {S.px('sig')} AS macd_signal, {S.px('e12 - e26 - sig')} AS macd_histogram",
       f"{S.px('CASE WHEN s.rn >= 14 THEN trw END')} AS atr_14", f"{TARGET_SQL} AS target"])
    + " FROM (SELECT * FROM steps JOIN (SELECT ticker AS et, rn AS er, e12, e26, sig, trw FROM emas) "
      "ON et = ticker AND er = rn) s")
def _(spark, sf):
    out = base.base_features(views.bars(spark, sf), _F2)
    prices = [*OHLC, "macd", "macd_signal", "macd_histogram", "atr_14", *[n for n in _F2 if n in BASE_PRICES]]
    return tidy(out, prices=tuple(prices))


@query("volume_modes", S.with_(S.BARS)
       + f"SELECT ticker, date, {S.r6('ln(1 + greatest(volume, 0))')} AS volume, volume AS volume_raw FROM bars")
def _(spark, sf):
    return tidy(base.volume_mode(views.bars(spark, sf), "log1p").select("ticker", "date", "volume", "volume_raw"))


# ---- panel features --------------------------------------------------------

_ALL = list(pf.STOCK_FEATURES)


@query("panel_features", S.with_(*S.features(_ALL)) + "SELECT ticker, date, "
       + ", ".join(f"{S.r6(n)} AS {n}" for n in _ALL) + " FROM feats")
def _(spark, sf):
    return tidy(pf.panel_features(views.bars(spark, sf)))


@query("features_on_bars", S.with_(*S.features(["log_return_5", "drawdown_20"]))
       + f"SELECT b.ticker, b.date, {S.px('b.close')} AS close, b.volume, {S.r6('log_return_5')} AS log_return_5, "
         f"{S.r6('drawdown_20')} AS drawdown_20 FROM bars b LEFT JOIN feats f ON f.ticker = b.ticker AND f.date = b.date")
def _(spark, sf):
    bars = views.bars(spark, sf)
    out = pf.attach_features(bars, pf.panel_features(bars, ["log_return_5", "drawdown_20"]))
    return tidy(out.drop("open", "high", "low"), prices=("close",))


_Q = ["log_return_1", "realized_vol_20", "drawdown_60", "volume_z_20"]


@query("feature_warmup", S.with_(*S.features(_Q)) + " UNION ALL ".join(
    f"SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, '{n}' AS feature, "
    f"count({n}) AS n_valid, min(date) FILTER ({n} IS NOT NULL) AS first_valid_date FROM feats GROUP BY ticker" for n in _Q))
def _(spark, sf):
    return pf.feature_quality(pf.panel_features(views.bars(spark, sf), _Q), _Q)


# ---- cross-sections --------------------------------------------------------

_PANEL = list(cs.PANEL_COLUMNS)


def _panel(spark, sf):
    return pf.panel_features(views.bars(spark, sf), _PANEL)


MARKET = """mbase AS (
  SELECT date, avg(log_return_1) AS market_return_mean, median(log_return_1) AS market_return_median,
         avg(CASE WHEN log_return_1 IS NOT NULL THEN CAST(log_return_1 > 0 AS INTEGER) END) AS market_breadth,
         stddev_samp(log_return_1) AS market_dispersion, avg(volume_z_20) AS market_mean_volume_surprise,
         CAST(count(log_return_1) AS DOUBLE) AS market_available_count
  FROM feats GROUP BY date HAVING count(log_return_1) > 0),
market AS (
  SELECT *, CASE WHEN count(*) OVER w5 = 5 THEN sum(market_return_mean) OVER w5 END AS market_momentum_5,
    CASE WHEN count(*) OVER w20 = 20 THEN sum(market_return_mean) OVER w20 END AS market_momentum_20,
    CASE WHEN count(*) OVER w20 = 20 THEN stddev_samp(market_return_mean) OVER w20 END AS market_realized_vol_20,
    CASE WHEN count(*) OVER w60 = 60 THEN market_return_mean / nullif(max(market_return_mean) OVER w60, 0) - 1 END
      AS market_drawdown_60
  FROM mbase WINDOW w5 AS (ORDER BY date ROWS 4 PRECEDING), w20 AS (ORDER BY date ROWS 19 PRECEDING),
    w60 AS (ORDER BY date ROWS 59 PRECEDING))"""


def _loo(prefix: str, part: str, names: tuple[str, str, str, str]) -> str:
    r = "log_return_1"
    c, s = f"count({r}) OVER {part}", f"sum({r}) OVER {part}"
    ss, p = f"sum({r} * {r}) OVER {part}", f"count({r}) FILTER ({r} > 0) OVER {part}"
    mean, breadth, disp, cnt = names
    ok = f"{r} IS NOT NULL AND {c} > 1"
    return f"""CASE WHEN {ok} THEN ({s} - {r}) / ({c} - 1) END AS {mean},
    CASE WHEN {ok} THEN ({p} - CAST({r} > 0 AS INTEGER)) / ({c} - 1) END AS {breadth},
    CASE WHEN {r} IS NOT NULL AND {c} > 2 THEN sqrt(greatest(({ss} - {r} * {r}) - ({s} - {r}) * ({s} - {r}) / ({c} - 1), 0)
      / ({c} - 2)) END AS {disp},
    CASE WHEN {ok} THEN CAST({c} - 1 AS DOUBLE) END AS {cnt}"""


def _own(expr: str) -> str:
    return f"CASE WHEN log_return_1 IS NOT NULL THEN ({expr}) END"


MLOO = f"""mloo0 AS (SELECT *, {_loo('m', '(PARTITION BY date)', ('market_return_mean_loo', 'market_breadth_loo',
    'market_dispersion_loo', 'market_loo_available_count'))} FROM feats),
mloo AS (SELECT *, {_own(S.full('sum', 'market_return_mean_loo', 5))} AS market_momentum_5_loo,
   {_own(S.full('sum', 'market_return_mean_loo', 20))} AS market_momentum_20_loo,
   {_own(S.full('stddev_samp', 'market_return_mean_loo', 20))} AS market_realized_vol_20_loo,
   {_own('market_return_mean_loo / nullif((' + S.full('max', 'market_return_mean_loo', 60) + '), 0) - 1')}
     AS market_drawdown_60_loo FROM mloo0)"""

_SW = "(PARTITION BY sector, date)"
SLOO = f"""sec0 AS (SELECT m.*, coalesce(s.sector, 'UNKNOWN') AS sector FROM mloo m LEFT JOIN sectors s USING (ticker)),
sloo0 AS (SELECT *, {_own(f'sum(log_return_1) OVER {_SW} / count(log_return_1) OVER {_SW}')} AS sector_return_mean,
   {_own(f'CAST(log_return_1 > 0 AS INTEGER) / count(log_return_1) OVER {_SW}')} AS sector_breadth,
   {_own(f'CAST(count(log_return_1) OVER {_SW} AS DOUBLE)')} AS sector_available_count,
   {_loo('s', _SW, ('sector_return_mean_loo', 'sector_breadth_loo', 'sector_dispersion_loo',
                    'sector_loo_available_count'))} FROM sec0),
sloo AS (SELECT *, {_own(S.full('sum', 'sector_return_mean_loo', 5))} AS sector_momentum_5_loo,
   {_own(S.full('sum', 'sector_return_mean_loo', 20))} AS sector_momentum_20_loo,
   {_own(S.full('stddev_samp', 'sector_return_mean_loo', 20))} AS sector_realized_vol_20_loo FROM sloo0)"""

REL = """rel AS (SELECT *, log_return_1 - market_return_mean_loo AS stock_minus_market_return,
   log_return_1 - sector_return_mean_loo AS stock_minus_sector_return,
   log_return_5 - market_momentum_5_loo AS momentum_5_minus_market,
   log_return_20 - market_momentum_20_loo AS momentum_20_minus_market,
   log_return_5 - sector_momentum_5_loo AS momentum_5_minus_sector,
   log_return_20 - sector_momentum_20_loo AS momentum_20_minus_sector FROM sloo)"""

RANKS = "ranked AS (SELECT *, " + ", ".join(
    f"{S.avg_rank(c, 'date')} AS rank_{c}" for c in cs.RANK_SOURCES) + " FROM rel)"

CONTEXT = [*S.features(_PANEL), S.SECTORS, MARKET, MLOO, SLOO, REL, RANKS]


def _cols(names, digits=6):
    return ", ".join(f"{S.r6(n, digits)} AS {n}" for n in names)


@query("market_context", S.with_(*S.features(_PANEL), MARKET) + f"SELECT date, {_cols(cs.MARKET_FEATURES, 5)} FROM market")
def _(spark, sf):
    return tidy(cs.market_context(_panel(spark, sf)), 5)


_LOO_PANEL = ["log_return_1"]


@query("market_leave_one_out", S.with_(*S.features(_LOO_PANEL), MLOO)
       + f"SELECT ticker, date, {_cols(cs.MARKET_LOO_FEATURES, 5)} FROM mloo")
def _(spark, sf):
    panel = pf.panel_features(views.bars(spark, sf), _LOO_PANEL)
    return tidy(cs.add_market_loo(panel).select("ticker", "date", *cs.MARKET_LOO_FEATURES), 5)


@query("sector_leave_one_out", S.with_(*S.features(_LOO_PANEL), S.SECTORS, MLOO, SLOO)
       + f"SELECT ticker, date, sector, {_cols(cs.SECTOR_FEATURES, 5)} FROM sloo")
def _(spark, sf):
    panel = pf.panel_features(views.bars(spark, sf), _LOO_PANEL)
    out = cs.add_sector_context(panel, views.sector_map(spark, sf))
    return tidy(out.select("ticker", "date", "sector", *cs.SECTOR_FEATURES), 5)


_REL_PANEL = ["log_return_1", "log_return_5", "log_return_20"]


def _relative(spark, sf, names):
    panel = pf.panel_features(views.bars(spark, sf), names)
    return cs.add_relative(cs.add_sector_context(cs.add_market_loo(panel), views.sector_map(spark, sf)))


@query("relative_features", S.with_(*S.features(_REL_PANEL), S.SECTORS, MLOO, SLOO, REL)
       + f"SELECT ticker, date, {_cols(cs.RELATIVE_FEATURES)} FROM rel")
def _(spark, sf):
    return tidy(_relative(spark, sf, _REL_PANEL).select("ticker", "date", *cs.RELATIVE_FEATURES))


# The relative sources differ between engines in their last bits, which would
# split exact ties; the ranks of those two are checked by their inputs instead.
_RANK_CHECKED = tuple(c for c in cs.RANK_SOURCES if not c.startswith("stock_minus") and c != "rsi_14_centered")


@query("cross_section_ranks", S.with_(*S.features(list(_RANK_CHECKED))) + "SELECT ticker, date, " + ", ".join(
    f"{S.r6(S.avg_rank(c, 'date'))} AS rank_{c}" for c in _RANK_CHECKED) + " FROM feats")
def _(spark, sf):
    panel = pf.panel_features(views.bars(spark, sf), list(_RANK_CHECKED))
    out = cs.add_ranks(panel, _RANK_CHECKED)
    return tidy(out.select("ticker", "date", *[f"rank_{c}" for c in _RANK_CHECKED]))


@query("regime_vector", S.with_(*S.features(_LOO_PANEL), MLOO) + f"SELECT ticker, date, {_cols(cs.REGIME_FEATURES, 5)} FROM mloo")
def _(spark, sf):
    panel = pf.panel_features(views.bars(spark, sf), _LOO_PANEL)
    return tidy(cs.regime(cs.add_market_loo(panel)), 5)


_CTX_COLS = ["ticker", "date", "sector", *cs.PANEL_COLUMNS, *cs.MARKET_FEATURES, *cs.MARKET_LOO_FEATURES,
             *cs.SECTOR_FEATURES, *cs.RELATIVE_FEATURES, *cs.RANK_FEATURES]


@query("context_assembled", S.with_(*CONTEXT) + "SELECT ticker, r.date, sector, " + ", ".join(
    f"{S.r6(n, 5)} AS {n}" for n in _CTX_COLS[3:]) + " FROM ranked r LEFT JOIN market m ON m.date = r.date")
def _(spark, sf):
    return tidy(cs.assemble_context(_panel(spark, sf), views.sector_map(spark, sf)), 5)


@query("context_diagnostics", S.with_(*CONTEXT) + f"""
SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(r.date) AS first_date, max(r.date) AS last_date,
  min(market_available_count) AS market_count_min, max(market_available_count) AS market_count_max,
  {S.r6('avg(market_available_count)')} AS market_count_mean,
  count(*) FILTER (market_return_mean_loo IS NULL) AS market_loo_missing,
  count(*) FILTER (sector_return_mean_loo IS NULL) AS sector_loo_missing
FROM ranked r LEFT JOIN market m ON m.date = r.date""")
def _(spark, sf):
    return tidy(cs.context_diagnostics(cs.assemble_context(_panel(spark, sf), views.sector_map(spark, sf))))


@query("sector_sizes", S.with_(*S.features(_LOO_PANEL), S.SECTORS) + """
SELECT coalesce(sector, 'UNKNOWN') AS sector, count(DISTINCT ticker) AS n_tickers
FROM feats LEFT JOIN sectors USING (ticker) WHERE log_return_1 IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    panel = pf.panel_features(views.bars(spark, sf), _LOO_PANEL)
    return cs.sector_sizes(cs.add_sector_context(panel, views.sector_map(spark, sf)))
