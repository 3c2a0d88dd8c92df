"""Shared pieces of the reference SQL (DuckDB)."""

from __future__ import annotations


def r6(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def px(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 3.7e-7, 4) + 0.0"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"

BARS = f"""bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
         first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

SECTORS = """sectors AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS ticker, n_name AS industry, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

EXT = """ext AS (
  SELECT o_orderpriority AS source_id, CAST(o_orderdate AS DATE) AS source_date, avg(o_totalprice) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""

REGISTRY = """registry AS (
  SELECT * FROM (VALUES ('1-URGENT', 'A', 'INDEX'), ('2-HIGH', 'B', 'INDEX'), ('3-MEDIUM', 'A', 'VOLATILITY'),
    ('4-NOT SPECIFIED', 'B', 'YIELD'), ('5-LOW', 'B', 'INDEX')) t(source_id, availability, asset_class))"""

NEWS = """news AS (
  SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS publish_date, event_id FROM events)"""

# Bars with the previous close, changes and row number.
STEPS = """steps AS (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS prev, ln(close) AS lc,
         ln(close) - ln(lag(close) OVER w) AS lr,
         greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
         CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(close - lag(close) OVER w, 0) END AS gain,
         CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(lag(close) OVER w - close, 0) END AS loss,
         sign(close - lag(close) OVER w) * volume AS obv_step
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))"""

# Every recursive average, stepped row by row (an independent form of the block sums).
EMAS = """emas AS (
  SELECT ticker, rn, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig, tr AS trw,
         CAST(NULL AS DOUBLE) AS gw, CAST(NULL AS DOUBLE) AS lw, CAST(NULL AS DOUBLE) AS ge, CAST(NULL AS DOUBLE) AS le
  FROM steps WHERE rn = 1
  UNION ALL
  SELECT s.ticker, s.rn, e.e12 * 11 / 13 + s.close * 2 / 13, e.e26 * 25 / 27 + s.close * 2 / 27,
         e.sig * 0.8 + 0.2 * ((e.e12 * 11 / 13 + s.close * 2 / 13) - (e.e26 * 25 / 27 + s.close * 2 / 27)),
         e.trw * 13 / 14 + s.tr / 14,
         CASE WHEN s.rn = 2 THEN s.gain ELSE e.gw * 13 / 14 + s.gain / 14 END,
         CASE WHEN s.rn = 2 THEN s.loss ELSE e.lw * 13 / 14 + s.loss / 14 END,
         CASE WHEN s.rn = 2 THEN s.gain ELSE e.ge * 13 / 15 + s.gain * 2 / 15 END,
         CASE WHEN s.rn = 2 THEN s.loss ELSE e.le * 13 / 15 + s.loss * 2 / 15 END
  FROM emas e JOIN steps s ON s.ticker = e.ticker AND s.rn = e.rn + 1)"""


def full(agg: str, x: str, n: int) -> str:
    """Trailing aggregate, NULL until n values are present."""
    w = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY ticker ORDER BY date)"


_C20 = full("avg", "close", 20)
_S20 = full("stddev_samp", "close", 20)

# The panel features that need no recursive average.
PANEL_EXPR = {
    **{f"log_return_{k}": f"lc - {lagged('lc', k)}" for k in (1, 3, 5, 10, 20)},
    "overnight_gap": "ln(open) - ln(prev)",
    "intraday_return": "lc - ln(open)",
    "high_low_range": "ln(high) - ln(low)",
    "close_location": "CASE WHEN high - low > 0 THEN (close - low) / (high - low) ELSE 0.5 END",
    **{f"realized_vol_{n}": full("stddev_samp", "lr", n) for n in (5, 10, 20)},
    "atr_14_pct": f"({full('avg', 'tr', 14)}) / close",
    **{f"sma{n}_distance": f"close / ({full('avg', 'close', n)}) - 1" for n in (5, 20, 50)},
    "bollinger_percent_b": f"(close - (({_C20}) - 2 * ({_S20}))) / nullif(4 * ({_S20}), 0)",
    "volume_log": "ln(1 + volume)",
    "volume_z_20": f"(volume - ({full('avg', 'volume', 20)})) / nullif(({full('stddev_samp', 'volume', 20)}), 0)",
    "volume_ratio_20": f"volume / nullif(({full('avg', 'volume', 20)}), 0)",
    **{f"drawdown_{n}": f"close / ({full('max', 'close', n)}) - 1" for n in (20, 60)},
    "obv_change_normalized": f"obv_step / nullif(({full('avg', 'abs(obv_step)', 20)}), 0)",
}

PANEL_RSI = """CASE WHEN coalesce(gw, 0) = 0 AND coalesce(lw, 0) = 0 AND rn > 1 THEN 0.0
  WHEN lw > 0 THEN (100 - 100 / (1 + gw / lw) - 50) / 50 ELSE 1.0 END"""
EMA_EXPR = {
    "rsi_14_centered": PANEL_RSI,
    "macd_pct": "(e12 - e26) / close",
    "macd_signal_pct": "sig / close",
    "macd_hist_pct": "(e12 - e26 - sig) / close",
}


def features(names: list[str], cte: str = "feats") -> list[str]:
    """CTEs giving the named panel features on (ticker, date)."""
    plain = [f"{PANEL_EXPR[n]} AS {n}" for n in names if n in PANEL_EXPR]
    recursive = [n for n in names if n in EMA_EXPR]
    out = [BARS, STEPS]
    if recursive:
        out.append(EMAS)
        cols = ",\n    ".join(["ticker", "date", "rn", "close", *plain])
        out.append(f"plainf AS (SELECT {cols} FROM steps)")
        keep = ", ".join(["p.*", *[f"{EMA_EXPR[n].replace('rn >', 'p.rn >').replace('close', 'p.close')} AS {n}"
                                   for n in recursive]])
        out.append(f"{cte} AS (SELECT {keep} FROM plainf p JOIN emas e ON e.ticker = p.ticker AND e.rn = p.rn)")
    else:
        out.append(f"{cte} AS (SELECT {', '.join(['ticker', 'date', 'close', *plain])} FROM steps)")
    return out


def avg_rank(x: str, part: str) -> str:
    """Average-tie percentile among present values."""
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) "
            f"+ (count({x}) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {part}) END")


TARGETS_OWN = """targets AS (
  SELECT * FROM (
    SELECT ticker, date AS origin_date, lead(date) OVER w AS target_date, close AS close_t,
           lead(close) OVER w AS close_next, ln(lead(close) OVER w / close) AS raw_next_return,
           CAST(lead(close) OVER w > close AS INTEGER) AS y_direction
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE close_next IS NOT NULL)"""


def horizon_targets(horizons=(1, 3, 5, 10), cte: str = "htargets", boundary: str | None = None) -> str:
    cut = f"WHERE date <= DATE '{boundary}'" if boundary else ""
    parts = [f"""SELECT ticker, date AS origin_date, lead(date, {h}) OVER w AS target_end_date, {h} AS horizon,
      ln(lead(close, {h}) OVER w / close) AS future_log_return,
      CAST(lead(close, {h}) OVER w > close AS INTEGER) AS y, close AS close_t, lead(close, {h}) OVER w AS close_t_plus_h,
      count(*) OVER (PARTITION BY ticker) AS n FROM bars {cut}
      WINDOW w AS (PARTITION BY ticker ORDER BY date)""" for h in horizons]
    body = "\n UNION ALL ".join(parts)
    return f"""{cte} AS (SELECT * EXCLUDE (n) FROM ({body}) WHERE n > {max(horizons)} AND target_end_date IS NOT NULL)"""


# Predictions: the date-percentile of the five-row return scores the next own bar.
PRED_FEATURES = features(["log_return_1", "log_return_5", "realized_vol_20"])
PRED = f"""preds AS (
  SELECT t.ticker, t.origin_date, t.target_date, year(t.origin_date) AS fold, t.y_direction AS y_true,
         f.p_up, t.raw_next_return AS future_log_return
  FROM targets t
  JOIN (SELECT ticker, date, {avg_rank('log_return_5', 'date')} AS p_up FROM feats) f
    ON f.ticker = t.ticker AND f.date = t.origin_date
  WHERE f.p_up IS NOT NULL AND year(t.origin_date) BETWEEN 1998 AND 2000
    AND year(t.target_date) = year(t.origin_date))"""
PREDICTIONS = [*PRED_FEATURES, TARGETS_OWN, PRED]


QUOTES = """quotes AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
    TRY_CAST(CASE WHEN l_tax = 0 THEN 'n/a' ELSE CAST(l_extendedprice / l_quantity AS VARCHAR) END AS DOUBLE) AS open,
    l_extendedprice / l_quantity * (0.96::DOUBLE + l_tax) AS high,
    l_extendedprice / l_quantity * (1.02::DOUBLE - l_discount) AS low, l_extendedprice / l_quantity AS close,
    CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_discount = 0 THEN -l_quantity ELSE l_quantity END AS volume,
    row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
        l_linestatus) AS seq
  FROM lineitem)"""
