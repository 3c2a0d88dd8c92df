"""Point-in-time external series, news, aliases and event rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as a
from ..operators import news as nw
from ..operators import panel_features as pf
from ..operators import quality as q
from ..plans import views
from ..plans.skew import frozen
from . import sql as S
from .registry import query
from .tidy import tidy


def _features(spark, sf):
    return a.source_features(a.latest_per_date(views.ext_series(spark, sf)), views.source_registry(spark))


def _w(n: int) -> str:
    return f"(PARTITION BY source_id ORDER BY source_date ROWS {n - 1} PRECEDING)"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {agg}({x}) OVER {_w(n)} END"


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY source_id ORDER BY source_date)"


PRICE_SQL = {
    **{f"return_{k}": f"ln(close) - {_lag('ln(close)', k)}" for k in (1, 3, 5, 10, 20)},
    **{f"realized_vol_{n}": f"({_full('stddev_samp', 'lr', n)}) * sqrt(252.0) * 100" for n in (5, 10, 20)},
    **{f"drawdown_{n}": f"close / ({_full('max', 'close', n)}) - 1" for n in (20, 60)},
    **{f"distance_from_ma{n}": f"close / ({_full('avg', 'close', n)}) - 1" for n in (20, 60)},
}
VOL_SQL = {"level": "close", "log_level": "ln(close)", "change_1": f"close - {_lag('close', 1)}", "change_5": f"close - {_lag('close', 5)}",
           "zscore_20": f"(close - ({_full('avg', 'close', 20)})) / nullif(({_full('stddev_samp', 'close', 20)}), 0)"}
YIELD_SQL = {"level": "close", **{f"change_{k}": f"close - {_lag('close', k)}" for k in (1, 5, 20)}}

LONG = "extlr AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY source_id ORDER BY source_date) AS lr FROM ext),\n" + \
    "xf AS (\n" + "\n UNION ALL ".join(
        f"SELECT source_id, source_date, asset_class, '{f}' AS feature, {e} AS value FROM extlr JOIN registry USING (source_id)"
        for k, fs in (("PRICE", PRICE_SQL), ("VOLATILITY", VOL_SQL), ("YIELD", YIELD_SQL)) for f, e in
        [(f"{k}:{n}", x) for n, x in fs.items()]) + """),
sf AS (SELECT source_id, source_date, split_part(feature, ':', 2) AS feature, value FROM xf
  WHERE split_part(feature, ':', 1) = CASE WHEN asset_class = 'INDEX' THEN 'PRICE' ELSE asset_class END)"""
SRC = [S.EXT, S.REGISTRY, LONG]
LEVELS = ("level", "change_1", "change_5", "change_20")


def _value_sql(source: str = "value") -> str:
    # Levels are averages of money amounts, so they get price rounding.
    return (f"CASE WHEN feature IN ('level', 'change_1', 'change_5', 'change_20') THEN {S.px(source)} ELSE {S.r6(source)} END")


def _value(c):
    from ..functions.numeric import rounded, rounded_price
    return F.when(F.col("feature").isin(*LEVELS), rounded_price(c)).otherwise(rounded(c))


@query("source_features", S.with_(*SRC) + f"SELECT source_id, source_date, feature, {_value_sql()} AS value FROM sf")
def _(spark, sf):
    out = a.long_features(_features(spark, sf), "source_id", "source_date")
    return out.withColumn("value", _value(F.col("value")))


def _origins(spark, sf):
    return views.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("origin_date")).distinct()


def _aligned(spark, sf, strict=None):
    return a.align_asof(_origins(spark, sf), _features(spark, sf), views.source_registry(spark), strict)


def aligned_sql(rule: str) -> str:
    return f"""org AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS origin_date FROM lineitem),
obs AS (SELECT source_id, source_date FROM ext),
al0 AS (SELECT r.source_id, r.availability, r.asset_class, o.origin_date,
  (SELECT max(x.source_date) FROM obs x WHERE x.source_id = r.source_id AND {rule}) AS observation_date FROM org o, registry r),
al AS (SELECT al0.*, CASE WHEN observation_date IS NOT NULL THEN
  (SELECT count(*) FROM obs x WHERE x.source_id = al0.source_id AND x.source_date > al0.observation_date AND x.source_date <= al0.origin_date) END AS lag_sessions FROM al0)"""


BY_CLASS = "(x.source_date < o.origin_date OR (r.availability IN ('A', 'C') AND x.source_date = o.origin_date))"
AL = [*SRC, aligned_sql(BY_CLASS)]


@query("aligned_observations", S.with_(*AL) + "SELECT source_id, origin_date, observation_date, origin_date AS effective_date, lag_sessions, availability FROM al")
def _(spark, sf):
    return _aligned(spark, sf).drop("features")


@query("aligned_strictly_earlier", S.with_(S.EXT, S.REGISTRY, aligned_sql("x.source_date < o.origin_date"))
       + "SELECT source_id, origin_date, observation_date, lag_sessions FROM al")
def _(spark, sf):
    return _aligned(spark, sf, strict=True).select("source_id", "origin_date", "observation_date", "lag_sessions")


@query("aligned_features", S.with_(*AL) + f"""
SELECT a.source_id, a.origin_date, s.feature, {_value_sql('s.value')} AS value FROM al a JOIN sf s ON s.source_id = a.source_id AND s.source_date = a.observation_date""")
def _(spark, sf):
    out = a.long_features(_aligned(spark, sf), "source_id", "origin_date")
    return out.withColumn("value", _value(F.col("value")))


@query("alignment_report", S.with_(*AL) + f"""
SELECT source_id, availability, count(*) AS n_origins, count(observation_date) AS n_with_observation, count(*) FILTER (observation_date IS NULL) AS n_missing,
  {S.r6('avg(CAST(observation_date IS NOT NULL AS INTEGER))')} AS coverage, min(lag_sessions) AS min_lag, max(lag_sessions) AS max_lag,
  count(*) FILTER (observation_date = origin_date) AS n_same_date,
  count(*) FILTER (observation_date > origin_date OR (availability = 'B' AND observation_date = origin_date)) AS violations, {S.r6('median(lag_sessions)')} AS median_lag FROM al GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(a.alignment_report(_aligned(spark, sf)))


@query("availability_violations", S.with_(*AL) + """
SELECT count(*) AS n_rows, count(*) FILTER (observation_date > origin_date) AS violations, max(observation_date) AS max_observed FROM al""")
def _(spark, sf):
    return q.availability_violations(_aligned(spark, sf))


WIDE_COLS = [("1-URGENT", "return_1"), ("1-URGENT", "return_5"), ("1-URGENT", "return_20"), ("2-HIGH", "return_1"), ("2-HIGH", "drawdown_60"),
             ("3-MEDIUM", "zscore_20"), ("3-MEDIUM", "log_level"), ("5-LOW", "return_20"), ("5-LOW", "realized_vol_20")]
WIDE = "wide AS (SELECT a.origin_date, " + ", ".join(
    f"max(s.value) FILTER (a.source_id = '{s}' AND s.feature = '{f}') AS \"{s}_{f}\"" for s, f in WIDE_COLS) + """
  FROM al a LEFT JOIN sf s ON s.source_id = a.source_id AND s.source_date = a.observation_date GROUP BY 1)"""


def _wide(spark, sf):
    return a.wide_exogenous(_aligned(spark, sf), views.source_registry(spark))


@query("exogenous_wide", S.with_(*AL, WIDE) + "SELECT origin_date, " + ", ".join(f"{S.r6(f'''\"{s}_{f}\"''')} AS \"{s}_{f}\"" for s, f in WIDE_COLS) + " FROM wide")
def _(spark, sf):
    return tidy(_wide(spark, sf).select("origin_date", *[F.col(f"`{s}_{f}`") for s, f in WIDE_COLS]))


_DEGENERATE = ("all_null", "constant", "sparse")
_KEPT = [f"{s}_{f}" for s, f in WIDE_COLS] + list(_DEGENERATE)


@query("exogenous_store", S.with_(*AL, WIDE) + """,
more AS (SELECT *, CAST(NULL AS DOUBLE) AS all_null, 7.0::DOUBLE AS "constant", CASE WHEN year(origin_date) = 1996 THEN CAST(dayofyear(origin_date) AS DOUBLE) END AS sparse FROM wide),
u AS (""" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count("{c}") AS n_present, stddev_samp("{c}") AS spread, {S.r6(f'avg("{c}")')} AS mean FROM more""" for c in _KEPT) + """)
SELECT "column", n_present, mean FROM u, (SELECT greatest(floor(0.5 * count(*)), 1) AS least FROM more) WHERE n_present >= least AND coalesce(spread, 0) <> 0""")
def _(spark, sf):
    """Columns that the store keeps, from a wide table with a column of each degenerate kind added."""
    wide = _wide(spark, sf).select("origin_date", *[F.col(f"`{s}_{f}`") for s, f in WIDE_COLS]).withColumns({
        "all_null": F.lit(None).cast("double"), "constant": F.lit(7.0),
        "sparse": F.when(F.year("origin_date") == 1996, F.dayofyear("origin_date").cast("double"))})
    kept, _gone = a.exogenous_store(frozen(wide))
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in kept.columns if c != "origin_date"]
    return tidy(kept.select(F.inline(F.array(*cells))).groupBy("column").agg(
        F.count("value").alias("n_present"), F.avg("value").alias("mean")))


_COMP = {"1-URGENT_return_1": -1, "3-MEDIUM_zscore_20": 1, "5-LOW_return_20": -1}


@query("composite_risk_factor", S.with_(*AL, WIDE) + ",\n" + f"""
f AS (SELECT origin_date, {', '.join(f'coalesce("{c}", 0) AS c{i}' for i, c in enumerate(_COMP))} FROM wide),
t AS (SELECT {', '.join(f'avg(c{i}) AS m{i}, stddev_pop(c{i}) AS s{i}' for i in range(3))} FROM f WHERE origin_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31')
SELECT origin_date, {S.r6('(-(c0 - m0) / s0 + (c1 - m1) / s1 - (c2 - m2) / s2) / 3')} AS risk_factor FROM f, t""")
def _(spark, sf):
    renamed = _wide(spark, sf).select("origin_date", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(_COMP)])
    out = a.composite_factor(renamed, {f"c{i}": s for i, s in enumerate(_COMP.values())}, ("1995-01-01", "1998-12-31"))
    return tidy(out.select("origin_date", "risk_factor"))


def _index_of(spark):
    return spark.createDataFrame([("AFRICA", "1-URGENT"), ("AMERICA", "2-HIGH"), ("ASIA", "5-LOW"), ("UNKNOWN", "5-LOW")], "sector string, index_id string")


MAPPING = """mapping AS (SELECT ticker, sector, CASE sector WHEN 'AFRICA' THEN '1-URGENT' WHEN 'AMERICA' THEN '2-HIGH' WHEN 'ASIA' THEN '5-LOW' ELSE '' END AS index_id FROM sectors)"""


def _mapping(spark, sf):
    return a.sector_index_mapping(views.sector_map(spark, sf), _index_of(spark))


@query("sector_index_mapping", S.with_(S.SECTORS, MAPPING) + "SELECT *, CASE WHEN index_id != '' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM mapping")
def _(spark, sf):
    return _mapping(spark, sf)


@query("sector_index_gate", S.with_(S.SECTORS, MAPPING) + f"""
SELECT count(*) AS n_tickers, count(*) FILTER (index_id != '') AS n_mapped, {S.r6("count(*) FILTER (index_id != '') / count(*)")} AS coverage,
  count(*) FILTER (index_id != '') / count(*) >= 0.5 AS included FROM mapping""")
def _(spark, sf):
    return tidy(a.mapping_gate(_mapping(spark, sf)))


_RET = ["log_return_1", "log_return_5", "log_return_20"]
IDX = "idx AS (SELECT a.source_id AS index_id, a.origin_date AS date, " + ", ".join(
    f"max(s.value) FILTER (s.feature = 'return_{k}') AS r{k}" for k in (1, 5, 20)) + \
    " FROM al a LEFT JOIN sf s ON s.source_id = a.source_id AND s.source_date = a.observation_date GROUP BY 1, 2)"


@query("stock_minus_index", S.with_(*S.features(_RET), *AL, IDX) + "SELECT ticker, f.date, " + ", ".join(
    f"{S.r6(f'log_return_{k} - r{k}')} AS stock_minus_index_{k}" for k in (1, 5, 20)) + " FROM feats f LEFT JOIN idx i ON i.date = f.date AND i.index_id = '1-URGENT'")
def _(spark, sf):
    stock = pf.panel_features(views.bars(spark, sf), _RET)
    out = a.relative_to_index(stock, a.index_returns(_aligned(spark, sf)), "1-URGENT", "stock_minus_index")
    return tidy(out.drop(*_RET))


@query("stock_minus_sector_index", S.with_(*S.features(_RET), *AL, IDX, S.SECTORS, MAPPING) + "SELECT f.ticker, f.date, m.index_id, " + ", ".join(
    f"{S.r6(f'log_return_{k} - r{k}')} AS stock_minus_sector_index_{k}" for k in (1, 5, 20))
    + " FROM feats f LEFT JOIN mapping m ON m.ticker = f.ticker LEFT JOIN idx i ON i.date = f.date AND i.index_id = m.index_id")
def _(spark, sf):
    stock = pf.panel_features(views.bars(spark, sf), _RET)
    out = a.relative_to_sector_index(stock, a.index_returns(_aligned(spark, sf)), _mapping(spark, sf))
    return tidy(out.drop(*_RET))


FAMILIES = {"X1": ["1-URGENT_return_20"], "X2": ["2-HIGH_drawdown_60", "2-HIGH_return_1"], "X3": ["3-MEDIUM_zscore_20"]}


@query("family_panels", S.with_(*S.features(["log_return_1"]), *AL, WIDE) + """,
j AS (SELECT f.ticker, f.date, "1-URGENT_return_20" IS NOT NULL AS ok_x1, "2-HIGH_drawdown_60" IS NOT NULL AND "2-HIGH_return_1" IS NOT NULL AS ok_x2, "3-MEDIUM_zscore_20" IS NOT NULL AS ok_x3
  FROM feats f LEFT JOIN wide w ON w.origin_date = f.date)
SELECT ticker, count(*) AS n_rows, count(*) FILTER (ok_x1) AS ok_x1, count(*) FILTER (ok_x2) AS ok_x2, count(*) FILTER (ok_x3) AS ok_x3, count(*) FILTER (ok_x1 AND ok_x2 AND ok_x3) AS ok_common FROM j GROUP BY 1""")
def _(spark, sf):
    stock = pf.panel_features(views.bars(spark, sf), ["log_return_1"])
    panel = a.family_panel(stock, _wide(spark, sf), FAMILIES)
    return panel.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("ok_X1").alias("ok_x1"), F.count_if("ok_X2").alias("ok_x2"),
                                       F.count_if("ok_X3").alias("ok_x3"), F.count_if("ok_common").alias("ok_common"))


_PREFIXES = {"P1": ["1-URGENT"], "P2": ["2-HIGH", "5-LOW"]}
_BY_PREFIX = {f: [f"{s}_{c}" for s, c in WIDE_COLS if s in sources] for f, sources in _PREFIXES.items()}


@query("family_panels_by_source", S.with_(*S.features(["log_return_1"]), *AL, WIDE) + ", j AS (SELECT f.ticker, " + ", ".join(
    "(" + " AND ".join(f'"{c}" IS NOT NULL' for c in cols) + f") AS ok_{f.lower()}" for f, cols in _BY_PREFIX.items())
    + " FROM feats f LEFT JOIN wide w ON w.origin_date = f.date) SELECT ticker, count(*) FILTER (ok_p1) AS ok_p1, count(*) FILTER (ok_p2) AS ok_p2, count(*) FILTER (ok_p1 AND ok_p2) AS ok_common FROM j GROUP BY 1")
def _(spark, sf):
    """Families given by their sources: the columns are those named after one of them."""
    wide = _wide(spark, sf).select("origin_date", *[F.col(f"`{s}_{f}`") for s, f in WIDE_COLS])
    families = {f: a.family_columns(wide.columns, sources) for f, sources in _PREFIXES.items()}
    panel = a.family_panel(pf.panel_features(views.bars(spark, sf), ["log_return_1"]), wide, families)
    return panel.groupBy("ticker").agg(F.count_if("ok_P1").alias("ok_p1"), F.count_if("ok_P2").alias("ok_p2"), F.count_if("ok_common").alias("ok_common"))


@query("source_verdicts", S.with_(S.EXT, S.REGISTRY) + """,
g AS (SELECT *, source_date - lag(source_date) OVER (PARTITION BY source_id ORDER BY source_date) AS gap FROM ext),
s AS (SELECT source_id, count(*) AS n, max(source_date) AS last_date, count(*) FILTER (gap > 45) AS long_gaps, count(*) FILTER (year(source_date) = 1997) AS n7, count(*) FILTER (year(source_date) = 1998) AS n8 FROM g GROUP BY 1),
r AS (SELECT *, concat_ws('; ', CASE WHEN last_date < DATE '1998-12-31' THEN 'coverage ends ' || last_date || ', before the development window' END,
  CASE WHEN n7 < 262 THEN '1997 has only ' || n7 || ' observations (floor 262)' WHEN 1 - n7 / greatest(n7, n8) > 0.05 THEN '1997 density ' || n7 || ' is ' || printf('%.3f', 1 - n7 / greatest(n7, n8)) || ' below this source''s best development year (' || greatest(n7, n8) || ')' END,
  CASE WHEN n8 < 262 THEN '1998 has only ' || n8 || ' observations (floor 262)' WHEN 1 - n8 / greatest(n7, n8) > 0.05 THEN '1998 density ' || n8 || ' is ' || printf('%.3f', 1 - n8 / greatest(n7, n8)) || ' below this source''s best development year (' || greatest(n7, n8) || ')' END,
  CASE WHEN long_gaps > 0 THEN long_gaps || ' unexplained gap(s) longer than 45 calendar days' END) AS reason FROM s),
m AS (SELECT source_id, count(*) FILTER (abs(ln(close) - lc) > 0.35) AS jumps FROM (SELECT *, lag(ln(close)) OVER (PARTITION BY source_id ORDER BY source_date) AS lc FROM ext) GROUP BY 1)
SELECT source_id, availability, asset_class, reason = '' AS accepted, reason AS rejection_reason, n AS n_observations, CAST(0 AS BIGINT) AS duplicate_dates, jumps AS suspicious_jumps
FROM registry JOIN r USING (source_id) JOIN m USING (source_id)""")
def _(spark, sf):
    ext = views.ext_series(spark, sf)
    return a.source_verdicts(q.source_coverage_gate(ext, 1997, 1998, floor=262), q.source_integrity(ext), views.source_registry(spark))


# ---- news ------------------------------------------------------------------

def _news_origins(spark, sf):
    return views.news(spark, sf).select("ticker", F.date_add("publish_date", 2).alias("origin_date")).distinct()


_NO = "orig AS (SELECT DISTINCT ticker, publish_date + 2 AS origin_date FROM news)"


def _counts(windows, name):
    return ", ".join(f"(SELECT count(*) FROM news n WHERE n.ticker = o.ticker AND n.publish_date < o.origin_date AND n.publish_date >= o.origin_date - {w}) AS {name}_{w}d" for w in windows)


@query("news_windows", S.with_(S.NEWS, _NO) + f"SELECT *, news_3d > 0 AS news_present FROM (SELECT ticker, origin_date, {_counts(nw.NEWS_WINDOWS, 'news')} FROM orig o)")
def _(spark, sf):
    return nw.window_counts(_news_origins(spark, sf), nw.assert_dated(views.news(spark, sf)))


@query("event_pressure", S.with_(S.NEWS, _NO) + "SELECT ticker, origin_date, " + ", ".join(
    f"CASE WHEN origin_date > DATE '2024-01-10' THEN event_{w}d END AS event_{w}d" for w in nw.EVENT_WINDOWS)
    + f", CASE WHEN origin_date > DATE '2024-01-10' THEN event_3d > 0 END AS event_present FROM (SELECT ticker, origin_date, {_counts(nw.EVENT_WINDOWS, 'event')} FROM orig o)")
def _(spark, sf):
    return nw.window_counts(_news_origins(spark, sf), views.news(spark, sf), nw.EVENT_WINDOWS, "event", "2024-01-10")


# ---- aliases ---------------------------------------------------------------

def _alias_rows(spark, sf):
    """Dated and undated aliases made from part rows: one per part, several per brand."""
    k = F.col("p_partkey")
    start = F.date_add(F.lit("2013-01-01").cast("date"), (k * 37 % 2400).cast("int"))
    return views.table(spark, sf, "part").select(
        F.col("p_brand").alias("ticker"), F.concat("p_name", F.lit(" "), k).alias("alias"),
        F.when(k % 4 == 0, nw.REJECTED).when(k % 4 == 1, nw.HISTORICAL).otherwise(nw.EXACT).alias("class"),
        F.when(k % 3 == 0, start).alias("valid_from"), F.when(k % 5 == 0, F.date_add(start, (k % 700).cast("int"))).alias("valid_to"))


ALIASES = """al AS (SELECT p_brand AS ticker, p_name || ' ' || p_partkey AS alias, CASE p_partkey % 4 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'HISTORICAL_SAFE' ELSE 'EXACT_SAFE' END AS class,
  CASE WHEN p_partkey % 3 = 0 THEN DATE '2013-01-01' + CAST(p_partkey * 37 % 2400 AS INTEGER) END AS valid_from,
  CASE WHEN p_partkey % 5 = 0 THEN DATE '2013-01-01' + CAST(p_partkey * 37 % 2400 AS INTEGER) + CAST(p_partkey % 700 AS INTEGER) END AS valid_to FROM part)"""


def _alias_windows_sql(spans: str, keys: str) -> str:
    on = " AND ".join(f"s.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""{spans},
pts AS (SELECT DISTINCT {keys}, lo AS start, lo, hi FROM spans UNION SELECT DISTINCT {', '.join('s.' + k.strip() for k in keys.split(','))}, valid_from, lo, hi FROM spans s JOIN al USING (ticker) WHERE valid_from > lo AND valid_from <= hi
  UNION SELECT DISTINCT {', '.join('s.' + k.strip() for k in keys.split(','))}, valid_to + 1, lo, hi FROM spans s JOIN al USING (ticker) WHERE valid_to + 1 > lo AND valid_to + 1 <= hi),
parts AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY {keys} ORDER BY start) - 1, hi) AS "end" FROM pts),
wins AS (SELECT {keys}, start, "end", first(alias ORDER BY valid_from IS NULL, valid_to IS NULL, alias) AS alias, first(class ORDER BY valid_from IS NULL, valid_to IS NULL, alias) AS class
  FROM parts JOIN al USING (ticker) WHERE class IN ('EXACT_SAFE', 'HISTORICAL_SAFE') AND (valid_from IS NULL OR valid_from <= start) AND (valid_to IS NULL OR start <= valid_to) GROUP BY ALL)"""


@query("alias_windows", S.with_(ALIASES, _alias_windows_sql("spans AS (SELECT DISTINCT ticker, DATE '2013-04-01' AS lo, DATE '2018-12-31' AS hi FROM al)", "ticker")) + "SELECT * FROM wins")
def _(spark, sf):
    return nw.alias_windows(_alias_rows(spark, sf), "2013-04-01", "2018-12-31")


_PLAN = _alias_windows_sql("spans AS (SELECT DISTINCT ticker, y AS year, greatest(make_date(y, 1, 1), DATE '2013-04-01') AS lo, make_date(y, 12, 31) AS hi FROM al, (SELECT unnest(range(2013, 2019)) AS y))", "ticker, year")


@query("alias_query_plan", S.with_(ALIASES, _PLAN) + "SELECT *, '\"' || alias || '\"' AS query FROM wins")
def _(spark, sf):
    return tidy(nw.query_plan(_alias_rows(spark, sf), tuple(range(2013, 2019)), "2013-04-01", "2018-12-31"))


@query("query_call_budget", S.with_(ALIASES, _PLAN) + "SELECT year, count(*) AS n_windows, count(*) * 2 AS coverage_calls, round(count(*) * 2 / 10.0, 1) + 0.0 AS estimated_minutes FROM wins GROUP BY 1")
def _(spark, sf):
    plan = nw.query_plan(_alias_rows(spark, sf), tuple(range(2013, 2019)), "2013-04-01", "2018-12-31")
    return tidy(nw.call_budget(plan), 1)


@query("leading_dates", """
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN d WHEN 1 THEN CAST(date_trunc('month', d) AS DATE) WHEN 2 THEN d WHEN 3 THEN CAST(date_trunc('year', d) AS DATE) ELSE NULL END AS parsed FROM t""")
def _(spark, sf):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.concat(d.cast("string"), F.lit("; 2025-10-01"))).when(k == 1, F.date_format(d, "yyyy-MM"))
            .when(k == 2, F.date_format(d, "yyyyMMdd")).when(k == 3, F.concat(F.lit(" "), F.date_format(d, "yyyy"))).otherwise("soon"))
    return views.table(spark, sf, "orders").select("o_orderkey", nw.leading_date(text).alias("parsed"))


def _registry(spark, sf):
    k = F.col("s_suppkey")
    sup = views.table(spark, sf, "supplier").select(k.alias("k"), k.cast("string").alias("ticker"))
    k = F.col("k")
    over = sup.where(k % 7 == 0).select("ticker", F.concat(F.lit("Override "), "ticker").alias("alias"), F.lit(nw.EXACT).alias("class"),
                                        F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    lin = sup.where(k % 3 == 0).select(
        "ticker", F.concat(F.lit("New "), k % 20, F.lit(" Works Limited")).alias("current_name"),
        F.when(k % 2 == 0, F.concat(F.lit("Old "), "ticker", F.lit(" Ltd"))).alias("historical_name"),
        F.when(k % 4 == 0, "acquired_and_merged").otherwise("rename").alias("event_type"),
        F.concat((F.lit(2000) + k % 15).cast("string"), F.lit("-05; 2020")).alias("event_date"))
    off = sup.where(k % 5 != 0).select("ticker", F.concat(F.lit("PLAIN NAME "), k % 30, F.lit(" LIMITED")).alias("company_name"))
    return nw.alias_registry(sup, over, lin, off)


REG = """u AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier),
o AS (SELECT ticker, 'Override ' || ticker AS alias, 'EXACT_SAFE' AS class, CAST(NULL AS DATE) AS valid_to, 'RESOLVED_FROM_OVERRIDE' AS st FROM u WHERE k % 7 = 0),
l AS (SELECT * FROM u WHERE k % 3 = 0 AND k % 7 != 0),
la AS (SELECT ticker, 'New ' || (k % 20) || ' Works Limited' AS alias, 'EXACT_SAFE' AS class, CAST(NULL AS DATE) AS valid_to FROM l UNION ALL SELECT ticker, 'New ' || (k % 20) || ' Works', 'EXACT_SAFE', NULL FROM l
  UNION ALL SELECT ticker, 'Old ' || ticker || ' Ltd', CASE WHEN k % 4 = 0 THEN 'REJECTED' ELSE 'HISTORICAL_SAFE' END, make_date(2000 + k % 15, 5, 1) FROM l WHERE k % 2 = 0
  UNION ALL SELECT ticker, 'Old ' || ticker, 'HISTORICAL_SAFE', make_date(2000 + k % 15, 5, 1) FROM l WHERE k % 2 = 0 AND k % 4 != 0),
f AS (SELECT * FROM u WHERE k % 5 != 0 AND k % 3 != 0 AND k % 7 != 0),
fa AS (SELECT ticker, 'Plain Name ' || (k % 30) || ' Limited' AS alias FROM f UNION ALL SELECT ticker, 'Plain Name ' || (k % 30) FROM f),
reg AS (SELECT ticker, alias, class, CAST(NULL AS DATE) AS valid_from, valid_to, st AS resolution_status FROM o UNION ALL SELECT ticker, alias, class, NULL, valid_to, 'RESOLVED_FROM_LINEAGE' FROM la
  UNION ALL SELECT ticker, alias, 'EXACT_SAFE', NULL, NULL, 'RESOLVED_FROM_OFFICIAL_NAME' FROM fa
  UNION ALL SELECT ticker, NULL, NULL, NULL, NULL, 'UNRESOLVED' FROM u WHERE k % 7 != 0 AND k % 3 != 0 AND k % 5 = 0)"""


@query("alias_registry", S.with_(REG) + "SELECT * FROM reg")
def _(spark, sf):
    return _registry(spark, sf)


@query("alias_collisions", S.with_(REG) + """
SELECT lower(trim(alias)) AS alias, count(DISTINCT ticker) AS n_tickers FROM reg WHERE class IN ('EXACT_SAFE', 'HISTORICAL_SAFE') GROUP BY 1 HAVING count(DISTINCT ticker) > 1""")
def _(spark, sf):
    return nw.alias_collisions(_registry(spark, sf))


@query("headline_relevance", """
WITH al AS (SELECT CAST(item_id AS VARCHAR) AS ticker, array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x != '')[1:CAST(2 + item_id % 3 AS BIGINT)], ' ') AS phrase FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}]+'), lambda x: x != ''), ' ') || ' ' AS t,
  ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x != ''), ' ') || ' ' AS b FROM documents)
SELECT doc_id AS article_id, ticker, CASE WHEN contains(t, ' ' || phrase || ' ') THEN 'TITLE_EXPLICIT' ELSE 'BODY_MATCH_ONLY' END AS relevance
FROM d, al WHERE contains(b, ' ' || phrase || ' ')""")
def _(spark, sf):
    bench = views.table(spark, sf, "benchmark")
    first = F.slice(nw.words(F.col("text")), F.lit(1), (F.lit(2) + F.col("item_id") % 3).cast("int"))
    aliases = bench.select(F.col("item_id").cast("string").alias("ticker"), F.array_join(first, " ").alias("alias"), F.lit(nw.EXACT).alias("class"))
    docs = views.table(spark, sf, "documents").select("doc_id", "text").select(
        F.col("doc_id").alias("article_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("body"))
    return nw.headline_relevance(docs, aliases)


# ---- event rows ------------------------------------------------------------

def _event_rows(spark, sf):
    """Orders written as headerless event rows of 13 text fields."""
    o, k, c = views.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    quad = k % 4 + 1
    base = F.element_at(F.array(F.lit(2.0), F.lit(5.0), F.lit(-3.0), F.lit(-8.0)), quad.cast("int"))
    fields = [k, F.lit("20170612000000"), F.concat(F.lit("https://n/"), k), quad, base + k % 10 / 10, F.col("o_totalprice"),
              F.when(c % 7 == 0, "India").otherwise("Elsewhere"), F.when(c % 7 == 0, "IN").otherwise("ZZ"), F.lit(""),
              F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("x"), F.when(c % 11 == 0, "IN").otherwise("QQ")]
    return o.select(F.array(*[f.cast("string") for f in fields]).alias("fields"), F.col("o_orderpriority").alias("archive"))


EVENTS = """ev AS (SELECT [CAST(o_orderkey AS VARCHAR), '20170612000000', 'https://n/' || o_orderkey, CAST(o_orderkey % 4 + 1 AS VARCHAR),
  CAST([2.0::DOUBLE, 5.0, -3.0, -8.0][o_orderkey % 4 + 1] + o_orderkey % 10 / 10 AS VARCHAR), CAST(o_totalprice AS VARCHAR),
  CASE WHEN o_custkey % 7 = 0 THEN 'India' ELSE 'Elsewhere' END, CASE WHEN o_custkey % 7 = 0 THEN 'IN' ELSE 'ZZ' END, '', o_orderstatus, o_orderpriority, 'x',
  CASE WHEN o_custkey % 11 = 0 THEN 'IN' ELSE 'QQ' END] AS f, o_orderpriority AS archive, o_orderkey AS id FROM orders)"""


@query("event_columns_inferred", S.with_(EVENTS) + """,
c AS (SELECT id, f, unnest(range(0, 13)) AS pos FROM ev), v AS (SELECT id, f, pos, f[pos + 1] AS v FROM c),
p AS (SELECT pos, bool_and(v = '20170612000000') AS st, bool_and(regexp_matches(v, '^https?://')) AS ur, bool_and(v IN ('1', '2', '3', '4')) AND count(DISTINCT v) = 4 AS qu,
  bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) AS nu, count(DISTINCT v) AS nd, bool_or(contains(v, '.')) AS fr, bool_or(v = 'India') AS co FROM v GROUP BY 1),
q AS (SELECT pos, avg(TRY_CAST(v AS DOUBLE)) FILTER (f[4] = '1') AS m1, avg(TRY_CAST(v AS DOUBLE)) FILTER (f[4] = '2') AS m2, avg(TRY_CAST(v AS DOUBLE)) FILTER (f[4] = '3') AS m3,
  avg(TRY_CAST(v AS DOUBLE)) FILTER (f[4] = '4') AS m4, bool_and(coalesce(abs(TRY_CAST(v AS DOUBLE)) <= 1e6, true)) AS inr FROM v GROUP BY 1),
g AS (SELECT min(pos) AS pos FROM p JOIN q USING (pos) WHERE nu AND NOT qu AND inr AND m2 > m1 AND m1 > m3 AND m3 > m4)
SELECT 'date_added' AS role, CAST(pos AS BIGINT) AS pos FROM p WHERE st UNION ALL SELECT 'source_url', pos FROM p WHERE ur UNION ALL SELECT 'quad_class', pos FROM p WHERE qu UNION ALL SELECT 'country_name', pos FROM p WHERE co
UNION ALL SELECT 'goldstein', pos FROM g UNION ALL SELECT 'avg_tone', min(pos) FROM p JOIN q USING (pos) WHERE nd > 20 AND fr AND nu AND inr AND NOT qu AND pos != (SELECT pos FROM g)
UNION ALL SELECT DISTINCT 'country_code', v.pos FROM v, p WHERE p.co AND v.v = 'IN' AND abs(v.pos - p.pos) <= 2 AND v.f[p.pos + 1] = 'India'""")
def _(spark, sf):
    rows = _event_rows(spark, sf)
    return tidy(nw.infer_columns(rows, F.lit("20170612000000")))


@query("country_events", S.with_(EVENTS) + f"""
SELECT archive, f[4] AS quad_class, count(*) AS n_events, {S.r6('avg(CAST(f[5] AS DOUBLE))')} AS mean_scale FROM ev WHERE f[7] = 'India' OR f[8] = 'IN' GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(nw.country_events(_event_rows(spark, sf), [6], [7], 3, 4, by=("archive",)))


@query("hit_coverage", """
WITH d AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (value > 60) AS title_n, event_type != 'error' AS measured FROM events GROUP BY 1, 2, 5),
p AS (SELECT ticker, year(day) AS year, sum(n) AS total, sum(title_n) AS title_total, count(*) FILTER (n > 60) AS match_days FROM (SELECT ticker, day, CASE WHEN n > 60 THEN n ELSE 0 END AS n, title_n, measured FROM d) WHERE measured GROUP BY 1, 2)
SELECT year, count(*) AS n_tickers, CAST(sum(total) AS BIGINT) AS total, CAST(sum(title_total) AS BIGINT) AS title_total, median(match_days) + 0.0 AS median_match_days FROM p GROUP BY 1""")
def _(spark, sf):
    daily = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 60).alias("title_n"))
    daily = daily.withColumns({"n": F.when(F.col("n") > 60, F.col("n")).otherwise(0), "measured": F.col("ticker") != "error"})
    return tidy(nw.hit_coverage(daily))
