"""Labels, samples, splits, scalers and universes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import panel_features as pf
from ..operators import samples as smp
from ..operators import scaling, splits, targets, universe
from ..plans import views
from ..sources import bars as src
from . import sql as S
from .quality import FOLDS, FOLDS_SQL, UNION_TARGETS
from .registry import query
from .tidy import tidy

# ---- labels ----------------------------------------------------------------

_VOL = ["realized_vol_20"]
FULL_TARGET_COLS = f"""ticker, origin_date, target_date, {S.r6('realized_vol_20')} AS realized_vol_20,
  {S.r6('raw_next_return')} AS raw_next_return, CAST(y_direction AS BIGINT) AS y_direction,
  {S.r6('CASE WHEN realized_vol_20 IS NOT NULL THEN greatest(least(raw_next_return / greatest(realized_vol_20, 1e-4), 5), -5) END')} AS y_return,
  {S.r6(S.avg_rank('raw_next_return', 'target_date'))} AS y_rank"""


@query("targets_union_calendar", S.with_(*S.features(_VOL), UNION_TARGETS)
       + f"SELECT t.{FULL_TARGET_COLS} FROM utargets t LEFT JOIN (SELECT ticker AS ft, date AS fd, realized_vol_20 FROM feats) "
         "ON ft = t.ticker AND fd = t.origin_date")
def _(spark, sf):
    bars = views.bars(spark, sf)
    return tidy(targets.next_day_targets(bars, pf.panel_features(bars, _VOL), "union"))


@query("targets_own_calendar", S.with_(*S.features(_VOL), S.TARGETS_OWN)
       + f"SELECT t.{FULL_TARGET_COLS} FROM targets t LEFT JOIN (SELECT ticker AS ft, date AS fd, realized_vol_20 FROM feats) "
         "ON ft = t.ticker AND fd = t.origin_date WHERE target_date <= DATE '2000-12-31'")
def _(spark, sf):
    bars = views.bars(spark, sf)
    return tidy(targets.next_day_targets(bars, pf.panel_features(bars, _VOL), "own", "2000-12-31"))


@query("targets_by_horizon", S.with_(S.BARS, S.horizon_targets(boundary="2000-12-31")) + f"""
SELECT ticker, origin_date, target_end_date, CAST(horizon AS BIGINT) AS horizon, {S.r6('future_log_return')} AS future_log_return,
  CAST(y AS BIGINT) AS y, {S.px('close_t')} AS close_t, {S.px('close_t_plus_h')} AS close_t_plus_h FROM htargets""")
def _(spark, sf):
    out = targets.horizon_targets(views.bars(spark, sf), boundary="2000-12-31")
    return tidy(out, prices=("close_t", "close_t_plus_h"))


@query("target_schema", S.with_(S.BARS, S.horizon_targets()) + f"""
SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(origin_date) AS first_origin_date,
  max(origin_date) AS last_origin_date, max(target_end_date) AS last_target_end_date, {S.r6('avg(y)')} AS positive_rate
FROM htargets GROUP BY 1""")
def _(spark, sf):
    return tidy(targets.target_schema(targets.horizon_targets(views.bars(spark, sf))))


@query("common_origins", S.with_(S.BARS, S.horizon_targets()) + """
SELECT ticker, origin_date FROM htargets GROUP BY 1, 2 HAVING count(DISTINCT horizon) = 4""")
def _(spark, sf):
    return targets.common_origins(targets.horizon_targets(views.bars(spark, sf)))


@query("non_overlapping_origins", S.with_(S.BARS, S.horizon_targets()) + """
SELECT ticker, CAST(horizon AS BIGINT) AS horizon, origin_date, target_end_date FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, horizon ORDER BY origin_date) - 1 AS p FROM htargets) WHERE p % horizon = 0""")
def _(spark, sf):
    out = targets.non_overlapping(targets.horizon_targets(views.bars(spark, sf)))
    return tidy(out.select("ticker", "horizon", "origin_date", "target_end_date"))


@query("non_overlap_spacing", S.with_(S.BARS, S.horizon_targets()) + """,
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, horizon ORDER BY origin_date) - 1 AS p FROM htargets) WHERE p % horizon = 0),
g AS (SELECT *, origin_date - lag(origin_date) OVER (PARTITION BY ticker, horizon ORDER BY origin_date) AS gap FROM k)
SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS n_origins, count(DISTINCT ticker) AS n_tickers, min(gap) AS min_gap_days FROM g GROUP BY 1""")
def _(spark, sf):
    kept = targets.non_overlapping(targets.horizon_targets(views.bars(spark, sf)))
    return tidy(targets.overlap_spacing(kept))


# ---- samples ---------------------------------------------------------------

_WIN = ["log_return_5", "realized_vol_20", "drawdown_20"]
_LEN = 30


def _finite(cols):
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


FLAGS = f"""flags AS (SELECT *, row_number() OVER w - 1 AS row,
  sum(CAST({_finite(_WIN)} AS INTEGER)) OVER (PARTITION BY ticker ORDER BY date ROWS {_LEN - 1} PRECEDING) = {_LEN} AND drawdown_60 IS NOT NULL AS window_ok
  FROM feats WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
_FLAG_FEATS = S.features([*_WIN, "drawdown_60"])
JUDGED = f"""judged AS (SELECT t.*, f.row, CASE WHEN f.row IS NULL OR f.row < {_LEN - 1} THEN 'no_full_window' WHEN NOT f.window_ok THEN 'non_finite_inputs' END AS drop_reason
  FROM targets t LEFT JOIN flags f ON f.ticker = t.ticker AND f.date = t.origin_date)"""


def _judged(spark, sf):
    bars = views.bars(spark, sf)
    feats = pf.panel_features(bars, [*_WIN, "drawdown_60"])
    return smp.judge_samples(feats, targets.next_day_targets(bars, calendar="own"), _WIN, _LEN, ["drawdown_60"])


@query("sample_table", S.with_(*_FLAG_FEATS, FLAGS, S.TARGETS_OWN, JUDGED, S.SECTORS) + """,
tv AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS id FROM (SELECT DISTINCT ticker FROM bars)),
sv AS (SELECT sector, row_number() OVER (ORDER BY sector) AS id FROM (SELECT DISTINCT sector FROM sectors))
SELECT j.ticker, origin_date, target_date, j.row, tv.id AS ticker_id, coalesce(sv.id, 0) AS sector_id, CAST(y_direction AS BIGINT) AS y_direction
FROM judged j JOIN tv ON tv.ticker = j.ticker LEFT JOIN sectors s ON s.ticker = j.ticker LEFT JOIN sv ON sv.sector = s.sector
WHERE drop_reason IS NULL""")
def _(spark, sf):
    sectors = views.sector_map(spark, sf)
    tickers = universe.vocabulary(views.bars(spark, sf), "ticker")
    out = smp.add_ids(smp.usable(_judged(spark, sf)), tickers, universe.vocabulary(sectors, "sector"), sectors)
    return tidy(out.select("ticker", "origin_date", "target_date", "row", "ticker_id", "sector_id", "y_direction"))


@query("sample_drop_reasons", S.with_(*_FLAG_FEATS, FLAGS, S.TARGETS_OWN, JUDGED)
       + "SELECT coalesce(drop_reason, 'usable') AS outcome, count(*) AS n FROM judged GROUP BY 1")
def _(spark, sf):
    return smp.drop_counts(_judged(spark, sf))


HJUDGED = f"""hjudged AS (SELECT t.*, f.row, CASE WHEN t.target_end_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'sealed_year_excluded'
   WHEN f.row IS NULL OR f.row < {_LEN - 1} THEN 'no_full_window' WHEN NOT f.window_ok THEN 'non_finite_inputs' END AS drop_reason
  FROM htargets t LEFT JOIN flags f ON f.ticker = t.ticker AND f.date = t.origin_date)"""
_HSAMPLES = [*_FLAG_FEATS, FLAGS, S.horizon_targets(), HJUDGED]


def _hjudged(spark, sf, sealed=("2000-01-01", "2000-12-31")):
    bars = views.bars(spark, sf)
    feats = pf.panel_features(bars, [*_WIN, "drawdown_60"])
    rows = targets.horizon_targets(bars).withColumnsRenamed({"target_end_date": "target_date", "y": "y_direction"})
    return smp.judge_samples(feats, rows, _WIN, _LEN, ["drawdown_60"], sealed=sealed)


@query("horizon_sample_outcomes", S.with_(*_HSAMPLES)
       + "SELECT CAST(horizon AS BIGINT) AS horizon, coalesce(drop_reason, 'usable') AS outcome, count(*) AS n FROM hjudged GROUP BY 1, 2")
def _(spark, sf):
    return tidy(smp.drop_counts(_hjudged(spark, sf), ("horizon",)))


@query("horizon_sample_table", S.with_(*_HSAMPLES) + f"""
SELECT ticker, origin_date, target_end_date AS target_date, CAST(horizon AS BIGINT) AS horizon, row, CAST(y AS BIGINT) AS y_direction,
  {S.r6('future_log_return')} AS future_log_return FROM hjudged WHERE drop_reason IS NULL""")
def _(spark, sf):
    out = smp.usable(_hjudged(spark, sf))
    return tidy(out.select("ticker", "origin_date", "target_date", "horizon", "row", "y_direction", "future_log_return"))


_BASE = ["log_return", "realized_volatility_20", "returns_10"]


def _base_frame(spark, sf):
    from ..operators.base_features import base_features
    return base_features(views.bars(spark, sf), _BASE, use_ohlcv=False)


_BASE_SQL = f"""basef AS (SELECT ticker, date, lr AS log_return, {S.full('stddev_samp', 'lr', 20)} AS realized_volatility_20,
  close / ({S.lagged('close', 10)}) - 1 AS returns_10, CAST(lead(close) OVER w > close AS INTEGER) AS target, lead(date) OVER w AS target_date
  FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY date)),
bsamples AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS row FROM basef
  WHERE target IS NOT NULL AND {_finite(_BASE)}) WHERE row >= {_LEN - 1})"""


@query("windows_ending_at_origin", S.with_(S.BARS, S.STEPS, _BASE_SQL)
       + "SELECT ticker, date AS origin_date, target_date, row, CAST(target AS DOUBLE) AS target FROM bsamples")
def _(spark, sf):
    out = smp.base_samples(_base_frame(spark, sf), _BASE, _LEN)
    return tidy(out.select("ticker", "origin_date", "target_date", "row", "target"))


@query("sequences_at_origin", S.with_(S.BARS, S.STEPS) + f"""
SELECT ticker, date, len(s) AS length, {S.r6('s[1]')} AS oldest, {S.r6(f's[{_LEN}]')} AS newest, {S.r6('list_sum(s)')} AS total FROM (
  SELECT ticker, date, CASE WHEN count(lr) OVER w = {_LEN} THEN list(lr) OVER w END AS s
  FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS {_LEN - 1} PRECEDING)) WHERE s IS NOT NULL""")
def _(spark, sf):
    out = smp.with_sequences(_base_frame(spark, sf), ["log_return"], _LEN).where(F.col("sequence").isNotNull())
    return _sequence_summary(out)


def _sequence_summary(df):
    s = F.flatten("sequence")
    return tidy(df.select("ticker", "date", F.size("sequence").alias("length"), F.element_at(s, 1).alias("oldest"),
                          F.element_at(s, -1).alias("newest"), F.aggregate(s, F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("sequences_before_label", S.with_(S.BARS, S.STEPS) + f"""
SELECT ticker, date, len(s) AS length, {S.r6('s[1]')} AS oldest, {S.r6(f's[{_LEN}]')} AS newest, {S.r6('list_sum(s)')} AS total FROM (
  SELECT ticker, date, CASE WHEN count(lr) OVER w = {_LEN} THEN list(lr) OVER w END AS s
  FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {_LEN} PRECEDING AND 1 PRECEDING)) WHERE s IS NOT NULL""")
def _(spark, sf):
    return _sequence_summary(smp.sequences_before(_base_frame(spark, sf), ["log_return"], _LEN))


@query("target_day_leak", S.with_(S.BARS, S.STEPS) + f""",
sq AS (SELECT ticker, date, lr, lead(date) OVER v AS target_date, count(lr) OVER w = {_LEN} AS whole, lag(lr, {_LEN - 2}) OVER v AS second
  FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS {_LEN - 1} PRECEDING), v AS (PARTITION BY ticker ORDER BY date)),
nx AS (SELECT *, lead(whole) OVER v AS next_whole, lead(target_date) OVER v AS next_target, lead(lr) OVER v AS next_lr FROM sq WINDOW v AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date AS origin_date, target_date, {S.r6('second')} AS oldest, {S.r6('next_lr')} AS newest
FROM nx WHERE whole AND next_whole AND target_date IS NOT NULL AND next_target IS NOT NULL""")
def _(spark, sf):
    base = _base_frame(spark, sf).withColumn("target_date", targets.ahead(F.col("date")))
    rows = smp.with_sequences(base, ["log_return"], _LEN).where(
        F.col("sequence").isNotNull() & F.col("target_date").isNotNull()).withColumnRenamed("date", "origin_date")
    out = smp.target_day_leak(rows)
    s = F.flatten("leaked")
    return tidy(out.select("ticker", "origin_date", "target_date", F.element_at(s, 1).alias("oldest"),
                           F.element_at(s, -1).alias("newest")))


@query("origin_snapshot", S.with_(*S.features(["log_return_5", "drawdown_60"]), S.TARGETS_OWN) + f"""
SELECT t.ticker, t.origin_date, CAST(y_direction AS BIGINT) AS y_direction, {S.r6('log_return_5')} AS log_return_5,
  {S.r6('drawdown_60')} AS drawdown_60 FROM targets t JOIN feats f ON f.ticker = t.ticker AND f.date = t.origin_date""")
def _(spark, sf):
    bars = views.bars(spark, sf)
    cols = ["log_return_5", "drawdown_60"]
    rows = targets.next_day_targets(bars, calendar="own").select("ticker", "origin_date", "y_direction")
    return tidy(smp.origin_snapshot(rows, pf.panel_features(bars, cols), cols))


@query("exogenous_windows", S.with_(S.BARS, S.EXT) + """,
x AS (SELECT source_date AS date, CAST(count(DISTINCT source_id) = 5 AS INTEGER) AS ok FROM ext WHERE close IS NOT NULL GROUP BY 1),
f AS (SELECT b.ticker, b.date, sum(coalesce(x.ok, 0)) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS 9 PRECEDING) = 10 AS exogenous_ok
  FROM bars b LEFT JOIN x ON x.date = b.date)
SELECT ticker, count(*) AS n_rows, count(*) FILTER (exogenous_ok) AS n_ok FROM f GROUP BY 1""")
def _(spark, sf):
    sources = sorted(views.SOURCE_CLASS)
    x = views.ext_series(spark, sf).groupBy(F.col("source_date").alias("date")).pivot("source_id", sources).agg(F.first("close"))
    flags = smp.exogenous_windows(views.bars(spark, sf), x.toDF("date", *[f"close_{i}" for i in range(len(sources))]),
                                  [f"close_{i}" for i in range(len(sources))], 10)
    return flags.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("exogenous_ok").alias("n_ok"))


@query("support_query_episodes", S.with_(S.BARS, S.TARGETS_OWN) + """,
p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY origin_date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM targets),
e AS (SELECT DISTINCT ticker, n, unnest(range(0, n - 140 + 1, 20)) AS start FROM p WHERE n >= 140)
SELECT e.ticker, e.start, count(*) FILTER (pos < start + 120) AS n_support, count(*) FILTER (pos >= start + 120) AS n_query,
  min(origin_date) AS support_first, max(origin_date) FILTER (pos < start + 120) AS support_last,
  min(origin_date) FILTER (pos >= start + 120) AS query_first, max(origin_date) AS query_last
FROM e JOIN p ON p.ticker = e.ticker AND pos >= start AND pos < start + 140 GROUP BY 1, 2""")
def _(spark, sf):
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own")
    return smp.episode_spans(smp.episodes(rows))


@query("support_query_subsample", S.with_(S.BARS, S.TARGETS_OWN) + """,
p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY origin_date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM targets),
e AS (SELECT DISTINCT ticker, n, unnest(range(0, n - 140 + 1, 20)) AS start FROM p WHERE n >= 140),
k AS (SELECT ticker, start FROM e ORDER BY CAST('0x' || substr(md5('42|' || ticker || '|' || start), 1, 8) AS BIGINT), ticker, start LIMIT 60)
SELECT k.ticker, k.start, count(*) FILTER (pos < start + 120) AS n_support, count(*) FILTER (pos >= start + 120) AS n_query,
  min(origin_date) AS support_first, max(origin_date) FILTER (pos < start + 120) AS support_last,
  min(origin_date) FILTER (pos >= start + 120) AS query_first, max(origin_date) AS query_last
FROM k JOIN p ON p.ticker = k.ticker AND pos >= start AND pos < start + 140 GROUP BY 1, 2""")
def _(spark, sf):
    """Sixty episodes drawn by a seed; the limit is the feature."""
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own")
    return smp.episode_spans(smp.episodes(rows, max_episodes=60))


@query("support_before_validation", S.with_(S.BARS, S.TARGETS_OWN) + """
SELECT ticker, origin_date, target_date FROM targets WHERE target_date <= DATE '1998-12-31' AND target_date < DATE '1999-01-01'
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY origin_date DESC) <= 40""")
def _(spark, sf):
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own")
    return smp.support_before(rows, 40, "1998-12-31", "1999-01-01").select("ticker", "origin_date", "target_date")


@query("ticker_balanced_weights", S.with_(S.BARS, S.TARGETS_OWN) + f"""
SELECT ticker, origin_date, {S.r6('(1.0 / n) / sum(1.0 / n) OVER ()', 9)} AS weight
FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM targets)""")
def _(spark, sf):
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own")
    return tidy(smp.balanced_weights(rows).select("ticker", "origin_date", "weight"), 9)


@query("sample_summary", S.with_(S.BARS, S.TARGETS_OWN) + f"""
SELECT count(*) AS n_samples, count(DISTINCT ticker) AS n_tickers, min(origin_date) AS first_origin_date, max(origin_date) AS last_origin_date,
  min(target_date) AS first_target_date, max(target_date) AS last_target_date, {S.r6('avg(y_direction)')} AS direction_positive_rate FROM targets""")
def _(spark, sf):
    return tidy(smp.sample_summary(targets.next_day_targets(views.bars(spark, sf), calendar="own")))


# ---- universe --------------------------------------------------------------

@query("files_chosen_per_ticker", """
WITH f AS (SELECT 'dir/SUP' || (s_suppkey % 37) || CASE WHEN s_suppkey % 3 = 0 THEN '_minute_new' WHEN s_suppkey % 3 = 1 THEN '_minute' ELSE '_1min' END
   || '.csv' AS path, s_suppkey * 100 + 7 AS length, s_suppkey % 3 = 0 AS is_new, 'SUP' || (s_suppkey % 37) AS ticker FROM supplier)
SELECT ticker, first(path ORDER BY is_new, -length, path) AS path, first(length ORDER BY is_new, -length, path) AS length, count(*) AS n_files
FROM f GROUP BY 1""")
def _(spark, sf):
    k = F.col("s_suppkey")
    files = views.table(spark, sf, "supplier").select(
        F.concat(F.lit("dir/SUP"), (k % 37).cast("string"),
                 F.when(k % 3 == 0, "_minute_new").when(k % 3 == 1, "_minute").otherwise("_1min"), F.lit(".csv")).alias("path"),
        (k * 100 + 7).alias("length"))
    return src.label_files(files)


@query("universe_resolved", """
WITH have AS (SELECT DISTINCT 'P' || l_suppkey AS symbol FROM lineitem),
req AS (SELECT 'P' || (s_suppkey * 2) AS symbol FROM supplier),
al AS (SELECT 'P' || (s_suppkey * 2) AS symbol, 'P' || (s_suppkey - 1) AS alias FROM supplier WHERE s_suppkey % 5 = 0)
SELECT r.symbol, coalesce(h.symbol, h2.symbol) AS dataset_symbol,
  CASE WHEN h.symbol IS NOT NULL THEN 'exact' WHEN h2.symbol IS NOT NULL THEN 'alias'
       WHEN CAST(substr(r.symbol, 2) AS BIGINT) % 7 = 0 THEN 'known_unavailable' ELSE 'not_found' END AS resolution
FROM req r LEFT JOIN have h ON h.symbol = r.symbol LEFT JOIN al ON al.symbol = r.symbol LEFT JOIN have h2 ON h2.symbol = al.alias""")
def _(spark, sf):
    k = F.col("s_suppkey")
    sup = views.table(spark, sf, "supplier")
    have = views.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_suppkey")).alias("symbol")).distinct()
    req = sup.select(F.concat(F.lit("P"), k * 2).alias("symbol"))
    al = sup.where(k % 5 == 0).select(F.concat(F.lit("P"), k * 2).alias("symbol"), F.concat(F.lit("P"), k - 1).alias("alias"))
    gone = sup.where(k * 2 % 7 == 0).select(F.concat(F.lit("P"), k * 2).alias("symbol"))
    return universe.resolve_universe(req, have, al, gone)


def _labels(spark, sf):
    part = views.table(spark, sf, "part")
    old = part.where(F.col("p_partkey") % 2 == 0).select(
        F.concat("p_name", F.lit(" "), F.col("p_partkey") % 50).alias("label"), F.concat("p_brand", F.lit("-"), F.col("p_partkey") % 400).alias("symbol"),
        F.col("p_partkey").alias("position")).groupBy("label").agg(F.min_by("symbol", "position").alias("symbol"), F.min("position").alias("position"))
    new = part.where(F.col("p_partkey") % 3 == 0).select(
        F.concat("p_name", F.lit(" "), F.col("p_partkey") % 49).alias("label"), F.concat("p_brand", F.lit("-"), F.col("p_partkey") % 400).alias("symbol"),
        F.col("p_partkey").alias("position")).groupBy("label").agg(F.min_by("symbol", "position").alias("symbol"), F.min("position").alias("position"))
    return old, new


@query("universe_compared", """
WITH o AS (SELECT p_name || ' ' || (p_partkey % 50) AS label, first(p_brand || '-' || (p_partkey % 400) ORDER BY p_partkey) AS symbol, min(p_partkey) AS pos
  FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
n AS (SELECT p_name || ' ' || (p_partkey % 49) AS label, first(p_brand || '-' || (p_partkey % 400) ORDER BY p_partkey) AS symbol, min(p_partkey) AS pos
  FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
ex AS (SELECT o.label, o.symbol AS os, n.symbol AS ns FROM o JOIN n USING (label)),
fo AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS k FROM o WHERE label NOT IN (SELECT label FROM ex)),
fn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS k FROM n WHERE label NOT IN (SELECT label FROM ex)),
m AS (SELECT fo.label AS ol, fn.label AS nl, fo.symbol AS os, fn.symbol AS ns FROM fo FULL JOIN fn ON fo.symbol = fn.symbol AND fo.k = fn.k)
SELECT label AS old_label, label AS new_label, os AS old_symbol, ns AS new_symbol, 'exact' AS relationship FROM ex
UNION ALL SELECT coalesce(ol, ''), coalesce(nl, ''), coalesce(os, ''), coalesce(ns, ''),
  CASE WHEN ol IS NULL THEN 'modern_only' WHEN nl IS NULL THEN 'legacy_only' ELSE 'renamed_equivalent' END FROM m""")
def _(spark, sf):
    return universe.compare_universes(*_labels(spark, sf))


@query("provider_symbols", """
SELECT p_partkey, p_name || CASE WHEN p_partkey % 5 = 0 THEN '.X' WHEN p_partkey % 5 = 1 THEN '=Y' ELSE ' & (' || p_partkey || ')' END AS label,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN 'LIN-' || p_partkey WHEN p_partkey % 7 = 0 THEN 'REN-' || p_partkey
    WHEN p_partkey % 5 <= 1 THEN p_name || CASE WHEN p_partkey % 5 = 0 THEN '.X' ELSE '=Y' END
    ELSE p_name || ' & (' || p_partkey || ').NS' END AS provider_symbol,
  CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '_') || '_X' WHEN p_partkey % 5 = 1 THEN replace(p_name, ' ', '_') || '=Y'
    ELSE replace(p_name, ' ', '_') || '_AND_' || p_partkey END AS safe_name
FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    label = F.concat("p_name", F.when(k % 5 == 0, ".X").when(k % 5 == 1, "=Y").otherwise(F.concat(F.lit(" & ("), k, F.lit(")"))))
    labels = views.table(spark, sf, "part").select(k.alias("p_partkey"), label.alias("label"))
    keyed = labels.withColumn("name", F.col("label")).withColumn("label", F.col("p_partkey"))
    lineage = labels.where((k % 11 == 0) | (k % 13 == 0)).select(
        k.alias("label"), F.when(k % 11 == 0, "do_not_download").otherwise("download").alias("policy"),
        F.concat(F.lit("LIN-"), k).alias("candidate"))
    renames = labels.where(k % 7 == 0).select(k.alias("label"), F.concat(F.lit("REN-"), k).alias("symbol"))
    # Names repeat in this table, so registry rows are matched on name and key.
    names = keyed.select("p_partkey", "name")
    lineage = lineage.join(names, F.col("label") == F.col("p_partkey")).select("name", "p_partkey", "policy", "candidate")
    renames = renames.join(names, F.col("label") == F.col("p_partkey")).select("name", "p_partkey", "symbol")
    tagged = F.concat("name", F.lit("\u0001"), F.col("p_partkey"))
    out = universe.provider_symbols(
        names.select("p_partkey", "name", tagged.alias("label")),
        lineage.select(tagged.alias("label"), "policy", "candidate"), renames.select(tagged.alias("label"), "symbol"))
    symbol = F.regexp_replace("provider_symbol", "\u0001[0-9]+", "")
    return out.select("p_partkey", F.col("name").alias("label"), symbol.alias("provider_symbol"),
                      universe.safe_label(F.col("name")).alias("safe_name"))


def _nation_sector(industry):
    """Stand-in for the official collapse table: nations with an even number are mapped."""
    number = F.regexp_extract(industry, "([0-9]+)$", 1).try_cast("int")
    return F.when(number % 2 == 0, F.concat(F.lit("GROUP_"), (number / 10).cast("int").cast("string"))).otherwise(universe.UNKNOWN)


def _sectors(spark, sf):
    listed = views.sector_map(spark, sf).where(F.col("ticker").cast("int") % 9 != 0).select(
        F.col("ticker").alias("symbol"), "industry", F.lit(1).alias("seq"))
    # Every fifth symbol is listed again with another industry, before or after the first row.
    again = listed.where(F.col("symbol").cast("int") % 5 == 0).select(
        "symbol", F.lit("NATION_0").alias("industry"), F.when(F.col("symbol").cast("int") % 10 == 0, 0).otherwise(2).alias("seq"))
    official = listed.unionByName(again)
    tickers = views.bars(spark, sf).select("ticker").distinct()
    return universe.build_sectors(tickers, official, _nation_sector)


_SECT = """sect AS (SELECT t.ticker, coalesce(s.industry, 'UNKNOWN') AS industry, s.industry IS NOT NULL AS mapped,
  CASE WHEN s.industry IS NULL OR CAST(replace(s.industry, 'NATION_', '') AS INTEGER) % 2 = 1 THEN 'UNKNOWN'
    ELSE 'GROUP_' || (CAST(replace(s.industry, 'NATION_', '') AS INTEGER) // 10) END AS sector
  FROM (SELECT DISTINCT ticker FROM bars) t LEFT JOIN (SELECT ticker, CASE WHEN CAST(ticker AS INTEGER) % 10 = 0 THEN 'NATION_0' ELSE industry END AS industry FROM sectors
    WHERE CAST(ticker AS INTEGER) % 9 != 0) s ON s.ticker = t.ticker)"""


@query("sector_map", S.with_(S.BARS, S.SECTORS, _SECT) + "SELECT * FROM sect")
def _(spark, sf):
    return _sectors(spark, sf)


@query("sector_map_coverage", S.with_(S.BARS, S.SECTORS, _SECT) + f"""
SELECT count(*) AS n_tickers, count(*) FILTER (mapped) AS n_mapped, count(*) FILTER (NOT mapped) AS n_unmapped,
  count(*) FILTER (sector = 'UNKNOWN' AND industry != 'UNKNOWN') AS n_unknown_industry, {S.r6('avg(CAST(mapped AS INTEGER))')} AS coverage_fraction FROM sect""")
def _(spark, sf):
    return tidy(universe.sector_coverage(_sectors(spark, sf)))


@query("vocabulary", S.with_(S.SECTORS) + """
SELECT 'UNKNOWN' AS value, CAST(0 AS BIGINT) AS id UNION ALL
SELECT industry, row_number() OVER (ORDER BY industry) FROM (SELECT DISTINCT industry FROM sectors)""")
def _(spark, sf):
    return universe.vocabulary(views.sector_map(spark, sf), "industry")


def _candidates(spark, sf):
    return views.sector_map(spark, sf).select("ticker", "sector")


_ELIG = """elig0 AS (SELECT s.ticker, s.sector, min(t.origin_date) AS first_usable_sample,
  count(*) FILTER (t.origin_date <= DATE '1998-12-31' AND t.target_date <= DATE '1998-12-31') AS train_samples,
  count(*) FILTER (year(t.origin_date) = 1999) AS samples_1999, count(*) FILTER (year(t.origin_date) = 2000) AS samples_2000
  FROM sectors s LEFT JOIN targets t ON t.ticker = s.ticker GROUP BY 1, 2),
elig AS (SELECT *, CASE WHEN first_usable_sample IS NULL THEN 'no usable sample' ELSE concat_ws('; ',
  CASE WHEN train_samples < 300 THEN 'A/B: only ' || train_samples || ' usable TRAIN samples through 1998-12-31 (need 300)' END,
  CASE WHEN samples_1999 < 80 THEN 'C: only ' || samples_1999 || ' samples in 1999 (need 80)' END,
  CASE WHEN samples_2000 < 80 THEN 'D: only ' || samples_2000 || ' samples in 2000 (need 80)' END) END AS exclusion_reason FROM elig0)"""


@query("eligible_universe", S.with_(S.BARS, S.TARGETS_OWN, S.SECTORS, _ELIG) + "SELECT *, exclusion_reason = '' AS eligible FROM elig")
def _(spark, sf):
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own")
    return universe.eligibility(rows, _candidates(spark, sf), "1998-12-31", (1999, 2000), 300, 80)


@query("eligible_by_sector", S.with_(S.BARS, S.TARGETS_OWN, S.SECTORS, _ELIG) + """
SELECT sector, count(*) AS n_candidates, count(*) FILTER (exclusion_reason = '') AS n_eligible, count(*) FILTER (exclusion_reason != '') AS n_excluded
FROM elig GROUP BY 1""")
def _(spark, sf):
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own")
    return universe.cohort_summary(universe.eligibility(rows, _candidates(spark, sf), "1998-12-31", (1999, 2000), 300, 80))


@query("eligible_at_every_horizon", S.with_(*_HSAMPLES, S.SECTORS) + """,
ok AS (SELECT * FROM hjudged WHERE drop_reason IS NULL),
c AS (SELECT s.ticker, s.sector,
  count(*) FILTER (horizon = 10 AND origin_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND target_end_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31') AS train_reference,
  count(*) FILTER (horizon = 1) AS samples_1,
  least(count(*) FILTER (horizon = 1 AND year(origin_date) = 1998 AND year(target_end_date) = 1998), count(*) FILTER (horizon = 1 AND year(origin_date) = 1999 AND year(target_end_date) = 1999)) AS val_min_1,
  count(*) FILTER (horizon = 10) AS samples_10,
  least(count(*) FILTER (horizon = 10 AND year(origin_date) = 1998 AND year(target_end_date) = 1998), count(*) FILTER (horizon = 10 AND year(origin_date) = 1999 AND year(target_end_date) = 1999)) AS val_min_10
  FROM sectors s LEFT JOIN ok ON ok.ticker = s.ticker GROUP BY 1, 2),
r AS (SELECT *, concat_ws('; ', CASE WHEN samples_1 + samples_10 = 0 THEN 'no usable causal sample at any horizon (insufficient history)' END,
  CASE WHEN train_reference < 160 THEN 'only ' || train_reference || ' valid H=10 training samples (need 160)' END,
  CASE WHEN val_min_1 < 75 THEN 'only ' || val_min_1 || ' valid validation samples in the weakest development year at H=1 (need 75)' END,
  CASE WHEN val_min_10 < 75 THEN 'only ' || val_min_10 || ' valid validation samples in the weakest development year at H=10 (need 75)' END) AS exclusion_reason FROM c)
SELECT *, exclusion_reason = '' AS eligible FROM r""")
def _(spark, sf):
    rows = smp.usable(_hjudged(spark, sf))
    return universe.horizon_eligibility(rows, _candidates(spark, sf), ("1995-01-01", "1997-12-31"), (1998, 1999), (1, 10),
                                        10, 160, 75)


@query("ticker_fold_reach", S.with_(S.BARS) + """
SELECT ticker, max(date) AS last_stamp, f.fold, max(date) >= f.d AS available
FROM bars, (VALUES ('Y1998', DATE '1998-01-01'), ('Y1999', DATE '1999-01-01'), ('Y2000', DATE '2000-01-01')) f(fold, d) GROUP BY 1, 3, f.d""")
def _(spark, sf):
    from ..operators.quality import provenance
    return splits.fold_reach(provenance(views.bars(spark, sf)), FOLDS)


# ---- splits ----------------------------------------------------------------

def _split_counts(df):
    return df.groupBy("ticker", "split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"),
                                             F.max("date").alias("last_date"))


_SPLIT_AGG = "ticker, split, count(*) AS n, min(date) AS first_date, max(date) AS last_date"


@query("split_by_date", S.with_(S.BARS) + f"""
SELECT {_SPLIT_AGG} FROM (SELECT *, CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train'
  WHEN date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'val' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'test' END AS split
  FROM bars) WHERE split IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    fold = splits.Fold("all", ("1995-01-01", "1998-12-31"), ("1999-01-01", "1999-12-31"), ("2000-01-01", "2000-12-31"))
    return _split_counts(splits.split_by_date(views.bars(spark, sf), fold))


@query("split_by_span", S.with_(S.BARS) + f""",
s AS (SELECT min(date) AS lo, (max(date) - min(date)) * 0.85::DOUBLE AS edge FROM bars),
o AS (SELECT b.*, date - lo AS off, edge FROM bars b, s),
m AS (SELECT max(off) FILTER (off <= edge) * (1.0::DOUBLE - 0.10::DOUBLE) AS cut FROM o)
SELECT {_SPLIT_AGG} FROM (SELECT o.*, CASE WHEN off <= edge AND off < cut THEN 'train' WHEN off <= edge THEN 'val'
  WHEN off >= edge + 1 THEN 'test' END AS split FROM o, m) WHERE split IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return _split_counts(splits.split_by_span(views.bars(spark, sf)))


@query("split_by_position", S.with_(S.BARS) + f"""
SELECT {_SPLIT_AGG} FROM (SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars)) GROUP BY 1, 2""")
def _(spark, sf):
    return _split_counts(splits.split_by_position(views.bars(spark, sf)))


@query("yearly_folds", S.with_(S.BARS) + """,
s AS (SELECT min(date) AS lo, max(date) AS hi FROM bars),
y AS (SELECT unnest(range(1998, 2010)) AS y)
SELECT y - 1998 AS fold, DATE '1995-01-15' AS train_start, make_date(y - 1, 12, 31) AS train_end, make_date(y, 1, 1) AS val_start, make_date(y, 12, 31) AS val_end,
  make_date(y + 1, 1, 1) AS test_start, make_date(y + 1, 12, 31) AS test_end, DATE '1995-01-15' >= lo AND make_date(y + 1, 12, 31) <= hi AS available,
  CASE WHEN DATE '1995-01-15' < lo THEN 'Data starts ' || lo || ', after required train start 1995-01-15'
    WHEN make_date(y + 1, 12, 31) > hi THEN 'Data ends ' || hi || ', before required test end ' || make_date(y + 1, 12, 31) END AS reason
FROM y, s WHERE make_date(y, 12, 31) < hi""")
def _(spark, sf):
    return splits.yearly_folds(views.bars(spark, sf), train_start="1995-01-15", first_val=1998)


_DECLARED = {"search": splits.SEARCH_FOLDS, "paper": splits.PAPER_FOLDS, "dev": splits.DEV_FOLDS, "multi_horizon": splits.MULTI_HORIZON_FOLDS}
_WINDOWS = ", ".join(f"('{k}', '{f.name}', '{n}', DATE '{w[0]}', DATE '{w[1]}')" for k, fs in _DECLARED.items() for f in fs for n, w in f.windows())


@query("declared_fold_counts", S.with_(S.BARS, S.TARGETS_OWN) + f""",
w AS (SELECT * FROM (VALUES {_WINDOWS}) t(fold_set, fold, split, lo, hi)),
m AS (SELECT ticker, CAST(origin_date + INTERVAL 20 YEAR AS DATE) AS o, CAST(target_date + INTERVAL 20 YEAR AS DATE) AS t FROM targets)
SELECT fold_set, fold, split, count(*) AS n, count(DISTINCT ticker) AS n_tickers, min(o) AS first_origin, max(t) AS last_target FROM m JOIN w ON o BETWEEN lo AND hi AND t BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Samples of every declared fold set; the bars are twenty years older than the folds."""
    later = [F.add_months(c, 240).alias(c) for c in ("origin_date", "target_date")]
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own").select("ticker", *later)
    placed = [splits.assign_folds(rows, folds).withColumn("fold_set", F.lit(k)) for k, folds in _DECLARED.items()]
    return reduce(lambda a, b: a.unionByName(b), placed).groupBy("fold_set", "fold", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("n_tickers"), F.min("origin_date").alias("first_origin"),
        F.max("target_date").alias("last_target"))


@query("index_folds", S.with_(S.BARS) + """,
n AS (SELECT ticker, count(*) AS n FROM bars GROUP BY 1),
e AS (SELECT ticker, unnest(range(252, n - 21 + 1, 21)) AS e FROM n WHERE n >= 273)
SELECT ticker, (e - 252) // 21 AS fold, CAST(0 AS BIGINT) AS train_start, e AS train_end, e AS test_start, e + 21 AS test_end FROM e""")
def _(spark, sf):
    return tidy(splits.index_folds(views.bars(spark, sf)))


@query("fold_boundary_report", S.with_(S.BARS, S.TARGETS_OWN, FOLDS_SQL) + """
SELECT fold, split, count(*) AS n_samples, count(DISTINCT ticker) AS n_tickers, max(origin_date) AS max_origin, max(target_date) AS max_target
FROM targets JOIN folds ON origin_date BETWEEN lo AND hi AND target_date BETWEEN lo AND hi GROUP BY 1, 2""")
def _(spark, sf):
    return splits.boundary_report(targets.next_day_targets(views.bars(spark, sf), calendar="own"), FOLDS)


@query("common_origin_splits", S.with_(S.BARS, S.horizon_targets(), FOLDS_SQL) + """,
p AS (SELECT h.*, fold, split FROM htargets h JOIN folds ON origin_date BETWEEN lo AND hi AND target_end_date BETWEEN lo AND hi),
k AS (SELECT fold, split, ticker, origin_date FROM p GROUP BY ALL HAVING count(DISTINCT horizon) = 4)
SELECT fold, split, CAST(horizon AS BIGINT) AS horizon, count(*) AS n FROM p JOIN k USING (fold, split, ticker, origin_date) GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = targets.horizon_targets(views.bars(spark, sf)).withColumnRenamed("target_end_date", "target_date")
    out = splits.common_in_folds(rows, FOLDS, targets.HORIZONS)
    return tidy(out.groupBy("fold", "split", "horizon").agg(F.count(F.lit(1)).alias("n")))


@query("chronological_dates", S.with_(S.BARS) + """,
d AS (SELECT DISTINCT date FROM bars WHERE date < DATE '2000-01-01')
SELECT date, CASE WHEN row_number() OVER (ORDER BY date) <= greatest(1, least(count(*) OVER () - 1, CAST(round_even(count(*) OVER () * 0.85::DOUBLE, 0) AS BIGINT))) THEN 'train' ELSE 'val' END AS split FROM d""")
def _(spark, sf):
    return splits.chronological_dates(views.bars(spark, sf), "2000-01-01")


@query("same_day_probe", S.with_(S.BARS) + """
SELECT ticker, date AS origin_date, CAST(close > p AS BIGINT) AS y FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars) WHERE p IS NOT NULL""")
def _(spark, sf):
    return tidy(splits.same_day_label(views.bars(spark, sf)))


@query("random_split_probe", S.with_(S.BARS, S.TARGETS_OWN) + """
SELECT ticker, CASE WHEN CAST('0x' || substr(md5('42|' || ticker || '|' || origin_date), 1, 8) AS BIGINT) / 4294967296.0 < 0.85 THEN 'train' ELSE 'val' END AS split, count(*) AS n
FROM targets GROUP BY 1, 2""")
def _(spark, sf):
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own")
    return splits.random_split(rows).groupBy("ticker", "split").agg(F.count(F.lit(1)).alias("n"))


# ---- scalers ---------------------------------------------------------------

_SC = ["log_return_5", "realized_vol_20", "drawdown_20"]


def _train_rows(spark, sf):
    bars = views.bars(spark, sf)
    rows = targets.next_day_targets(bars, calendar="own").where(F.col("target_date") <= F.lit("1998-12-31").cast("date"))
    return smp.origin_snapshot(rows.select("ticker", "origin_date"), pf.panel_features(bars, _SC), _SC)


_TRAIN = f"""train AS (SELECT f.* FROM targets t JOIN feats f ON f.ticker = t.ticker AND f.date = t.origin_date WHERE target_date <= DATE '1998-12-31'),
long AS ({' UNION ALL '.join(f"SELECT ticker, '{c}' AS feature, {c} AS v FROM train WHERE {c} IS NOT NULL" for c in _SC)})"""
_SCALER_CTES = [*S.features(_SC), S.TARGETS_OWN, _TRAIN]


def _scaler_sql(center: str, scale: str, by: str = "ticker, ") -> str:
    return f"""SELECT {by}feature, {S.r6(center)} AS center, {S.r6(f'CASE WHEN coalesce({scale}, 0) = 0 THEN 1 ELSE {scale} END')} AS scale
FROM long GROUP BY {by}feature"""


@query("scaler_standard", S.with_(*_SCALER_CTES) + _scaler_sql("avg(v)", "stddev_pop(v)"))
def _(spark, sf):
    return tidy(scaling.fit_scaler(_train_rows(spark, sf), _SC, "standard", ("ticker",)))


@query("scaler_minmax", S.with_(*_SCALER_CTES) + _scaler_sql("min(v)", "(max(v) - min(v))"))
def _(spark, sf):
    return tidy(scaling.fit_scaler(_train_rows(spark, sf), _SC, "minmax", ("ticker",)))


@query("scaler_robust", S.with_(*_SCALER_CTES) + _scaler_sql("median(v)", "(quantile_cont(v, 0.75) - quantile_cont(v, 0.25))"))
def _(spark, sf):
    return tidy(scaling.fit_scaler(_train_rows(spark, sf), _SC, "robust", ("ticker",)))


@query("scaler_panel", S.with_(*_SCALER_CTES) + _scaler_sql("avg(v)", "stddev_pop(v)", "") )
def _(spark, sf):
    train = _train_rows(spark, sf).withColumn("rank_x", F.lit(0.5))
    return tidy(scaling.fit_panel_scaler(train, [*_SC, "rank_x"], ("rank_x",)))


_ENDING = [c.replace("bars AS (", "bars AS MATERIALIZED (", 1).replace("steps AS (", "steps AS MATERIALIZED (", 1).replace("feats AS (", "feats AS MATERIALIZED (", 1)
           for c in [*S.features(_SC), S.TARGETS_OWN]]


@query("scaled_panel", S.with_(*_ENDING) + f""",
last_origin AS MATERIALIZED (SELECT ticker, origin_date FROM targets WHERE target_date <= DATE '1998-12-31'),
p AS MATERIALIZED (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SC)} FROM feats f JOIN last_origin o ON o.ticker = f.ticker AND o.origin_date = f.date)
SELECT ticker, date, {', '.join(f"{S.r6(f'({c} - (SELECT m_{c} FROM p)) / (SELECT s_{c} FROM p)')} AS {c}" for c in _SC)} FROM feats""")
def _(spark, sf):
    params = scaling.fit_panel_scaler(_train_rows(spark, sf), _SC)
    return tidy(scaling.apply_scaler(pf.panel_features(views.bars(spark, sf), _SC), params, _SC))


@query("scaler_leak_probe", S.with_(*S.features(_SC), S.TARGETS_OWN) + f""",
o AS (SELECT f.*, target_date <= DATE '1998-12-31' AS tr FROM targets t JOIN feats f ON f.ticker = t.ticker AND f.date = t.origin_date WHERE target_date <= DATE '1998-12-31' OR (origin_date >= DATE '1999-01-01' AND target_date <= DATE '1999-12-31')),
lo AS ({' UNION ALL '.join(f"SELECT tr, '{c}' AS feature, {c} AS v FROM o WHERE {c} IS NOT NULL" for c in _SC)})
SELECT feature, {S.r6('avg(v) FILTER (tr)')} AS train_center, {S.r6('avg(v)')} AS leaky_center, {S.r6('stddev_pop(v) FILTER (tr)')} AS train_scale, {S.r6('stddev_pop(v)')} AS leaky_scale,
  {S.r6('(avg(v) - avg(v) FILTER (tr)) / stddev_pop(v) FILTER (tr)')} AS shift FROM lo GROUP BY 1""")
def _(spark, sf):
    bars = views.bars(spark, sf)
    rows = targets.next_day_targets(bars, calendar="own").select("ticker", "origin_date", "target_date")
    placed = splits.assign_folds(rows, [splits.Fold("P", ("1900-01-01", "1998-12-31"), ("1999-01-01", "1999-12-31"))])
    return tidy(scaling.leak_probe(smp.origin_snapshot(placed, pf.panel_features(bars, _SC), _SC), _SC))


_WTRAIN = f"""wf AS (SELECT ticker, date, volume AS v, lead(date) OVER w AS target_date, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
wt AS (SELECT *, coalesce(sum(CAST(coalesce(i >= {_LEN - 1} AND target_date <= DATE '1998-12-31', false) AS INTEGER)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND {_LEN - 1} FOLLOWING), 0) AS wgt FROM wf)"""


def _weighted(spark, sf):
    bars = views.bars(spark, sf).withColumn("target_date", targets.ahead(F.col("date")))
    flagged = smp.add_window_flags(bars, ["volume"], _LEN)
    is_train = F.coalesce(F.col("window_ok") & (F.col("target_date") <= F.lit("1998-12-31").cast("date")), F.lit(False))
    return scaling.window_weights(flagged, is_train, _LEN)


@query("scaler_window_weighted", S.with_(S.BARS, _WTRAIN) + f""",
m AS (SELECT ticker, sum(wgt * v) / sum(wgt) AS mean FROM wt GROUP BY 1 HAVING sum(wgt) > 0)
SELECT ticker, 'volume' AS feature, {S.r6('any_value(mean)')} AS center, {S.r6('sqrt(sum(wgt * (v - mean) * (v - mean)) / sum(wgt))')} AS scale
FROM wt JOIN m USING (ticker) GROUP BY 1""")
def _(spark, sf):
    return tidy(scaling.fit_scaler(_weighted(spark, sf), ["volume"], "standard", ("ticker",), "window_weight"))


@query("scaler_window_weighted_robust", S.with_(S.BARS, _WTRAIN) + f""",
r AS (SELECT ticker, v, unnest(range(CAST(wgt AS BIGINT))) AS k FROM wt WHERE wgt > 0)
SELECT ticker, 'volume' AS feature, {S.r6('median(v)')} AS center,
  {S.r6('CASE WHEN quantile_cont(v, 0.75) = quantile_cont(v, 0.25) THEN 1 ELSE quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END')} AS scale FROM r GROUP BY 1""")
def _(spark, sf):
    return tidy(scaling.fit_scaler(_weighted(spark, sf), ["volume"], "robust", ("ticker",), "window_weight"))
