"""Normalisers, quality predicates and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel_features as pf
from ..operators import quality as q
from ..operators import splits, targets
from ..plans import views
from ..sources import bars as src
from ..sources import events as ev
from . import sql as S
from .registry import query
from .tidy import tidy

OHLC = ("open", "high", "low", "close")
_BAR_COLS = ", ".join(f"{S.px(c)} AS {c}" for c in OHLC) + f", {S.r6('volume')} AS volume"


def _dedupe(order: str) -> str:
    return f"(SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq {order}) = 1)"


@query("bars_first_per_day", S.with_(S.QUOTES) + f"SELECT ticker, date, {_BAR_COLS} FROM {_dedupe('')}")
def _(spark, sf):
    return tidy(src.normalize_daily(views.quotes(spark, sf), "seq"), prices=OHLC)


@query("bars_last_per_day", S.with_(S.QUOTES) + f"SELECT ticker, date, {_BAR_COLS} FROM {_dedupe('DESC')} WHERE close > 0")
def _(spark, sf):
    raw = views.quotes(spark, sf).withColumnRenamed("Vol", "Volume")
    return tidy(src.normalize_panel(raw, "seq"), prices=OHLC)


@query("vendor_canonical", S.with_(S.QUOTES) + f"SELECT ticker, date, {_BAR_COLS} FROM {_dedupe('')}")
def _(spark, sf):
    raw = views.quotes(spark, sf).withColumnRenamed("Vol", "Volume")
    raw = raw.withColumns({"Adj Close": F.col("Close") * 0.5, "Dividends": F.lit(0.0)})
    return tidy(src.canonicalize_vendor(raw, "seq"), prices=OHLC)


@query("external_normalized", S.with_(S.EXT) + f"""
SELECT source_id, source_date, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low,
  {S.px('close')} AS close, volume FROM ext""")
def _(spark, sf):
    raw = views.ext_series(spark, sf).withColumnRenamed("source_date", "Date")
    return tidy(src.normalize_external(raw), prices=("close",))


def _rule_sql() -> str:
    ok = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"
    out = []
    for name, a, b, rel in q.OHLC_RULES:
        breach = f"{ok} AND {a} {'<' if rel == 'ge' else '>'} {b}"
        near = f"abs({a} - {b}) <= 1e-9 + 1e-9 * abs({b})"
        out += [f"count(*) FILTER ({breach} AND NOT ({near})) AS {name}_hard",
                f"count(*) FILTER ({breach} AND {near}) AS {name}_cleared",
                f"{S.px(f'coalesce(max(abs({a} - {b})) FILTER ({breach}), 0)')} AS {name}_worst"]
    return ", ".join(out)


_HARD = " + ".join(f"{r[0]}_hard" for r in q.OHLC_RULES)
_CLEARED = " + ".join(f"{r[0]}_cleared" for r in q.OHLC_RULES)
_WORST = tuple(f"{r[0]}_worst" for r in q.OHLC_RULES)


def _quote_rows(spark, sf):
    return src.typed_bars(src.resolve_headers(views.quotes(spark, sf)), "seq")


@query("ohlc_violations", S.with_(S.QUOTES) + f"""
SELECT *, {_HARD} AS total_hard, {_CLEARED} AS total_cleared FROM (SELECT ticker, {_rule_sql()} FROM quotes GROUP BY ticker)""")
def _(spark, sf):
    return tidy(q.ohlc_violations(_quote_rows(spark, sf)), prices=_WORST)


_ISSUE_SQL = ", ".join(f"CASE WHEN {r[0]}_hard > 0 THEN '{r[0]}:' || {r[0]}_hard END" for r in q.OHLC_RULES)


@query("frame_issues", S.with_(S.QUOTES) + f""",
lagged AS (SELECT ticker, date, max(date) OVER (PARTITION BY ticker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pd FROM quotes),
ord AS (SELECT ticker, count(*) FILTER (pd > date) AS backward FROM lagged GROUP BY 1),
stats AS (SELECT ticker, min(date) AS lo, max(date) AS hi, count(*) - count(DISTINCT date) AS dups,
  count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS nulls,
  count(*) FILTER (volume < 0) AS neg, {_rule_sql()} FROM quotes GROUP BY ticker)
SELECT ticker, concat_ws(';', CASE WHEN backward > 0 THEN 'date_not_monotonic' END, CASE WHEN dups > 0 THEN 'duplicate_dates' END,
  CASE WHEN lo < DATE '1995-01-10' THEN 'date_before_start:' || lo END,
  CASE WHEN hi >= DATE '2001-11-01' THEN 'date_on_or_after_end:' || hi END,
  CASE WHEN nulls > 0 THEN 'nulls' END, CASE WHEN neg > 0 THEN 'negative_volume' END, {_ISSUE_SQL}) AS issues
FROM stats JOIN ord USING (ticker)""")
def _(spark, sf):
    out = q.frame_issues(_quote_rows(spark, sf), "seq", start="1995-01-10", end="2001-11-01")
    return out.withColumn("issues", F.array_join("issues", ";"))


_BAD = " OR ".join(f"{a} {'<' if rel == 'ge' else '>'} {b}" for _, a, b, rel in q.OHLC_RULES)
_ALLP = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"


@query("strict_quality", S.with_(S.QUOTES) + f"""
SELECT ticker, count(*) FILTER (({_BAD}) AND {_ALLP}) AS inconsistent_rows,
  min(date) FILTER (({_BAD}) AND {_ALLP}) AS inconsistent_first, max(date) FILTER (({_BAD}) AND {_ALLP}) AS inconsistent_last,
  count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive_rows,
  min(date) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive_first,
  max(date) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive_last,
  count(*) FILTER (volume = 0) AS zero_volume_rows FROM quotes GROUP BY ticker""")
def _(spark, sf):
    return q.strict_quality(_quote_rows(spark, sf))


@query("price_jumps", S.with_(S.BARS) + f"""
SELECT ticker, date, {S.px('close')} AS close, volume, {S.r6('ret')} AS "return", {S.r6('abs(ret)')} AS abs_return
FROM (SELECT *, close / {S.lagged('close')} - 1 AS ret FROM bars) WHERE abs(ret) > 0.25""")
def _(spark, sf):
    return tidy(q.price_jumps(views.bars(spark, sf)), prices=("close",))


def _variants(spark, sf):
    bars = views.bars(spark, sf).select("ticker", "date")
    return bars.withColumn("variant", F.lit("adjusted")).unionByName(
        bars.where(F.year("date") >= 1997).withColumn("variant", F.lit("unadjusted")))


def _requested(spark, sf):
    names = views.table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).cast("string").alias("ticker"))
    return names.select("ticker", F.explode(F.array(F.lit("adjusted"), F.lit("unadjusted"))).alias("variant"))


COVERAGE = """variants AS (
  SELECT ticker, date, 'adjusted' AS variant FROM bars UNION ALL
  SELECT ticker, date, 'unadjusted' FROM bars WHERE year(date) >= 1997),
req AS (SELECT CAST(s_suppkey * 2 AS VARCHAR) AS ticker, v.variant FROM supplier, (VALUES ('adjusted'), ('unadjusted')) v(variant)),
cov AS (SELECT r.ticker, r.variant, count(v.date) AS rows, min(v.date) AS first_date, max(v.date) AS last_date,
  CASE WHEN count(v.date) > 0 THEN 'complete' ELSE 'unavailable' END AS status,
  coalesce(min(v.date) > DATE '1995-02-01', false) AS late_start
  FROM req r LEFT JOIN variants v ON v.ticker = r.ticker AND v.variant = r.variant GROUP BY 1, 2)"""


@query("coverage_table", S.with_(S.BARS, COVERAGE) + "SELECT * FROM cov")
def _(spark, sf):
    return q.coverage(_variants(spark, sf), _requested(spark, sf), "1995-02-01")


@query("coverage_summary", S.with_(S.BARS, COVERAGE) + """
SELECT variant, count(*) AS requested, count(*) FILTER (status = 'complete') AS complete,
  CAST(sum(rows) AS BIGINT) AS total_rows, min(first_date) AS earliest_date, max(last_date) AS latest_date,
  count(*) FILTER (late_start) AS late_starters FROM cov GROUP BY 1""")
def _(spark, sf):
    return q.coverage_summary(q.coverage(_variants(spark, sf), _requested(spark, sf), "1995-02-01"))


_GATE_YEARS = range(1996, 2001)
_NY = ", ".join(f"count(*) FILTER (year(source_date) = {y}) AS n_{y}" for y in _GATE_YEARS)
_BEST = "greatest(" + ", ".join(f"n_{y}" for y in _GATE_YEARS) + ")"
_GATE_REASONS = ", ".join(
    f"CASE WHEN n_{y} < 240 THEN '{y} has only ' || n_{y} || ' observations (floor 240)' "
    f"WHEN 1 - n_{y} / best > 0.05 THEN '{y} density ' || n_{y} || ' is ' || printf('%.3f', 1 - n_{y} / best) || "
    f"' below this source''s best development year (' || CAST(best AS BIGINT) || ')' END" for y in _GATE_YEARS)
_GATE_MISSING = "greatest(" + ", ".join(f"CASE WHEN n_{y} < 240 THEN 1.0 ELSE 1 - n_{y} / best END" for y in _GATE_YEARS) + ")"


@query("source_coverage_gate", S.with_(S.EXT) + f""",
g AS (SELECT *, source_date - lag(source_date) OVER (PARTITION BY source_id ORDER BY source_date) AS gap FROM ext),
s AS (SELECT source_id, count(*) AS n_observations, min(source_date) AS first_date, max(source_date) AS last_date,
  count(*) FILTER (gap > 5) AS long_gaps, {_NY} FROM g GROUP BY 1),
b AS (SELECT *, CAST({_BEST} AS DOUBLE) AS best FROM s),
r AS (SELECT *, concat_ws('; ', CASE WHEN last_date < DATE '2000-12-31' THEN 'coverage ends ' || last_date || ', before the development window' END,
  {_GATE_REASONS}, CASE WHEN long_gaps > 0 THEN long_gaps || ' unexplained gap(s) longer than 5 calendar days' END) AS reason FROM b)
SELECT source_id, reason = '' AS passed, reason, n_observations, first_date, last_date, {', '.join(f'n_{y}' for y in _GATE_YEARS)},
  CAST(best AS BIGINT) AS best_year_count, {S.r6(_GATE_MISSING)} AS max_missing_fraction, long_gaps FROM r""")
def _(spark, sf):
    out = q.source_coverage_gate(views.ext_series(spark, sf), 1996, 2000, floor=240, max_gap_days=5)
    return tidy(out)


@query("boundary_violations", S.with_(S.BARS, S.TARGETS_OWN) + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} > DATE '2000-12-31') AS past_boundary, "
    f"count(*) FILTER ({c} BETWEEN DATE '1999-01-01' AND DATE '1999-12-31') AS in_sealed_span, max({c}) AS max_date FROM targets"
    for c in ("origin_date", "target_date")))
def _(spark, sf):
    rows = targets.next_day_targets(views.bars(spark, sf), calendar="own")
    return q.boundary_violations(rows, ["origin_date", "target_date"], "2000-12-31", ("1999-01-01", "1999-12-31"))


@query("source_integrity", """
WITH d AS (SELECT o_orderpriority AS source_id, CAST(o_orderdate AS DATE) AS source_date, count(*) AS n, max(o_totalprice) AS close
  FROM orders GROUP BY 1, 2),
m AS (SELECT *, abs(ln(close) - ln(lag(close) OVER (PARTITION BY source_id ORDER BY source_date))) AS move FROM d)
SELECT source_id, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_dates, count(*) FILTER (move > 0.35) AS suspicious_jumps
FROM m GROUP BY 1""")
def _(spark, sf):
    rows = views.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("source_id"), F.to_date("o_orderdate").alias("source_date"),
        F.col("o_totalprice").alias("close"))
    return q.source_integrity(rows)


_DEG = ["log_return_1", "drawdown_60", "close_location", "volume_z_20"]


@query("degenerate_columns", S.with_(*S.features(_DEG)) + " UNION ALL ".join(
    f"""SELECT *, reason IS NOT NULL AS dropped FROM (SELECT count(*) AS n_rows, '{n}' AS "column", count({e}) AS n_present,
  {S.r6(f'stddev_samp({e})')} AS spread, CASE WHEN count({e}) = 0 THEN 'all_null'
  WHEN count({e}) < greatest(floor(0.95 * count(*)), 1) THEN 'too_sparse' WHEN coalesce(stddev_samp({e}), 0) = 0 THEN 'constant' END AS reason
  FROM feats)""" for n, e in [*[(c, c) for c in _DEG], ("flat", "CAST(1 AS DOUBLE)")]))
def _(spark, sf):
    feats = pf.panel_features(views.bars(spark, sf), _DEG).withColumn("flat", F.lit(1.0))
    return tidy(q.degenerate_columns(feats, [*_DEG, "flat"], 0.95))


@query("finite_rows", S.with_(*S.features(_DEG)) + f"""
SELECT ticker, count(*) AS n_rows, count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in _DEG)}) AS finite_rows
FROM feats GROUP BY 1""")
def _(spark, sf):
    feats = pf.panel_features(views.bars(spark, sf), _DEG)
    return feats.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(q.finite_rows(_DEG)).alias(
        "finite_rows"))


@query("target_alignment_audit", S.with_(S.BARS, S.TARGETS_OWN) + """
SELECT ticker, count(*) AS n_checked, CAST(0 AS BIGINT) AS date_mismatches, CAST(0 AS BIGINT) AS label_mismatches
FROM targets GROUP BY 1""")
def _(spark, sf):
    bars = views.bars(spark, sf)
    return targets.alignment_audit(bars, targets.next_day_targets(bars, calendar="own"))


UNION_TARGETS = """cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM bars)),
utargets AS (SELECT b.ticker, b.date AS origin_date, n.date AS target_date, b.close AS close_t, n.close AS close_next,
  ln(n.close / b.close) AS raw_next_return, CAST(n.close > b.close AS INTEGER) AS y_direction
  FROM bars b JOIN cal c ON c.date = b.date JOIN bars n ON n.ticker = b.ticker AND n.date = c.nd)"""


@query("control_identity", S.with_(S.BARS, UNION_TARGETS, S.horizon_targets((1, 3))) + """
SELECT count(*) AS n_shared, count(*) FILTER (h.y != u.y_direction) AS label_mismatches,
  count(*) FILTER (h.target_end_date != u.target_date) AS date_mismatches,
  count(*) FILTER (abs(h.future_log_return - u.raw_next_return) > 1e-12) AS return_mismatches
FROM htargets h JOIN utargets u ON u.ticker = h.ticker AND u.origin_date = h.origin_date WHERE h.horizon = 1""")
def _(spark, sf):
    bars = views.bars(spark, sf)
    return targets.control_mismatches(targets.horizon_targets(bars, (1, 3)), targets.next_day_targets(bars))


def _second_vendor(spark, sf):
    """The same days seen by another vendor: plain averages, and only line items with tax."""
    return views.ticks(spark, sf).where(F.col("seq.l_tax") > 0).groupBy("ticker", "date").agg(
        F.avg("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max("price").alias("close"), F.sum("volume").alias("volume"))


@query("vendor_comparison", S.with_(S.BARS) + f""",
v AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS close,
  sum(l_quantity) AS volume FROM lineitem WHERE l_tax > 0 GROUP BY 1, 2)
SELECT b.ticker, count(*) AS overlapping_days, {S.px('max(abs(b.close - v.close))')} AS max_abs_close_diff,
  {S.px('avg(abs(b.close - v.close))')} AS mean_abs_close_diff, {S.r6('max(abs(b.close - v.close) / v.close) * 100')} AS max_rel_close_diff_pct,
  {S.r6('avg(abs(b.close - v.close) / v.close) * 100')} AS mean_rel_close_diff_pct,
  {S.px('max(abs(b.open - v.open)) + max(abs(b.high - v.high)) + max(abs(b.low - v.low)) + max(abs(b.close - v.close))')} AS max_abs_diff_across_ohlc,
  {S.r6('avg(CAST(b.volume = v.volume AS INTEGER)) * 100')} AS volume_exact_match_pct
FROM bars b JOIN v ON v.ticker = b.ticker AND v.date = b.date GROUP BY 1""")
def _(spark, sf):
    out = q.vendor_comparison(views.bars(spark, sf), _second_vendor(spark, sf))
    return tidy(out, prices=("max_abs_close_diff", "mean_abs_close_diff", "max_abs_diff_across_ohlc"))


@query("adjustment_comparison", S.with_(S.BARS) + f""",
u AS (SELECT ticker, date, close * CASE WHEN date >= DATE '1998-07-01' THEN 2 ELSE 1 END AS close FROM bars WHERE year(date) >= 1996),
j AS (SELECT b.ticker, b.date, b.close AS a, u.close AS u, b.close / lag(b.close) OVER w - 1 AS ra, u.close / lag(u.close) OVER w - 1 AS ru
  FROM bars b JOIN u ON u.ticker = b.ticker AND u.date = b.date WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date)),
jj AS (SELECT ticker, count(*) FILTER (abs(ru) > 0.25) AS split_like_jumps, CASE WHEN count(*) > 3 THEN corr(ra, ru) END AS return_correlation,
  max(abs(a - u)) AS max_abs_close_diff FROM j GROUP BY 1),
sa AS (SELECT ticker, count(*) AS adjusted_rows, min(date) AS adjusted_first, max(date) AS adjusted_last FROM bars GROUP BY 1),
su AS (SELECT ticker, count(*) AS unadjusted_rows, min(date) AS unadjusted_first, max(date) AS unadjusted_last FROM u GROUP BY 1)
SELECT sa.*, su.* EXCLUDE (ticker), split_like_jumps, {S.r6('return_correlation')} AS return_correlation,
  {S.px('max_abs_close_diff')} AS max_abs_close_diff, adjusted_rows = unadjusted_rows AS row_counts_equal
FROM sa JOIN su USING (ticker) LEFT JOIN jj USING (ticker)""")
def _(spark, sf):
    bars = views.bars(spark, sf)
    factor = F.when(F.col("date") >= F.lit("1998-07-01").cast("date"), 2.0).otherwise(1.0)
    other = bars.where(F.year("date") >= 1996).withColumn("close", F.col("close") * factor)
    return tidy(q.adjustment_comparison(bars, other), prices=("max_abs_close_diff",))


@query("access_audit", S.with_(S.BARS, S.TARGETS_OWN) + """
SELECT (SELECT count(*) FROM targets WHERE target_date <= DATE '2000-06-30') AS n_samples,
  (SELECT max(origin_date) FROM targets WHERE target_date <= DATE '2000-06-30') AS max_origin_date,
  (SELECT max(target_date) FROM targets WHERE target_date <= DATE '2000-06-30') AS max_target_date,
  (SELECT max(date) FROM bars) AS max_source_date, (SELECT count(*) FROM bars WHERE date > DATE '2000-06-30') AS source_rows_past_boundary,
  true AS clean""")
def _(spark, sf):
    bars = views.bars(spark, sf)
    return q.access_audit(targets.next_day_targets(bars, calendar="own", max_date="2000-06-30"), bars, "2000-06-30")


FOLDS = splits.anchored_folds("Y", "1995-01-01", range(1998, 2001))
FOLDS_SQL = "folds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{f.name}', '{s}', DATE '{w[0]}', DATE '{w[1]}')" for f in FOLDS for s, w in f.windows()) + ") t(fold, split, lo, hi))"


@query("fold_coverage", S.with_(S.BARS, FOLDS_SQL) + """
SELECT fold, split, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS actual_start, max(date) AS actual_end,
  count(*) >= any_value(hi - lo + 1) AS available FROM bars JOIN folds ON date BETWEEN lo AND hi GROUP BY 1, 2""")
def _(spark, sf):
    return splits.fold_coverage(views.bars(spark, sf), FOLDS)


@query("fold_years", S.with_(S.BARS, FOLDS_SQL) + """
SELECT fold, split, year(date) AS year, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers
FROM bars JOIN folds ON date BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def _(spark, sf):
    return tidy(splits.fold_years(views.bars(spark, sf), FOLDS))


@query("dataset_profile", """
WITH g AS (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT event_type, count(*) AS n_rows, min(ts) AS first_stamp, max(ts) AS last_stamp,
  count(*) FILTER (user_id IS NULL) AS nulls_user_id, count(*) FILTER (value IS NULL) AS nulls_value,
  count(*) FILTER (ts IS NULL) AS nulls_ts, median(gap) AS m FROM g GROUP BY 1)
SELECT event_type, n_rows, first_stamp, last_stamp, nulls_user_id, nulls_value, nulls_ts, round(m, 3) + 0.0 AS median_gap_seconds,
  CASE WHEN m <= 60 THEN '1-minute' WHEN m <= 300 THEN '5-minute' WHEN m <= 900 THEN '15-minute' WHEN m <= 1800 THEN '30-minute'
    WHEN m <= 3600 THEN 'hourly' WHEN m <= 86400 THEN 'daily' ELSE 'other' END AS frequency FROM s""")
def _(spark, sf):
    ev_rows = views.table(spark, sf, "events").select("event_type", "ts", "user_id", "value")
    return tidy(q.dataset_profile(ev_rows, ["event_type"], "ts"), 3)


@query("provenance_spans", S.with_(S.BARS) + """
SELECT ticker, min(date) AS first_stamp, max(date) AS last_stamp, count(*) AS rows FROM bars GROUP BY 1""")
def _(spark, sf):
    return q.provenance(views.bars(spark, sf))


@query("provenance_summary", S.with_(S.BARS) + """
SELECT count(DISTINCT ticker) AS n_tickers, min(date) AS earliest, max(date) AS latest, count(*) AS total_rows FROM bars""")
def _(spark, sf):
    return q.provenance_summary(q.provenance(views.bars(spark, sf)))


@query("event_row_widths", """
WITH r AS (SELECT o_orderpriority AS archive, 7 + CAST(o_totalprice > 100000 AS INTEGER) AS width FROM orders)
SELECT archive, count(*) FILTER (width = 8) AS kept, count(*) FILTER (width != 8) AS ragged FROM r GROUP BY 1""")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    fields = [F.col(c).cast("string") for c in o.columns]
    extra = F.when(F.col("o_totalprice") > 100000, "x")
    lines = o.select(F.concat_ws("\t", *fields, F.lit(""), extra).alias("value"), F.col("o_orderpriority").alias("archive"))
    return ev.row_counts(ev.split_rows(lines, 8), ("archive",))
