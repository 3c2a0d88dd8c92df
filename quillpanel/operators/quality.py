"""Data-quality predicates and audits.  Every audit is one aggregation, not a row loop."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, count_where, is_finite, ratio
from ..functions.rolling import lagged
from ..plans.skew import previous_value, quantiles

TOLERANCE = 1e-9
JUMP_SIMPLE = 0.25
JUMP_LOG = 0.35
# The five ordering rules (name, left, right, relation).
OHLC_RULES = (
    ("high_below_low", "high", "low", "ge"),
    ("high_below_open", "high", "open", "ge"),
    ("high_below_close", "high", "close", "ge"),
    ("low_above_open", "low", "open", "le"),
    ("low_above_close", "low", "close", "le"),
)
PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")


def _breach(left: str, right: str, relation: str) -> Column:
    return F.col(left) < F.col(right) if relation == "ge" else F.col(left) > F.col(right)


def _close(left: str, right: str, atol: float, rtol: float) -> Column:
    return F.abs(F.col(left) - F.col(right)) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col(right))


def _rule_aggregates(atol: float, rtol: float) -> list[Column]:
    complete = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col(
        "close").isNotNull()
    out = []
    for name, left, right, relation in OHLC_RULES:
        breach, near = complete & _breach(left, right, relation), _close(left, right, atol, rtol)
        gap = F.max(F.when(breach, F.abs(F.col(left) - F.col(right))))
        out += [count_where(breach & ~near).alias(f"{name}_hard"), count_where(breach & near).alias(f"{name}_cleared"),
                F.coalesce(gap, F.lit(0.0)).alias(f"{name}_worst")]
    return out


def ohlc_violations(bars: DataFrame, keys: tuple[str, ...] = ("ticker",), atol: float = TOLERANCE,
                    rtol: float = TOLERANCE) -> DataFrame:
    """Per rule: breaches beyond the tolerance, breaches cleared as rounding, widest breach."""
    out = bars.groupBy(*keys).agg(*_rule_aggregates(atol, rtol))
    total = [F.col(f"{r[0]}_hard") for r in OHLC_RULES]
    cleared = [F.col(f"{r[0]}_cleared") for r in OHLC_RULES]
    return out.withColumns({"total_hard": sum(total[1:], total[0]), "total_cleared": sum(cleared[1:], cleared[0])})


def frame_issues(bars: DataFrame, seq: str, start: str | None = None, end: str | None = None,
                 atol: float = TOLERANCE, rtol: float = TOLERANCE) -> DataFrame:
    """Issue list per ticker, in a fixed order; ``end`` is exclusive.

    ``seq`` is the ingest order, against which dates must not go back.  Order is
    checked against the highest date of earlier ingest positions: per-date
    first and last positions are compared, so repeated rows collapse first.
    """
    spans = bars.groupBy("ticker", "date").agg(F.min(seq).alias("_lo"), F.max(seq).alias("_hi"),
                                               F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    order = spans.withColumn("_back", F.max("_hi").over(before) > F.col("_lo")).groupBy("ticker").agg(
        count_where(F.col("_back")).alias("_backward"), F.max("_n").alias("_most"))
    stats = bars.groupBy("ticker").agg(
        F.min("date").alias("_first"), F.max("date").alias("_last"),
        count_where(_any_null(VALUES)).alias("_nulls"), count_where(F.col("volume") < 0).alias("_negative"),
        *_rule_aggregates(atol, rtol))
    df = stats.join(order, "ticker")
    found = [F.when(F.col("_backward") > 0, "date_not_monotonic"), F.when(F.col("_most") > 1, "duplicate_dates")]
    if start is not None:
        found.append(F.when(F.col("_first") < F.lit(start).cast("date"),
                            F.concat(F.lit("date_before_start:"), F.col("_first").cast("string"))))
    if end is not None:
        found.append(F.when(F.col("_last") >= F.lit(end).cast("date"),
                            F.concat(F.lit("date_on_or_after_end:"), F.col("_last").cast("string"))))
    found += [F.when(F.col("_nulls") > 0, "nulls"), F.when(F.col("_negative") > 0, "negative_volume")]
    found += [F.when(F.col(f"{r[0]}_hard") > 0, F.concat(F.lit(f"{r[0]}:"), F.col(f"{r[0]}_hard").cast("string")))
              for r in OHLC_RULES]
    return df.select("ticker", F.array_compact(F.array(*found)).alias("issues"))


def _any_null(columns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def strict_quality(bars: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Zero-tolerance report: inconsistent, non-positive and zero-volume rows with their date spans."""
    bad = F.lit(False)
    for _, left, right, relation in OHLC_RULES:
        bad = bad | _breach(left, right, relation)
    bad = bad & ~_any_null(PRICES)
    low = F.lit(False)
    for c in PRICES:
        low = low | F.coalesce(F.col(c) <= 0, F.lit(False))
    day = F.col("date")
    return bars.groupBy(*keys).agg(
        count_where(bad).alias("inconsistent_rows"), F.min(F.when(bad, day)).alias("inconsistent_first"),
        F.max(F.when(bad, day)).alias("inconsistent_last"), count_where(low).alias("non_positive_rows"),
        F.min(F.when(low, day)).alias("non_positive_first"), F.max(F.when(low, day)).alias("non_positive_last"),
        count_where(F.col("volume") == 0).alias("zero_volume_rows"))


def price_jumps(bars: DataFrame, threshold: float = JUMP_SIMPLE) -> DataFrame:
    """Bars whose simple return exceeds the threshold in size; sort by ``abs_return`` to list them."""
    change = ratio(F.col("close"), lagged(F.col("close"))) - 1.0
    return (bars.withColumn("return", change).withColumn("abs_return", F.abs("return"))
            .where(F.col("abs_return") > threshold)
            .select("ticker", "date", "close", "volume", "return", "abs_return"))


def coverage(bars: DataFrame, requested: DataFrame, late_after: str = "2000-01-03") -> DataFrame:
    """Rows, span and status of every requested (ticker, variant); late starters are marked."""
    have = bars.groupBy("ticker", "variant").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    df = requested.join(have, ["ticker", "variant"], "left")
    return df.select("ticker", "variant", F.coalesce("rows", F.lit(0)).alias("rows"), "first_date", "last_date",
                     F.when(F.col("rows") > 0, "complete").otherwise("unavailable").alias("status"),
                     F.coalesce(F.col("first_date") > F.lit(late_after).cast("date"), F.lit(False)).alias("late_start"))


def coverage_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("variant").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("status") == "complete").alias("complete"),
        F.sum("rows").alias("total_rows"), F.min("first_date").alias("earliest_date"),
        F.max("last_date").alias("latest_date"), F.count_if("late_start").alias("late_starters"))


def source_coverage_gate(observations: DataFrame, first_year: int, last_year: int, floor: int = 200,
                         max_shortfall: float = 0.05, max_gap_days: int = 45) -> DataFrame:
    """Accept or reject each external source, with reasons in a fixed order.

    Every year of the span must hold ``floor`` observations and lie within
    ``max_shortfall`` of the source's own best year, no gap may exceed
    ``max_gap_days``, and the source must reach the end of the span.  A year
    without observations counts zero.
    """
    years = range(first_year, last_year + 1)
    days = observations.select("source_id", "source_date").distinct()
    gap = F.date_diff("source_date", F.lag("source_date").over(
        Window.partitionBy("source_id").orderBy("source_date")))
    stats = days.withColumn("_gap", gap).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_observations"), F.min("source_date").alias("first_date"),
        F.max("source_date").alias("last_date"), F.count_if(F.col("_gap") > max_gap_days).alias("long_gaps"),
        *[F.count_if(F.year("source_date") == y).alias(f"n_{y}") for y in years])
    best = F.greatest(*[F.col(f"n_{y}") for y in years], F.lit(0))
    stats = stats.withColumn("best_year_count", best)
    end = dt.date(last_year, 12, 31)
    reasons = [F.when(F.col("last_date") < F.lit(end), F.concat(
        F.lit("coverage ends "), F.col("last_date").cast("string"), F.lit(", before the development window")))]
    shortfalls = []
    for y in years:
        n = F.col(f"n_{y}")
        short = 1.0 - n / F.col("best_year_count")
        thin = n < floor
        reasons.append(F.when(thin, F.concat(
            F.lit(f"{y} has only "), n.cast("string"), F.lit(f" observations (floor {floor})")))
            .when(short > max_shortfall, F.concat(
                F.lit(f"{y} density "), n.cast("string"), F.lit(" is "), F.format_string("%.3f", short),
                F.lit(" below this source's best development year ("), F.col("best_year_count").cast("string"),
                F.lit(")"))))
        shortfalls.append(F.when(thin, F.lit(1.0)).otherwise(short))
    reasons.append(F.when(F.col("long_gaps") > 0, F.concat(
        F.col("long_gaps").cast("string"),
        F.lit(f" unexplained gap(s) longer than {max_gap_days} calendar days"))))
    listed = F.array_compact(F.array(*reasons))
    return stats.select(
        "source_id", (F.size(listed) == 0).alias("passed"), F.array_join(listed, "; ").alias("reason"),
        "n_observations", "first_date", "last_date", *[f"n_{y}" for y in years], "best_year_count",
        (F.greatest(*shortfalls) if len(shortfalls) > 1 else shortfalls[0]).alias("max_missing_fraction"),
        "long_gaps")


class BoundaryError(ValueError):
    """A date lies past the boundary or inside a sealed year."""


def boundary_violations(df: DataFrame, columns: list[str], boundary: str | None = None,
                        sealed: tuple[str, str] | None = None) -> DataFrame:
    """Per date column: rows past the boundary, rows inside the sealed span, latest date (one aggregation)."""
    rows = []
    for c in columns:
        past = F.lit(False) if boundary is None else F.col(c) > F.lit(boundary).cast("date")
        inside = F.lit(False) if sealed is None else F.col(c).between(
            F.lit(sealed[0]).cast("date"), F.lit(sealed[1]).cast("date"))
        rows.append(F.struct(F.lit(c).alias("column"), count_where(past).alias("past_boundary"),
                             count_where(inside).alias("in_sealed_span"), F.max(c).alias("max_date")))
    return df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def assert_boundary(df: DataFrame, columns: list[str], boundary: str | None = None,
                    sealed: tuple[str, str] | None = None, where: str = "frame") -> DataFrame:
    """Raise when any date is out of bounds; otherwise hand the frame back."""
    report = boundary_violations(df, columns, boundary, sealed).where(
        (F.col("past_boundary") > 0) | (F.col("in_sealed_span") > 0)).collect()
    if report:
        raise BoundaryError(f"{where}: " + "; ".join(
            f"{r['column']} has {r['past_boundary']} rows past {boundary} and {r['in_sealed_span']} in a sealed span, "
            f"latest {r['max_date']}" for r in report))
    return df


def availability_violations(df: DataFrame, observed: str = "observation_date", predicted: str = "origin_date",
                            strict: bool = False) -> DataFrame:
    """Rows that use an observation later than (or, when strict, on) the prediction date."""
    late = F.col(observed) >= F.col(predicted) if strict else F.col(observed) > F.col(predicted)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), count_where(late).alias("violations"),
                  F.max(observed).alias("max_observed"))


def assert_availability(df: DataFrame, observed: str = "observation_date", predicted: str = "origin_date",
                        strict: bool = False) -> DataFrame:
    found = availability_violations(df, observed, predicted, strict).first()
    if found["violations"]:
        raise BoundaryError(f"{found['violations']} of {found['n_rows']} rows use unavailable observations")
    return df


def source_integrity(observations: DataFrame, threshold: float = JUMP_LOG) -> DataFrame:
    """Repeated dates and one-step moves beyond the threshold in log terms, per source.

    Moves are measured along the ordered distinct dates (last value of a
    repeated date), so that repeats collapse before the window.
    """
    daily = observations.groupBy("source_id", "source_date").agg(
        F.count(F.lit(1)).alias("_n"), F.max("close").alias("close"))
    w = Window.partitionBy("source_id").orderBy("source_date")
    valued = daily.withColumn("_prev", F.last("close", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    move = F.abs(F.log(F.when(F.col("close") > 0, F.col("close"))) - F.log(F.when(F.col("_prev") > 0, F.col("_prev"))))
    return valued.groupBy("source_id").agg(
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_dates"),
        count_where(move > threshold).alias("suspicious_jumps"))


def degenerate_columns(df: DataFrame, columns: list[str], min_share: float = 0.5) -> DataFrame:
    """Present count, spread and verdict of each column (one aggregation, one row per column)."""
    n = F.count(F.lit(1))
    rows = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n_present"),
                     F.stddev_samp(c).alias("spread")) for c in columns]
    wide = df.agg(n.alias("n_rows"), F.array(*rows).alias("_c"))
    long = wide.select("n_rows", F.inline("_c"))
    floor = F.greatest(F.floor(F.lit(min_share) * F.col("n_rows")), F.lit(1))
    reason = (F.when(F.col("n_present") == 0, "all_null").when(F.col("n_present") < floor, "too_sparse")
              .when(F.coalesce(F.col("spread"), F.lit(0.0)) == 0, "constant"))
    return long.withColumn("reason", reason).withColumn("dropped", F.col("reason").isNotNull())


def drop_degenerate(df: DataFrame, columns: list[str], min_share: float = 0.5) -> tuple[DataFrame, list[str]]:
    """The frame without degenerate columns, and their names (one small collect: a row per column)."""
    gone = [r["column"] for r in degenerate_columns(df, columns, min_share).where("dropped").collect()]
    return df.drop(*gone), sorted(gone)


def finite_rows(columns: list[str]) -> Column:
    """True where every listed column holds a finite number."""
    out = F.lit(True)
    for c in columns:
        out = out & is_finite(F.col(c))
    return out


def vendor_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two vendors on shared dates, per ticker."""
    keys = ["ticker", "date"]
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in VALUES])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in VALUES])
    both = left.join(right, keys).where(F.col("a_close").isNotNull() & F.col("b_close").isNotNull())
    diff = F.abs(F.col("a_close") - F.col("b_close"))
    rel = ratio(diff, F.abs(F.col("b_close")))
    widest = [F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))) for c in PRICES]
    same = F.avg(F.coalesce(F.col("a_volume") == F.col("b_volume"), F.lit(False)).cast("double"))
    return both.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("overlapping_days"), F.max(diff).alias("max_abs_close_diff"),
        F.avg(diff).alias("mean_abs_close_diff"), (F.max(rel) * 100).alias("max_rel_close_diff_pct"),
        (F.avg(rel) * 100).alias("mean_rel_close_diff_pct"),
        sum(widest[1:], widest[0]).alias("max_abs_diff_across_ohlc"), (same * 100).alias("volume_exact_match_pct"))


def adjustment_comparison(adjusted: DataFrame, unadjusted: DataFrame, threshold: float = JUMP_SIMPLE) -> DataFrame:
    """Adjusted against unadjusted closes: counts, spans, return correlation, split-like jumps, widest gap."""
    keys = ["ticker", "date"]
    a = adjusted.groupBy("ticker").agg(F.count(F.lit(1)).alias("adjusted_rows"), F.min("date").alias("adjusted_first"),
                                       F.max("date").alias("adjusted_last"))
    u = unadjusted.groupBy("ticker").agg(F.count(F.lit(1)).alias("unadjusted_rows"),
                                         F.min("date").alias("unadjusted_first"),
                                         F.max("date").alias("unadjusted_last"))
    both = adjusted.select(*keys, F.col("close").alias("_a")).join(
        unadjusted.select(*keys, F.col("close").alias("_u")), keys)
    both = both.withColumns({"_ra": ratio(F.col("_a"), lagged(F.col("_a"))) - 1.0,
                             "_ru": ratio(F.col("_u"), lagged(F.col("_u"))) - 1.0})
    pair = F.col("_ra").isNotNull() & F.col("_ru").isNotNull()
    joint = both.groupBy("ticker").agg(
        count_where(F.abs("_ru") > threshold).alias("split_like_jumps"),
        F.when(F.count(F.lit(1)) > 3, correlation(F.when(pair, F.col("_ra")), F.when(pair, F.col("_ru")))).alias(
            "return_correlation"),
        F.max(F.abs(F.col("_a") - F.col("_u"))).alias("max_abs_close_diff"))
    df = a.join(u, "ticker", "full").join(joint, "ticker", "left")
    return df.withColumn("row_counts_equal", F.col("adjusted_rows") == F.col("unadjusted_rows"))


def access_audit(samples: DataFrame, source: DataFrame, boundary: str) -> DataFrame:
    """Latest origin and target consumed, and source rows past the boundary."""
    used = samples.agg(F.count(F.lit(1)).alias("n_samples"), F.max("origin_date").alias("max_origin_date"),
                       F.max("target_date").alias("max_target_date"))
    held = source.agg(F.max("date").alias("max_source_date"),
                      count_where(F.col("date") > F.lit(boundary).cast("date")).alias("source_rows_past_boundary"))
    keyed = used.withColumn("_k", F.lit(0)).join(held.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return keyed.withColumn("clean", F.coalesce(
        (F.col("max_target_date") <= F.lit(boundary).cast("date"))
        & (F.col("max_origin_date") <= F.lit(boundary).cast("date")), F.lit(True)))


def dataset_profile(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Rows, span, NULL counts and frequency inferred from the median gap between neighbouring stamps.

    Equal stamps are merged first and count as gaps of zero; a key with any
    share of the rows is cut into slices (``plans.skew``).
    """
    stamps = df.where(F.col(stamp).isNotNull()).groupBy(*keys, stamp).agg(F.count(F.lit(1)).alias("_n"))
    steps = previous_value(stamps, keys, stamp, "_prev")
    moved = steps.where(F.col("_prev").isNotNull()).select(
        *keys, (_seconds(stamp) - _seconds("_prev")).alias("_gap"), F.lit(1).cast("bigint").alias("_c"))
    repeats = stamps.where(F.col("_n") > 1).select(*keys, F.lit(0.0).alias("_gap"), (F.col("_n") - 1).alias("_c"))
    median = quantiles(moved.unionByName(repeats), keys, "_gap", {"median_gap_seconds": 0.5}, F.col("_c"))
    others = [c for c in df.columns if c not in keys]
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(stamp).alias("first_stamp"), F.max(stamp).alias("last_stamp"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in others])
    return base.join(median, keys, "left").withColumn("frequency", frequency_name(F.col("median_gap_seconds")))


def _seconds(c: str) -> Column:
    """Seconds since the epoch, with fractions, for zoned and zone-free stamps alike."""
    return F.col(c).cast("timestamp").cast("double")


def frequency_name(gap: Column) -> Column:
    # Upper bound in seconds and name of each frequency.
    steps = ((60, "1-minute"), (300, "5-minute"), (900, "15-minute"), (1800, "30-minute"), (3600, "hourly"),
             (86400, "daily"))
    out = F.when(gap.isNull(), "unknown")
    for bound, name in steps:
        out = out.when(gap <= bound, name)
    return out.otherwise("other")


def provenance(df: DataFrame, stamp: str = "date", key: str = "ticker") -> DataFrame:
    """First and last stamp and rows per ticker."""
    return df.groupBy(key).agg(F.min(stamp).alias("first_stamp"), F.max(stamp).alias("last_stamp"),
                               F.count(F.lit(1)).alias("rows"))


def provenance_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_tickers"), F.min("first_stamp").alias("earliest"),
                     F.max("last_stamp").alias("latest"), F.sum("rows").alias("total_rows"))


