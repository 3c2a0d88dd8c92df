"""Chronological splits.  Fold windows are parameters, so membership is a column, not a join."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import series


@dataclass(frozen=True)
class Fold:
    """Inclusive date windows of one fold; the test window may be absent."""

    name: str
    train: tuple[str, str]
    val: tuple[str, str]
    test: tuple[str, str] | None = None

    def windows(self) -> list[tuple[str, tuple[str, str]]]:
        out = [("train", self.train), ("val", self.val)]
        return out if self.test is None else [*out, ("test", self.test)]


def anchored_folds(prefix: str, start: str, years: range) -> list[Fold]:
    """Folds that train from ``start`` to the year before each validation year."""
    return [Fold(f"{prefix}{y}", (start, f"{y - 1}-12-31"), (f"{y}-01-01", f"{y}-12-31")) for y in years]


# The declared fold sets.
SEARCH_FOLDS = [
    Fold("SEARCH_FOLD_A", ("2016-01-01", "2018-12-31"), ("2019-01-01", "2019-12-31")),
    Fold("SEARCH_FOLD_B", ("2016-01-01", "2019-12-31"), ("2020-01-01", "2020-12-31")),
    Fold("SEARCH_FOLD_C", ("2016-01-01", "2020-12-31"), ("2021-01-01", "2021-12-31")),
]
PAPER_FOLDS = [
    Fold("fold_0", ("2016-01-01", "2020-12-31"), ("2021-01-01", "2021-12-31"), ("2022-01-01", "2022-12-31")),
    Fold("fold_1", ("2016-01-01", "2021-12-31"), ("2022-01-01", "2022-12-31"), ("2023-01-01", "2023-12-31")),
]
DEV_FOLDS = [
    Fold("V2_DEV_FOLD_A", ("2005-01-01", "2018-12-31"), ("2019-01-01", "2019-12-31")),
    Fold("V2_DEV_FOLD_B", ("2005-01-01", "2019-12-31"), ("2020-01-01", "2020-12-31")),
    Fold("V2_LOCKBOX", ("2005-01-01", "2020-12-31"), ("2021-01-01", "2021-12-31")),
]
MULTI_HORIZON_FOLDS = [*anchored_folds("MH_DEV_", "2005-01-01", range(2014, 2019)),
                       *anchored_folds("MH_LOCKBOX_", "2005-01-01", range(2019, 2020))]


def folds_frame(spark, folds: list[Fold]) -> DataFrame:
    """A fold set as rows."""
    rows = [(f.name, *[dt.date.fromisoformat(d) for d in (*f.train, *f.val)],
             *([dt.date.fromisoformat(d) for d in f.test] if f.test else [None, None])) for f in folds]
    return spark.createDataFrame(rows, "fold string, train_start date, train_end date, val_start date, "
                                       "val_end date, test_start date, test_end date")


def _inside(c: str, window: tuple[str, str]) -> Column:
    return F.col(c).between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))


def assign_folds(df: DataFrame, folds: list[Fold], dates: tuple[str, ...] = ("origin_date", "target_date")
                 ) -> DataFrame:
    """Rows with (fold, split), once for every window that holds ALL the given dates.

    A sample whose label crosses a window's edge belongs to no split of it.
    """
    cells = [F.when(ok, cell) for ok, cell in _fold_cells(folds, dates)]
    return df.select("*", F.inline(F.array_compact(F.array(*cells))))


def _fold_cells(folds: list[Fold], dates: tuple[str, ...]) -> list[tuple[Column, Column]]:
    """Each window's rule, that it holds all the given dates, and its (fold, split)."""
    return [(reduce(lambda ok, d: ok & _inside(d, window), dates, F.lit(True)),
             F.struct(F.lit(f.name).alias("fold"), F.lit(split).alias("split"))) for f in folds for split, window in f.windows()]


def split_by_date(df: DataFrame, fold: Fold, date: str = "date") -> DataFrame:
    """Inclusive date split of one fold."""
    return assign_folds(df, [fold], (date,)).drop("fold")


def split_by_span(df: DataFrame, train_frac: float = 0.85, val_frac: float = 0.10, date: str = "date") -> DataFrame:
    """Split by share of the calendar span.

    The first ``train_frac`` of the span is the training region, its last
    ``val_frac`` the validation part; the test part starts one day after the
    region's (fractional) end.  Rows in between belong to no part.
    """
    if train_frac <= 0 or val_frac <= 0 or train_frac + val_frac >= 1.0:
        raise ValueError("fractions must be positive and sum to less than 1")
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).first()
    if span["lo"] is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    lo = dt.date(span["lo"].year, span["lo"].month, span["lo"].day)
    total = (span["hi"] - span["lo"]).days
    edge = total * train_frac
    offset = F.date_diff(F.col(date), F.lit(lo))
    region = df.where(offset <= F.lit(edge)).agg(F.max(offset).alias("m")).first()["m"]
    cut = region * (1.0 - val_frac)
    split = (F.when((offset <= F.lit(edge)) & (offset < F.lit(cut)), "train").when(offset <= F.lit(edge), "val")
             .when(offset >= F.lit(edge + 1), "test"))
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def split_by_position(df: DataFrame, train_frac: float = 0.7, val_frac: float = 0.15, key: str = "ticker",
                      date: str = "date") -> DataFrame:
    """Split each ticker's rows by position."""
    i = F.row_number().over(series(key, date)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    df = df.withColumns({"_i": i, "_n": n})
    train, val = F.floor(F.col("_n") * F.lit(train_frac)), F.floor(F.col("_n") * F.lit(val_frac))
    split = F.when(F.col("_i") < train, "train").when(F.col("_i") < train + val, "val").otherwise("test")
    return df.withColumn("split", split).drop("_i", "_n")


def yearly_folds(df: DataFrame, date: str = "date", train_start: str = "2016-01-01", first_val: int = 2021
                 ) -> DataFrame:
    """Anchored yearly folds until the data end, each with availability and reason."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    start = dt.date.fromisoformat(train_start)
    rows, year = [], first_val
    while True:
        end = dt.date(year + 1, 12, 31)
        reason = None
        if start < lo:
            reason = f"Data starts {lo}, after required train start {start}"
        elif end > hi:
            reason = f"Data ends {hi}, before required test end {end}"
        rows.append((len(rows), start, dt.date(year - 1, 12, 31), dt.date(year, 1, 1), dt.date(year, 12, 31),
                     dt.date(year + 1, 1, 1), end, reason is None, reason))
        if end >= hi:
            break
        year += 1
    return df.sparkSession.createDataFrame(
        rows, "fold bigint, train_start date, train_end date, val_start date, val_end date, test_start date, "
              "test_end date, available boolean, reason string")


def index_folds(df: DataFrame, step: int = 21, min_train: int = 252, key: str = "ticker") -> DataFrame:
    """Anchored row-index folds per ticker: train [0, e), test [e, e + step)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_train + step)
    ends = F.sequence(F.lit(min_train).cast("bigint"), F.col("_n") - step, F.lit(step).cast("bigint"))
    return sizes.select(key, F.posexplode(ends).alias("fold", "train_end")).select(
        key, "fold", F.lit(0).alias("train_start"), "train_end", F.col("train_end").alias("test_start"),
        (F.col("train_end") + step).alias("test_end"))


def fold_coverage(df: DataFrame, folds: list[Fold], date: str = "date") -> DataFrame:
    """Rows, tickers and observed bounds per fold and split.

    ``available`` keeps the reference's rule: as many rows as calendar days.
    """
    days = F.create_map(*[x for f in folds for s, w in f.windows() for x in (
        F.lit(f"{f.name}/{s}"), F.lit((dt.date.fromisoformat(w[1]) - dt.date.fromisoformat(w[0])).days + 1))])
    out = assign_folds(df, folds, (date,)).groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"),
        F.min(date).alias("actual_start"), F.max(date).alias("actual_end"))
    return out.withColumn("available", F.col("n_rows") >= F.element_at(days, F.concat_ws("/", "fold", "split")))


def fold_years(df: DataFrame, folds: list[Fold], date: str = "date") -> DataFrame:
    """Rows and tickers per fold, split and year."""
    return assign_folds(df, folds, (date,)).groupBy("fold", "split", F.year(date).alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"))


def boundary_report(samples: DataFrame, folds: list[Fold]) -> DataFrame:
    """Samples per fold and split with the latest origin and target consumed."""
    return assign_folds(samples, folds).groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("ticker").alias("n_tickers"),
        F.max("origin_date").alias("max_origin"), F.max("target_date").alias("max_target"))


def common_in_folds(samples: DataFrame, folds: list[Fold], horizons: tuple[int, ...]) -> DataFrame:
    """Samples of each fold and split whose origin is valid there at every horizon.

    The horizons of an origin are counted for each window before its rows are
    placed: rows are ordered once, as they come, and joined with nothing.
    """
    origin = Window.partitionBy("ticker", "origin_date")
    rules = _fold_cells(folds, ("origin_date", "target_date"))
    counted = samples.where(F.col("ticker").isNotNull()).withColumns({
        f"_c{i}": ok & (F.size(F.collect_set(F.when(ok, F.col("horizon"))).over(origin)) == len(set(horizons)))
        for i, (ok, _) in enumerate(rules)})
    cells = F.array_compact(F.array(*[F.when(F.col(f"_c{i}"), cell) for i, (_, cell) in enumerate(rules)]))
    return counted.select(*samples.columns, F.inline(cells))


def chronological_dates(df: DataFrame, cutoff: str, share: float = 0.85, date: str = "date") -> DataFrame:
    """Distinct dates before the cutoff, the first share labelled train, the rest val.

    One row per calendar date, hence one bounded task.  The cut is rounded half to even.
    """
    days = df.where(F.col(date) < F.lit(cutoff).cast("date")).select(F.col(date).alias("date")).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date"))
    cut = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * F.lit(share)).cast("bigint")))
    return days.withColumns({"_n": n, "_i": i}).select(
        "date", F.when(F.col("_i") <= cut, "train").otherwise("val").alias("split"))


def calibration_split(predictions: DataFrame, keys: list[str], share: float = 0.6, date: str = "origin_date"
                      ) -> DataFrame:
    """Earlier rows fit, later rows score, by membership of the date.

    The cut falls on a sample, so a date on the cut is in both parts; rows of
    such a date appear once as ``fit`` and once as ``score``.
    """
    daily = predictions.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumns({"_cum": F.sum("_c").over(up_to), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    fit = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1))
    edges = daily.withColumn("_fit", fit).groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") >= F.col("_fit"), F.col(date))).alias("fit_end"),
        F.min(F.when(F.col("_cum") >= F.col("_fit") + 1, F.col(date))).alias("score_start"),
        F.max("_n").alias("_n")).where(F.col("_n") >= 5).drop("_n")
    placed = predictions.join(edges, keys)
    parts = F.array_compact(F.array(F.when(F.col(date) <= F.col("fit_end"), "fit"),
                                    F.when(F.col(date) >= F.col("score_start"), "score")))
    return placed.withColumn("part", F.explode(parts))


def unit_hash(seed: int, *columns: Column) -> Column:
    """Uniform number in [0, 1) that depends only on the seed and the values."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def random_split(df: DataFrame, share: float = 0.85, seed: int = 42) -> DataFrame:
    """Deliberately wrong pooled split that ignores time: a labelled leakage probe."""
    u = unit_hash(seed, F.col("ticker"), F.col("origin_date"))
    return df.withColumn("split", F.when(u < share, "train").otherwise("val"))


def same_day_label(bars: DataFrame) -> DataFrame:
    """Deliberately wrong label that the origin row already contains: a labelled leakage probe."""
    prev = F.lag("close").over(series())
    return bars.withColumn("_prev", prev).where(F.col("_prev").isNotNull()).select(
        "ticker", F.col("date").alias("origin_date"), (F.col("close") > F.col("_prev")).cast("int").alias("y"))


def fold_reach(spans: DataFrame, folds: list[Fold]) -> DataFrame:
    """Whether each ticker's last date reaches each fold's test window."""
    return spans.select("ticker", "last_stamp", F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("fold"),
                 (F.col("last_stamp") >= F.lit((f.test or f.val)[0]).cast("date")).alias("available"))
        for f in folds])))


