"""Windowed samples.  Usability is decided by windowed counts; arrays are built only on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ahead, series, trailing
from .quality import finite_rows
from .splits import unit_hash


def add_window_flags(frame: DataFrame, window_columns: list[str], length: int,
                     origin_columns: list[str] | None = None) -> DataFrame:
    """Add ``row`` (position in the ticker) and ``window_ok``.

    ``window_ok``: the ``length`` rows ending here are finite in
    ``window_columns``, and this row is finite in ``origin_columns``.
    """
    good = finite_rows(window_columns).cast("int")
    df = frame.withColumn("_good", good).withColumns({
        "row": F.row_number().over(series()) - 1,
        "window_ok": F.sum("_good").over(trailing(length)) == length})
    if origin_columns:
        df = df.withColumn("window_ok", F.col("window_ok") & finite_rows(origin_columns))
    return df.drop("_good")


def judge_samples(frame: DataFrame, targets: DataFrame, window_columns: list[str], length: int,
                  origin_columns: list[str] | None = None, required: tuple[str, ...] = ("y_direction",),
                  sealed: tuple[str, str] | None = None) -> DataFrame:
    """Every candidate target with ``row`` and the first reason that rules it out (NULL = usable).

    Reasons in order: sealed year, no full window, non-finite inputs, missing
    target.  Tickers without features are not candidates.
    """
    flags = add_window_flags(frame, window_columns, length, origin_columns).select(
        "ticker", F.col("date").alias("origin_date"), "row", "window_ok")
    known = frame.select("ticker").distinct()
    df = targets.join(known, "ticker", "left_semi").join(flags, ["ticker", "origin_date"], "left")
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    in_sealed = F.lit(False) if sealed is None else F.col("target_date").between(
        F.lit(sealed[0]).cast("date"), F.lit(sealed[1]).cast("date"))
    reason = (F.when(in_sealed, "sealed_year_excluded")
              .when(F.col("row").isNull() | (F.col("row") < length - 1), "no_full_window")
              .when(~F.col("window_ok"), "non_finite_inputs").when(missing, "missing_target"))
    return df.withColumn("drop_reason", reason).drop("window_ok")


def usable(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("drop_reason").isNull()).drop("drop_reason")


def drop_counts(judged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return judged.groupBy(*by, F.coalesce("drop_reason", F.lit("usable")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


def add_ids(samples: DataFrame, ticker_vocab: DataFrame, sector_vocab: DataFrame, sectors: DataFrame) -> DataFrame:
    """Add ``ticker_id`` and ``sector_id``; anything unknown gets 0."""
    t = ticker_vocab.select(F.col("value").alias("ticker"), F.col("id").alias("ticker_id"))
    s = sectors.select("ticker", "sector").join(
        sector_vocab.select(F.col("value").alias("sector"), F.col("id").alias("sector_id")), "sector", "left")
    df = samples.join(t, "ticker", "left").join(s.select("ticker", "sector_id"), "ticker", "left")
    return df.withColumns({"ticker_id": F.coalesce("ticker_id", F.lit(0)),
                           "sector_id": F.coalesce("sector_id", F.lit(0))})


def base_samples(features: DataFrame, columns: list[str], length: int, drop_na: bool = True) -> DataFrame:
    """Per-ticker samples: a full finite window ending at the origin, a label, a later next date.

    The next date is taken before incomplete rows are dropped.
    """
    df = features.withColumn("target_date", ahead(F.col("date")))
    if drop_na:
        df = df.dropna(subset=[*columns, "target"])
    df = add_window_flags(df, columns, length)
    return df.where(F.col("window_ok") & F.col("target").isNotNull() & (F.col("target_date") > F.col("date"))
                    ).withColumnRenamed("date", "origin_date").drop("window_ok")


def with_sequences(frame: DataFrame, columns: list[str], length: int, exclusive: bool = False,
                   name: str = "sequence") -> DataFrame:
    """Add the window as an array of feature vectors, oldest first.

    Inclusive windows end at the row; exclusive ones end at the row before it.
    Rows without a full window of present values get NULL.  At most ``length``
    vectors are ever held for a row.
    """
    lo, hi = (-length, -1) if exclusive else (-(length - 1), 0)
    w = series().rowsBetween(lo, hi)
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    df = frame.withColumns({"_v": F.array(*[F.col(c).cast("double") for c in columns]), "_ok": present.cast("int")})
    return df.withColumn(name, F.when(F.sum("_ok").over(w) == length, F.collect_list("_v").over(w))).drop("_v", "_ok")


def sequences_before(features: DataFrame, columns: list[str], length: int) -> DataFrame:
    """Exclusive windows with the label of the row that follows them."""
    return with_sequences(features, columns, length, exclusive=True).where(F.col("sequence").isNotNull())


def origin_snapshot(samples: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Unscaled feature values at each sample's origin."""
    return samples.join(features.select("ticker", F.col("date").alias("origin_date"), *columns),
                        ["ticker", "origin_date"])


def exogenous_windows(stock_rows: DataFrame, exogenous: DataFrame, columns: list[str], length: int) -> DataFrame:
    """(ticker, date) whose last ``length`` own dates all have finite exogenous values.

    A date that is listed more than once counts if all its rows are finite; the
    broadcast table has one row per calendar day.
    """
    flags = exogenous.groupBy("date").agg(F.min(finite_rows(columns).cast("int")).alias("_x"))
    df = stock_rows.select("ticker", "date").join(F.broadcast(flags), "date", "left")
    df = df.withColumn("_n", F.sum(F.coalesce("_x", F.lit(0))).over(trailing(length)))
    return df.withColumn("exogenous_ok", F.col("_n") == length).drop("_x", "_n")


def episodes(samples: DataFrame, support: int = 120, query: int = 20, stride: int = 20,
             max_episodes: int | None = None, seed: int = 42) -> DataFrame:
    """Chronological support and query rows, long: one row per (episode, sample).

    A row at position p belongs to the few starts that cover it, so membership
    is an explode of at most ``(support + query) / stride`` starts, not a join.
    """
    total = support + query
    df = samples.withColumns({"_p": (F.row_number().over(series(order="origin_date")) - 1).cast("bigint"),
                              "_n": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    last = F.floor(F.least(F.col("_p"), F.col("_n") - total) / stride)
    first = F.greatest(F.ceil((F.col("_p") - total + 1) / stride), F.lit(0))
    df = df.where(F.col("_n") >= total).where(first <= last)
    df = df.withColumn("_s", F.explode(F.sequence(first, last))).withColumn("start", F.col("_s") * stride).drop("_s")
    role = F.when(F.col("_p") < F.col("start") + support, "support").otherwise("query")
    df = df.withColumn("role", role).drop("_n").withColumnRenamed("_p", "position")
    if max_episodes is not None:
        order = unit_hash(seed, F.col("ticker"), F.col("start"))
        kept = df.select("ticker", "start").distinct().orderBy(order, "ticker", "start").limit(max_episodes)
        df = df.join(kept, ["ticker", "start"], "left_semi")
    return df


def episode_spans(rows: DataFrame) -> DataFrame:
    """One row per episode with sizes and date spans of both sides."""
    def side(r: str, agg) -> Column:
        return agg(F.when(F.col("role") == r, F.col("origin_date")))

    return rows.groupBy("ticker", "start").agg(
        F.count_if(F.col("role") == "support").alias("n_support"), F.count_if(F.col("role") == "query").alias("n_query"),
        side("support", F.min).alias("support_first"), side("support", F.max).alias("support_last"),
        side("query", F.min).alias("query_first"), side("query", F.max).alias("query_last"))


def support_before(samples: DataFrame, n: int, train_end: str, val_start: str) -> DataFrame:
    """The last n labelled samples of each ticker before the validation window."""
    before = samples.where((F.col("target_date") <= F.lit(train_end).cast("date"))
                           & (F.col("target_date") < F.lit(val_start).cast("date")))
    w = Window.partitionBy("ticker").orderBy(F.col("origin_date").desc())
    return before.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def balanced_weights(samples: DataFrame) -> DataFrame:
    """Add ``weight``: one over the ticker's count, normalised to sum 1.

    Each ticker's weights sum to the same share, so the total is the number of
    tickers and no pass over the rows is needed for it.
    """
    counts = samples.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.count(F.lit(1)).alias("_k"))
    keyed = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    return samples.join(keyed.drop("_one"), "ticker").withColumn(
        "weight", 1.0 / F.col("_n") / F.col("_k")).drop("_n", "_k")


def sample_summary(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("ticker").alias("n_tickers"),
        F.min("origin_date").alias("first_origin_date"), F.max("origin_date").alias("last_origin_date"),
        F.min("target_date").alias("first_target_date"), F.max("target_date").alias("last_target_date"),
        F.avg("y_direction").alias("direction_positive_rate"))


def target_day_leak(samples: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Deliberately invalid windows whose last row is the target day: a labelled leakage probe.

    The oldest vector goes and the target date's own vector is appended;
    samples whose target date is not itself an origin are dropped.
    """
    later = samples.select("ticker", F.col("origin_date").alias("target_date"),
                           F.element_at(sequence, -1).alias("_target_vector"))
    joined = samples.join(later, ["ticker", "target_date"])
    shifted = F.concat(F.slice(sequence, 2, F.size(sequence) - 1), F.array("_target_vector"))
    return joined.withColumn("leaked", shifted).drop("_target_vector")
