"""Reading and normalising price bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import number

BAR_COLUMNS = ("date", "open", "high", "low", "close", "volume")
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")

# Accepted header spellings, first match wins.
HEADER_SPELLINGS = {
    "date": ("Date", "date", "Timestamp", "timestamp", "Datetime", "datetime", "Time", "time"),
    "open": ("Open", "open", "OPEN", "o", "O"),
    "high": ("High", "high", "HIGH", "h", "H"),
    "low": ("Low", "low", "LOW", "l", "L"),
    "close": ("Close", "close", "CLOSE", "c", "C"),
    "volume": ("Volume", "volume", "VOLUME", "Vol", "vol", "v", "V"),
}
# Frequency endings of file stems.
FREQUENCY_SUFFIXES = ("_MINUTE", "_1MIN", "_1M", "_INTRADAY", "_MIN")

RAW_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in BAR_COLUMNS])


def as_date(c: Column, kind: T.DataType) -> Column:
    """Calendar day of a date, a timestamp (zone label dropped) or text; bad text is NULL."""
    if isinstance(kind, T.StringType):
        return F.to_date(c.try_cast("timestamp_ntz"))
    return F.to_date(c)


def resolve_headers(df: DataFrame) -> DataFrame:
    """Rename the accepted spellings to canonical names; a missing column is an error."""
    names = set(df.columns)
    found = {target: next((s for s in spellings if s in names), None)
             for target, spellings in HEADER_SPELLINGS.items()}
    missing = sorted(t for t, s in found.items() if s is None)
    if missing:
        raise ValueError(f"no column found for {missing} among {df.columns}")
    return df.withColumnsRenamed({s: t for t, s in found.items() if s != t})


def symbol_of_stem(stem: Column) -> Column:
    """Ticker of a file stem: upper case, without ``_NEW`` and one frequency ending."""
    bare = F.regexp_replace(F.upper(stem), "_NEW$", "")
    return F.regexp_replace(bare, f"({'|'.join(FREQUENCY_SUFFIXES)})$", "")


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.url_decode(F.regexp_replace(name, r"\.[^.]*$", ""))


def label_files(files: DataFrame, label_map: DataFrame | None = None) -> DataFrame:
    """One chosen file per ticker from rows of (path, length).

    ``label_map`` (label, stem) names files stored under another stem.  Among
    files of one ticker a stem without ``_new`` wins, then the largest file.
    """
    stems = files.withColumn("stem", file_stem(F.col("path")))
    if label_map is None:
        labelled = stems.withColumn("ticker", symbol_of_stem(F.col("stem")))
    else:
        lookup = label_map.select(F.upper("stem").alias("_key"), F.col("label").alias("_label"))
        labelled = (stems.join(lookup, F.upper("stem") == F.col("_key"), "left")
                    .withColumn("ticker", F.coalesce("_label", symbol_of_stem(F.col("stem"))))
                    .drop("_key", "_label"))
    preference = F.struct(F.lower("stem").contains("_new").alias("is_new"), (-F.col("length")).alias("neg"),
                          F.col("path").alias("path"))
    return (labelled.groupBy("ticker")
            .agg(F.min_by(F.struct("path", "length"), preference).alias("_f"), F.count(F.lit(1)).alias("n_files"))
            .select("ticker", "_f.path", "_f.length", "n_files"))


def label_map_of(sheet: DataFrame) -> DataFrame:
    """(label, stem) pairs of a file-name map with ``legacy_label`` and ``csv_filename``."""
    label, name = F.trim("legacy_label"), F.trim("csv_filename")
    return sheet.where((label != "") & (name != "")).select(
        label.alias("label"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


def read_bar_files(spark: SparkSession, path: str, label_map: DataFrame | None = None) -> DataFrame:
    """Bars of a folder of per-ticker CSV files, one chosen file per ticker.

    Files are listed without being read; of the chosen ones the header lines come
    to the driver (one line for each ticker) and files with the same header are
    read together by their own names, so spelling and order may differ from file
    to file.  Values are read as text and coerced: a bad number is NULL and not an
    error; rows without a close are dropped.
    """
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("length"), F.col("path").alias("place"))
    chosen = label_files(listed, label_map).join(listed.select("path", "place"), "path").select(
        "path", "ticker", "place").collect()
    if not chosen:
        raise ValueError(f"no files in {path}")
    same_header: dict[tuple[str, ...], list] = {}
    for r in chosen:
        header = spark.read.option("header", True).option("inferSchema", False).csv(r["place"]).columns
        same_header.setdefault(tuple(header), []).append(r)
    parts = []
    for header, rows in same_header.items():
        schema = T.StructType([T.StructField(c.strip().lower(), T.StringType()) for c in header])
        raw = resolve_headers(spark.read.schema(schema).option("header", True).csv([r["place"] for r in rows]))
        tickers = F.broadcast(spark.createDataFrame([(r["path"], r["ticker"]) for r in rows], "path string, ticker string"))
        parts.append(raw.withColumn("path", F.col("_metadata.file_path")).join(tickers, "path").select(
            "ticker", F.col("date").try_cast("timestamp_ntz").alias("date"),
            *[number(F.col(c)).alias(c) for c in PRICE_COLUMNS]))
    return reduce(DataFrame.unionAll, parts).where(F.col("close").isNotNull())


def _one_per_day(df: DataFrame, seq: str, keep: str) -> DataFrame:
    """One row per (ticker, day): the first or last in ingest order.

    An aggregate rather than a window: repeated rows of one day collapse before
    the shuffle, however many there are.
    """
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*PRICE_COLUMNS)
    return (df.groupBy("ticker", "date").agg(pick(row, F.col(seq)).alias("_row"))
            .select("ticker", "date", *[F.col(f"_row.{c}").alias(c) for c in PRICE_COLUMNS]))


def typed_bars(df: DataFrame, seq: str) -> DataFrame:
    """Bars with a DATE and numeric values, before repeated days are settled."""
    kind = df.schema["date"].dataType
    return df.select("ticker", as_date(F.col("date"), kind).alias("date"),
                     *[number(F.col(c)).alias(c) for c in PRICE_COLUMNS], seq).where(F.col("date").isNotNull())


def normalize_daily(df: DataFrame, seq: str) -> DataFrame:
    """Canonical daily bars; the first row of a repeated date stays.  No aggregation of values."""
    return _one_per_day(typed_bars(resolve_headers(df), seq), seq, "first")


def normalize_panel(df: DataFrame, seq: str) -> DataFrame:
    """Panel bars: the last row of a repeated date stays, and only bars with a positive close."""
    lowered = df.withColumnsRenamed({c: c.strip().lower() for c in df.columns if c not in (seq, "ticker")})
    return _one_per_day(typed_bars(lowered, seq), seq, "last").where(F.col("close") > 0)


def canonicalize_vendor(df: DataFrame, seq: str) -> DataFrame:
    """A vendor download reduced to the six bar columns (no dividends, splits or adjusted close)."""
    kept = df.select("ticker", seq, *[F.col(c.capitalize()).alias(c) for c in BAR_COLUMNS])
    return normalize_daily(kept, seq)


def normalize_external(df: DataFrame, source: str = "source_id") -> DataFrame:
    """An external series as (source, source_date, OHLCV); absent value columns become NULL."""
    names = {c.lower(): c for c in df.columns}
    day = next((names[n] for n in ("source_date", "date", "datetime", "timestamp") if n in names), None)
    if day is None:
        raise ValueError(f"no date column among {df.columns}")
    kind = df.schema[day].dataType
    values = [number(F.col(names[c])).alias(c) if c in names else F.lit(None).cast("double").alias(c)
              for c in PRICE_COLUMNS]
    return df.select(source, as_date(F.col(day), kind).alias("source_date"), *values).where(
        F.col("source_date").isNotNull())


def resample_intraday(df: DataFrame, ts: str = "ts", seq: str | None = None) -> DataFrame:
    """Daily bars from intraday ones, by calendar day.

    First present open, highest high, lowest low, last present close, summed
    volume (0.0 when none is present).  ``seq`` breaks ties of equal stamps.
    """
    order = F.col(ts) if seq is None else F.struct(ts, seq)

    def first_present(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), order))

    def last_present(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), order))

    return (df.where(F.col(ts).isNotNull())
            .groupBy("ticker", F.to_date(ts).alias("date"))
            .agg(first_present("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 last_present("close").alias("close"),
                 F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")))
