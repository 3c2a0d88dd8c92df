"""Materialised tables: feature store, target cache, ledgers, reports, manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401 - used as pa.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import assert_boundary
from ..session import moved_rows_removed

# The tables of a feature store.
STORE_TABLES = ("stock_features", "market_context", "sector_context", "cross_sectional_features", "targets")
TRUE_WORDS = ("true", "1", "yes")


class LedgerError(ValueError):
    """A ledger row breaks the ledger's rules."""


def fingerprint(settings: dict) -> str:
    """Stable hash of everything a stored table depends on."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


#: Buckets of a stored table; tables of one store have the same number, so that joins on their key need no exchange.
BUCKETS = 32
#: Columns that name the day of a row.
DAYS = ("date", "origin_date")


def _keys(columns: list[str]) -> list[str]:
    """Ticker and day; a table without a ticker is not cut into buckets."""
    return [c for c in ("ticker", *DAYS) if c in columns] if "ticker" in columns else []


def _table_name(place: str) -> str:
    return "store_" + hashlib.md5(place.encode()).hexdigest()


def write_store(tables: dict[str, DataFrame], root: str, settings: dict, buckets: int = BUCKETS) -> str:
    """Write the store's tables and its fingerprint; reuse an equal store.

    Tables with a ticker are bucketed and sorted by (ticker, day): a join of them
    on that key reads matching buckets and shuffles nothing.  A bucket is written
    by one task, and a day of a ticker is a row, so no bucket is heavy.  A changed
    store gets a folder of its own; the fingerprint, written last, names it, so a
    broken write is never taken for a store.
    """
    missing = [t for t in STORE_TABLES if t not in tables]
    if missing:
        raise ValueError(f"the store lacks {missing}")
    spark = next(iter(tables.values())).sparkSession
    key = fingerprint({**settings, "columns": {t: tables[t].columns for t in STORE_TABLES}, "buckets": buckets})
    if stored_fingerprint(spark, root) == key:
        return key
    for name in STORE_TABLES:
        df, place = tables[name], f"{root}/{key}/{name}"
        keys = _keys(df.columns)
        if not keys:
            order = [c for c in DAYS if c in df.columns]
            with moved_rows_removed(spark):
                df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(place)
            continue
        rows = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
        with moved_rows_removed(spark):
            rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", place).option("compression", "zstd").mode(
                "overwrite").saveAsTable(_table_name(place))
    spark.createDataFrame([(key, buckets, json.dumps(settings, sort_keys=True, default=str))],
                          "fingerprint string, buckets int, settings string").coalesce(1).write.mode("overwrite").parquet(f"{root}/fingerprint")
    return key


def _stored(spark: SparkSession, root: str):
    try:
        return spark.read.parquet(f"{root}/fingerprint").first()
    except AnalysisException:
        return None


def stored_fingerprint(spark: SparkSession, root: str) -> str | None:
    """Fingerprint of a complete store, or None where there is none."""
    found = _stored(spark, root)
    return found["fingerprint"] if found else None


def load_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The store's tables; in a session that has not written them they are first entered in its catalogue."""
    found = _stored(spark, root)
    if found is None:
        raise FileNotFoundError(f"no complete store at {root}")
    out = {}
    for t in STORE_TABLES:
        place = f"{root}/{found['fingerprint']}/{t}"
        files = spark.read.parquet(place)
        keys = _keys(files.columns)
        if not keys:
            out[t] = files
            continue
        name, by = _table_name(place), ", ".join(f"`{k}`" for k in keys)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                  f"INTO {found['buckets']} BUCKETS LOCATION '{place}'")
        out[t] = spark.table(name)
    return out


def store_panel(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables of a store side by side, a row for each of its (ticker, date); equal names are kept once.

    The market's table has a row a date and is broadcast; the others are bucketed alike.
    """
    panel = tables["stock_features"]
    for name in ("sector_context", "cross_sectional_features", "targets"):
        side = tables[name]
        if "origin_date" in side.columns:
            side = side.withColumnRenamed("origin_date", "date")
        fresh = [c for c in side.columns if c not in panel.columns]
        panel = panel.join(side.select("ticker", "date", *fresh), ["ticker", "date"], "left")
    market = tables["market_context"]
    return panel.join(F.broadcast(market.select("date", *[c for c in market.columns if c not in panel.columns])), "date", "left")


def write_targets(targets: DataFrame, path: str) -> None:
    """Horizon targets partitioned by horizon; rows of a horizon are spread over the tasks by ticker."""
    targets.repartitionByRange("horizon", "ticker", "origin_date").write.mode("overwrite").partitionBy("horizon").parquet(path)


def load_targets(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """Stored targets, refused when any date lies past the boundary."""
    return assert_boundary(spark.read.parquet(path), ["origin_date", "target_end_date"], boundary, where="target cache")


def append_ledger(rows: DataFrame, path: str, columns: tuple[str, ...], forbidden: tuple[str, ...]) -> None:
    """Append rows with exactly the ledger's columns, as text; absent ones are empty.

    A row that claims an evaluation listed in ``forbidden`` is refused, and the
    whole append with it; the column is stored as "false".
    """
    unknown = [c for c in rows.columns if c not in columns]
    if unknown:
        raise LedgerError(f"unknown ledger columns {unknown}")
    full = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns
                         else F.lit("").alias(c) for c in columns])
    claims = F.lit(False)
    for c in forbidden:
        claims = claims | F.lower(F.trim(c)).isin(*TRUE_WORDS)
    if not full.where(claims).isEmpty():
        raise LedgerError(f"a row claims {' or '.join(forbidden)}")
    full.withColumns({c: F.lit("false") for c in forbidden}).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ledger_summary(ledger: DataFrame, forbidden: str, epoch: str = "best_epoch") -> DataFrame:
    """Counts over a ledger: rows, variants, folds, seeds, forbidden claims, latest best epoch."""
    return ledger.agg(
        F.count(F.lit(1)).alias("total_experiments"), F.count_distinct(F.when(F.col("variant") != "", F.col("variant"))).alias("variants"),
        F.count_distinct(F.when(F.col("fold") != "", F.col("fold"))).alias("folds"),
        F.count_distinct(F.when(F.col("seed") != "", F.col("seed"))).alias("seeds"),
        F.count_if(F.lower(forbidden).isin(*TRUE_WORDS)).alias("forbidden_claims"),
        F.max(F.col(epoch).try_cast("double")).cast("int").alias("max_best_epoch"))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A result table as CSV (with header, gzip) or JSON lines; written by the tasks, not by the driver."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown report kind {kind!r}")


#: Local files above ``WHOLE`` bytes, and others too large for a row of ``binaryFile``, are read ``PIECE`` bytes at a time.
WHOLE, PIECE, LARGEST_ROW = 64 << 20, 8 << 20, (1 << 31) - 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size in zip(*(c.to_pylist() for c in batch.columns)):
            if path.startswith("file:"):
                files, place = pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
            else:
                files, place = pa.fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with files.open_input_stream(place, compression=None) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "sha256": [digest.hexdigest()]})


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and SHA-256 of every file below a path; files are hashed by the tasks.

    A file's bytes go through its hash in order, so one task reads the whole of
    it, but never holds a large one: only small files become rows.  A file of
    2 GB or more needs a file system that pyarrow knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    local = place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    most = WHOLE if local else LARGEST_ROW
    small = files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most).select("path", "length").mapInArrow(_digests, small.schema)
    return small.unionAll(large).withColumn("path", F.element_at(F.split("path", "/"), -1)).withColumnRenamed("path", "file")


def manifest_hash(manifest: DataFrame) -> DataFrame:
    """One fingerprint of a set of files, whatever their order.

    Each line's hash is taken as a number and the numbers are summed, so the
    set of files is never gathered in one place.
    """
    line = F.concat_ws(",", "file", F.col("bytes").cast("string"), "sha256")
    number = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    out = manifest.agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("total_bytes"), F.sum(number).alias("_s"))
    return out.select("n_files", "total_bytes", F.sha2(F.concat_ws(
        ",", F.col("n_files").cast("string"), F.col("_s").cast("decimal(38,0)").cast("string")), 256).alias("fingerprint"))
