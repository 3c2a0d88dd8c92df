"""Market-shaped views over the supplied tables (see FIXTURES.md, section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import resample_intraday

# A total order of line items inside one (supplier, day).
TICK_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
# Availability class of each external source.
SOURCE_CLASS = {"1-URGENT": "A", "2-HIGH": "B", "3-MEDIUM": "A", "4-NOT SPECIFIED": "B", "5-LOW": "B"}
SOURCE_ASSET = {"1-URGENT": "INDEX", "2-HIGH": "INDEX", "3-MEDIUM": "VOLATILITY", "4-NOT SPECIFIED": "YIELD",
                "5-LOW": "INDEX"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades: price = extended price per unit."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", *TICK_ORDER)
    return lines.select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.struct(*TICK_ORDER).alias("seq"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per supplier.  Grouping bounds every ticker by the calendar."""
    return ticks(spark, sf).groupBy("ticker", "date").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"))


def intraday(spark: SparkSession, sf: str) -> DataFrame:
    """Events as one-trade bars."""
    value = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("ticker"), "ts", value.alias("open"), value.alias("high"), value.alias("low"),
        value.alias("close"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def intraday_bars(spark: SparkSession, sf: str) -> DataFrame:
    return resample_intraday(intraday(spark, sf), "ts", "seq")


def sector_map(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier -> nation -> region as ticker -> industry -> sector."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (table(spark, sf, "supplier")
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("n_name").alias("industry"),
                    F.col("r_name").alias("sector")))


def ext_series(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as daily external series, one per priority."""
    return (table(spark, sf, "orders")
            .groupBy(F.col("o_orderpriority").alias("source_id"), F.to_date("o_orderdate").alias("source_date"))
            .agg(F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")))


def source_registry(spark: SparkSession) -> DataFrame:
    rows = [(s, SOURCE_CLASS[s], SOURCE_ASSET[s]) for s in SOURCE_CLASS]
    return spark.createDataFrame(rows, "source_id string, availability string, asset_class string")


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Events as dated news items of a user."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("publish_date"), "event_id")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as untidy vendor rows: text prices, repeated days, missing and negative volumes, broken bars."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").alias("Date"),
        F.when(F.col("l_tax") == 0, "n/a").otherwise(price.cast("string")).alias("Open"),
        (price * (F.lit(0.96) + F.col("l_tax"))).alias("High"), (price * (F.lit(1.02) - F.col("l_discount"))).alias("Low"),
        price.alias("Close"),
        F.when(F.col("l_returnflag") == "A", None).when(F.col("l_discount") == 0, -F.col("l_quantity")).otherwise(
            F.col("l_quantity")).alias("Vol"),
        F.struct(*TICK_ORDER, "l_returnflag", "l_linestatus").alias("seq"))
