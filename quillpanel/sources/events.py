"""Tab-delimited event rows without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 61


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of event files, with the file they came from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("archive"))


def split_rows(lines: DataFrame, width: int = WIDTH, sep: str = "\t") -> DataFrame:
    """Add ``fields``; NULL for a ragged row, that is one without exactly ``width`` fields."""
    parts = F.split("value", sep, -1)
    return lines.withColumn("_parts", parts).withColumn(
        "fields", F.when(F.size("_parts") == width, F.col("_parts"))).drop("_parts")


def row_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Kept and rejected rows."""
    return rows.groupBy(*by).agg(F.count_if(F.col("fields").isNotNull()).alias("kept"),
                                 F.count_if(F.col("fields").isNull()).alias("ragged"))


def kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("fields").isNotNull()).drop("value")
