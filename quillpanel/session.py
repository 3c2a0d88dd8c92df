"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; a cluster brings its own and never calls this."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillpanel")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for stored intermediates: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may leave that unset; it then gets a
    folder of its own, removed when Python ends.  On a cluster a folder of one
    machine would lose rows, so an unset name is an error there.
    """
    key = "spark.checkpoint.dir"
    configured = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if configured:
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {key} to a folder that all executors share (master is {master})")
        folder = tempfile.mkdtemp(prefix="quillpanel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def moved_rows_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files behind: Spark removes them when a query ends.

    Without it they stay until the driver happens to collect garbage, so a job of
    many steps holds the moved rows of all of them.  Not for a frame that is run again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_table(spark: SparkSession) -> str:
    """A fresh path for a stored intermediate."""
    return f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """The frame written as Parquet and read back; what was moved for it is removed."""
    spark = df.sparkSession
    with moved_rows_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_table(df: DataFrame) -> Iterator[DataFrame]:
    """The frame stored for the steps inside only: nothing that reads it may be run afterwards."""
    spark = df.sparkSession
    path = new_table(spark)
    try:
        yield write_table(df, path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
