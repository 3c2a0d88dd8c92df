"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import moved_rows_removed, new_table, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z only and turns the six ASCII white-space characters into blanks.
LOWER_AND_BLANK = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the cluster's shared folder and read back.

    Lineage ends here and the values are fixed: a lost executor cannot change
    what later passes see, and a join after it can split a hot key.
    """
    return write_table(df, new_table(df.sparkSession))


def text_of(name: str = "text") -> Column:
    """A text column with NULL read as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(name: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a NULL id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("null"))), F.lit(modulus))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8."""
    return text.translate(LOWER_AND_BLANK).split()


def texts_in(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each value, NULL as empty, one at a time."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def bits_for(rows: int, per_row: int, most: int) -> int:
    """A power of two with about ``per_row`` bits for each row, between 2^16 and ``most``."""
    return int(min(most, max(1 << 16, 1 << max(0, rows * per_row - 1).bit_length())))


def repeated_cells(hashes: DataFrame, column: str, bits: int, at_least: int = 2) -> DataFrame:
    """The bitmap of cells hit by ``at_least`` rows: one row (word, bits) for each non-empty 64-bit word.

    ``column`` holds 64-bit hashes; a hash falls into cell ``hash mod bits``, so
    the table has at most ``bits / 64`` rows, however many rows there are.  A
    value that occurs often enough always finds its cell set; others seldom do.
    Counts are summed before the shuffle.
    """
    cell = F.pmod(F.col(column), F.lit(bits)).alias("cell")
    return (hashes.where(F.col(column).isNotNull()).groupBy(cell).agg(F.count(F.lit(1)).alias("hits"))
            .where(F.col("hits") >= at_least)
            .groupBy(F.shiftright("cell", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS int))")).alias("bits")))


def bitmap_array(cells: DataFrame, bits: int) -> np.ndarray:
    """The bitmap as 64-bit words on the driver: ``bits / 8`` bytes, a bound that does not grow with the data."""
    out = np.zeros(max(1, bits // 64), dtype=np.uint64)
    with moved_rows_removed(cells.sparkSession):
        got = cells.select("word", "bits").toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def bitmap_test(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each signed 64-bit hash falls into a set cell (same cells as ``repeated_cells``)."""
    cell = hashes.astype(np.int64) % np.int64(len(bitmap) * 64)
    word = bitmap[cell >> 6]
    return (word >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1


def give_back() -> None:
    """A worker's free memory goes back to the machine; workers live on beside other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere freed pages go back by themselves
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task, with ``give_back`` at its end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


@contextmanager
def arrow_rows(spark: SparkSession, most: int = 1_024):
    """Actions inside send at most so many rows at a time to the workers: whole texts of many rows would fill both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class TwoGenerations:
    """A cache of bounded size: when the young generation is full it becomes the old one."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def wanted(self, keys: set) -> set:
        """Make every known key young; return the others."""
        if len(self.young) + len(keys) > self.entries:
            self.young, self.old = {}, self.young
        missing = keys.difference(self.young)
        for key in missing.intersection(self.old):
            self.young[key] = self.old[key]
        return missing.difference(self.young)


def text_slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, one row at least, so that memory stays bounded."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(
        zero_copy_only=False), dtype=np.int64)
    group = np.cumsum(lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def without(docs: DataFrame, gone: DataFrame, id_col: str, most_cells: int = 1 << 27) -> DataFrame:
    """The documents whose id is not among ``gone`` (a stored table of one column with the same name).

    Only documents that a bitmap of the ids (at most ``most_cells`` / 8 bytes)
    cannot rule out are shuffled; the others pass straight through.
    """
    bits = bits_for(gone.count(), 16, most_cells)
    key = F.xxhash64(F.col(f"`{id_col}`"))
    held = docs.sparkSession.sparkContext.broadcast(
        bitmap_array(repeated_cells(gone.select(key.alias("key")), "key", bits, 1), bits))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(bitmap_test(held.value, keys.to_numpy()))

    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc"), maybe(key).alias("maybe"))
    left = rows.where("maybe").alias("r").join(
        gone.select(F.col(f"`{id_col}`").alias("id")).alias("g"),
        F.col(f"r.doc.`{id_col}`").eqNullSafe(F.col("g.id")), "left_anti")
    return rows.where("NOT maybe").select("doc.*").unionAll(left.select("doc.*"))
