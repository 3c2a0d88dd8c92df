"""Skew-safe ordered work inside groups that may be arbitrarily large.

A date, a source or a metric cell can hold any share of the rows, so sorting a
whole group in one task is allowed only after a check.  Each function here has
two exact forms with one result, in which NULL is a group like any other:

* every group below ``MAX_GROUP_ROWS`` (checked by one grouped count): a window;
* otherwise rows are range-partitioned on (group, order), so that a large group
  spreads over many slices; slice totals are summed across slices, and each
  slice adds the total of the slices before it.  Equal values are merged into
  one weighted row first, so a heavily repeated value cannot fill a slice.

The slice number is fixed in a written table before it is used twice, so a lost
executor cannot change it between the two uses.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_table, write_table

#: Rows that one task may sort; override per session with this setting.
MAX_GROUP_ROWS = 2_000_000
GROUP_ROWS_KEY = "quillpanel.maxGroupRows"


def max_group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(GROUP_ROWS_KEY, str(MAX_GROUP_ROWS)))


def join_groups(df: DataFrame, per_group: DataFrame, keys: list[str], how: str = "inner",
                exact: tuple[str, ...] = ()) -> DataFrame:
    """Join on group keys with NULL as a key like any other; ``exact`` columns join by plain equality."""
    named = per_group.select(*[F.col(c).alias(f"_j_{c}") if c in keys or c in exact else F.col(c)
                               for c in per_group.columns])
    matches = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys] + [F.col(k) == F.col(f"_j_{k}") for k in exact]
    return df.join(named, reduce(lambda a, b: a & b, matches), how).drop(*[f"_j_{k}" for k in (*keys, *exact)])


def groups_fit(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """Whether every group is small enough for one task (runs one grouped count)."""
    limit = limit or max_group_rows(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.where(F.col("_n") > limit).isEmpty()


def frozen(df: DataFrame) -> DataFrame:
    """The frame written as a table to the shared checkpoint folder and read back.

    Cuts lineage and fixes the values, so a lost executor cannot change what a
    later pass sees.  Parquet keeps column pruning and real sizes for the
    passes that follow, which a serialised checkpoint does not.
    """
    return write_table(df, new_table(df.sparkSession))


#: Rows of a task of ``spread``, about.
TASK_ROWS = 250_000


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows dealt out by their keys to as many tasks as there are rows for.

    A grouped step on these keys, or on more columns, takes place where the rows
    are, so what a task holds does not grow with the table.
    """
    rows = frozen(df)
    return rows.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)), *keys)


class Settler:
    """Fixes the parameter table of an iteration after each step.

    With up to ``limit`` rows (one per cell, counted once at the start) a step
    is one job: its rows come to the driver and go out again as a broadcast
    table.  A larger table is stored and joined by shuffle instead.
    """

    def __init__(self, cells: DataFrame, limit: int = 10_000):
        self.small = cells.count() <= limit

    def __call__(self, df: DataFrame, done: str | None = None) -> tuple[DataFrame, bool]:
        """The fixed table and whether its ``done`` column holds everywhere."""
        if not self.small:
            fixed = frozen(df)
            return fixed, done is not None and fixed.where(~F.col(done)).isEmpty()
        rows = df.collect()
        local = df.sparkSession.createDataFrame(rows, df.schema)
        return F.broadcast(local.coalesce(1)), done is not None and all(r[done] for r in rows)


def sliced(df: DataFrame, keys: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """Add ``_slice``: ordered ranges of (keys, order), each a fraction of the task limit."""
    limit = limit or max_group_rows(df)
    rows = df.count()
    parts = max(2, -(-4 * rows // limit))
    keyed = [F.col(k).asc() for k in keys]
    return frozen(df.repartitionByRange(parts, *keyed, *order).withColumn("_slice", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column],
            fits: bool | None = None) -> DataFrame:
    """Add, for each entry of ``sums``, its total over the rows before this one in the group.

    ``order`` must be total within a group (or tied rows interchangeable).
    """
    fits = groups_fit(df, keys) if fits is None else fits
    if fits:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})

    cut = sliced(df, keys, order)
    per_slice = cut.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = join_groups(local, offsets, [*keys, "_slice"])
    return joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop(
        "_slice", *[f"_o_{n}" for n in sums])


def previous_value(df: DataFrame, keys: list[str], order: str, name: str, fits: bool | None = None) -> DataFrame:
    """Add the next smaller ``order`` value of the group; values must be distinct within it."""
    fits = groups_fit(df, keys) if fits is None else fits
    if fits:
        return df.withColumn(name, F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))
    cut = sliced(df, keys, [F.col(order).asc()])
    last = cut.groupBy(*keys, "_slice").agg(F.max(order).alias("_last"))
    earlier = last.select(*keys, "_slice", F.max("_last").over(
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    local = cut.withColumn(name, F.lag(order).over(Window.partitionBy(*keys, "_slice").orderBy(order)))
    return join_groups(local, earlier, [*keys, "_slice"]).withColumn(name, F.coalesce(name, "_before")).drop(
        "_slice", "_before")


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos",
              fits: bool | None = None) -> DataFrame:
    """Add the 0-based position of every row within its group."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, fits)


def _ranked_groups(df: DataFrame, keys: list[str], columns: dict[str, str], percent: bool) -> DataFrame:
    """Average ranks of several columns of groups that fit one task.

    Rows are sorted once, by group; each column's values are then ordered apart
    from their rows, where a window for each column would sort, and spill, whole rows.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in columns.values()]])

    def run(group: pa.Table) -> pa.Table:
        for src, name in columns.items():
            values = group.column(src).combine_chunks()
            present = values.is_valid().to_numpy(zero_copy_only=False)
            _, place, ties = np.unique(values.drop_null().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            rank = (np.cumsum(ties) - ties + 1) + (ties - 1) / 2.0
            if percent:
                rank = rank / max(len(place), 1)
            out = np.zeros(len(present))
            out[present] = rank[place]
            group = group.append_column(name, pa.array(out, mask=~present))
        return group

    return df.groupBy(*keys).applyInArrow(run, schema)


def average_ranks(df: DataFrame, keys: list[str], columns: dict[str, str], fits: bool | None = None,
                  percent: bool = True) -> DataFrame:
    """Add ``columns[source]`` = average-tie rank of ``source`` among present values of the group.

    With ``percent`` the rank is divided by the number of present values.
    """
    fits = groups_fit(df, keys) if fits is None else fits
    if fits and len(columns) > 1 and not any(n in df.columns for n in columns.values()) and all(
            isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.IntegralType)) for c in columns):
        return _ranked_groups(df, keys, columns, percent)
    if fits:
        whole = Window.partitionBy(*keys)
        out = {}
        for src, name in columns.items():
            # NULLs sort last, so the ranks of present values do not count them.
            rank = F.rank().over(whole.orderBy(F.col(src).asc_nulls_last()))
            ties = F.count(src).over(Window.partitionBy(*keys).orderBy(F.col(src).asc_nulls_last())
                                     .rangeBetween(Window.currentRow, Window.currentRow))
            value = rank + (ties - 1) / 2.0
            if percent:
                value = value / F.count(src).over(whole)
            out[name] = F.when(F.col(src).isNotNull(), value)
        return df.withColumns(out)

    for src, name in columns.items():
        distinct = df.where(F.col(src).isNotNull()).groupBy(*keys, src).agg(F.count(F.lit(1)).alias("_c"))
        ranked = running(distinct, keys, [F.col(src).asc()], {"_below": F.col("_c")}, fits=False)
        value = F.col("_below") + (F.col("_c") + 1) / 2.0
        ranked = ranked.withColumn(name, value).select(*keys, src, name)
        if percent:
            sizes = df.groupBy(*keys).agg(F.count(src).alias("_size"))
            ranked = join_groups(ranked, sizes, keys).withColumn(name, F.col(name) / F.col("_size")).drop("_size")
        df = join_groups(df, ranked, keys, "left", exact=(src,))
    return df


@F.arrow_udf(T.LongType())
def _sortable(values: pa.Array) -> pa.Array:
    """The bits of a double as a whole number in the same order; both zeros are one."""
    bits = (values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).view(np.int64)
    return pa.array(bits ^ (bits >> 63 & np.int64((1 << 63) - 1)))


#: Bits of a value that each histogram of a selection resolves, highest first: at most 2^22 buckets.
DIGITS = (21, 21, 22)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: Column | None = None,
              fits: bool | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group that has a value.

    A distributed selection, the same for groups of every size: histograms of the
    highest bits of all values, then, only of rows in buckets that hold a wanted
    rank, of the next bits, until the bits are all known.  Counts are added up
    before they are shuffled, and a group has at most 2^22 buckets, so neither its
    size nor a value that fills it matters.  ``weight`` is an integer repetition
    count; rows without one, or with less than 1, do not count.  ``fits`` is taken
    as by the other functions here and changes nothing: there is one form.
    """
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, weight, fits).drop("_all")
    freq = F.lit(1) if weight is None else weight
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), freq.cast("bigint").alias("_w")).where(
        F.col("_v").isNotNull() & (F.col("_w") > 0))
    left, digits = 64, {}
    for i, width in enumerate(DIGITS):
        left -= width
        cut = F.shiftright("_s", left)
        digits[f"_d{i}"] = cut if i == 0 else cut.bitwiseAND(F.lit((1 << width) - 1))
    # Three passes read these rows.
    rows = frozen(rows.withColumn("_s", _sortable("_v")).select(*keys, "_v", "_w", *[c.alias(n) for n, c in digits.items()]))

    def holds(place: Column) -> Column:
        """Whether a bucket of ``_c`` rows after ``_base`` smaller ones has the row of that rank."""
        return (place >= F.col("_base")) & (place < F.col("_base") + F.col("_c"))

    places = [side(F.lit(p) * (F.col("_size") - 1)) for p in probs.values() for side in (F.floor, F.ceil)]
    found, known = None, list(keys)
    for d in digits:
        within = rows if found is None else join_groups(rows, found, known)
        carried = [] if found is None else ["_size", "_base"]
        counts = within.groupBy(*known, d, *carried).agg(F.sum("_w").alias("_c"), F.min("_v").alias("_v"))
        whole = Window.partitionBy(*known)
        if found is None:
            counts = counts.withColumns({"_size": F.sum("_c").over(whole), "_base": F.lit(0).cast("bigint")})
        counts = counts.withColumn("_base", F.col("_base") + F.sum("_c").over(whole.orderBy(d)) - F.col("_c"))
        known.append(d)
        found = counts.where(reduce(lambda a, b: a | b, [holds(p) for p in places]))
        if d == "_d0":
            # Stored, so that the planner knows its size and need not move all rows to meet a small table.
            found = frozen(found.select(*known, "_size", "_base"))
        elif d != list(digits)[-1]:
            found = found.select(*known, "_size", "_base")
    got = found.groupBy(*keys, "_size").agg(*[F.max(F.when(holds(p), F.col("_v"))).alias(f"_{i}") for i, p in enumerate(places)])
    out = []
    for i, (n, p) in enumerate(probs.items()):
        lo, hi, h = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}"), F.lit(p) * (F.col("_size") - 1)
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(n))
    return got.select(*keys, *out)


def with_date_table(df: DataFrame, per_date: DataFrame, on: str = "date", how: str = "left") -> DataFrame:
    """Join a table of one row per date.

    ``per_date`` must be grouped by a DATE column alone: such a table has at
    most one row per calendar day (36,525 a century), so it is broadcast and
    the large side is not moved and cannot skew.
    """
    return df.join(F.broadcast(per_date), on, how)
