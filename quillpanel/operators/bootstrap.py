"""Moving-block bootstrap over dates.

A replicate draws blocks of consecutive dates with replacement; overlapping
holding periods stay together, unlike in a row-by-row resample.  Draws come
from a hash of (seed, cell, replicate, block), so they repeat on any cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_where, ratio
from ..plans.skew import groups_fit, sliced
from .splits import unit_hash

BLOCK = 21
REPLICATES = 400
SEED = 42
# Score rows handled by one call of the area helper.
AREA_ROWS = 250_000


def _dates(pred: DataFrame, cells: list[str], date: str) -> DataFrame:
    """Position of each date in its cell and the number of dates (one row per date)."""
    days = pred.select(*cells, date).distinct()
    return days.withColumns({
        "_d": F.row_number().over(Window.partitionBy(*cells).orderBy(date)) - 1,
        "_days": F.count(F.lit(1)).over(Window.partitionBy(*cells))})


def draws(days: DataFrame, cells: list[str], block: int = BLOCK, replicates: int = REPLICATES, seed: int = SEED
          ) -> DataFrame:
    """(cell, replicate, date position) once per draw; as many draws as dates.

    Cells with fewer dates than a block (or than two) have none.
    """
    sizes = days.groupBy(*cells).agg(F.max("_days").alias("_days")).where(F.col("_days") >= max(2, block))
    blocks = F.ceil(F.col("_days") / block).cast("int")
    df = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    df = df.withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    u = unit_hash(seed, *[F.col(c) for c in cells], F.col("replicate"), F.col("_b"))
    start = F.floor(u * (F.col("_days") - block + 1)).cast("int")
    length = F.least(F.lit(block), (F.col("_days") - F.col("_b") * block).cast("int"))
    return df.withColumns({"_s": start, "_l": length}).select(
        *cells, "replicate", F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_l") - 1)).alias("_d"))


def _interval(values: DataFrame, cells: list[str], names: list[str]) -> DataFrame:
    """Mean, deviation and 95 % interval over replicates (a fixed number of rows per cell)."""
    out = []
    for n in names:
        out += [F.avg(n).alias(f"{n}_mean"), F.stddev_samp(n).alias(f"{n}_std"),
                F.percentile(n, F.lit(0.025)).alias(f"{n}_low"), F.percentile(n, F.lit(0.975)).alias(f"{n}_high"),
                F.count(n).alias(f"{n}_replicates")]
    return values.groupBy(*cells).agg(*out)


def replicate_scores(pred: DataFrame, cells: list[str], date: str = "origin_date", block: int = BLOCK,
                     replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Accuracy, balanced accuracy and Brier of every replicate.

    Predictions are summed per date first, so the work is replicates x dates,
    not replicates x predictions.
    """
    days = _dates(pred, cells, date)
    p, y = F.col("p_up") >= 0.5, F.col("y_true") == 1
    err = F.col("p_up") - F.col("y_true")
    daily = pred.groupBy(*cells, date).agg(
        count_where(p & y).alias("tp"), count_where(p & ~y).alias("fp"), count_where(~p & ~y).alias("tn"),
        count_where(~p & y).alias("fn"), F.sum(err * err).alias("sq"))
    daily = daily.join(days.drop("_days"), [*cells, date])
    drawn = draws(days, cells, block, replicates, seed).join(daily, [*cells, "_d"])
    sums = drawn.groupBy(*cells, "replicate").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "sq")])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    two = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    up = ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    down = ratio(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    return sums.where(two).select(
        *cells, "replicate", ((F.col("tp") + F.col("tn")) / n).alias("accuracy"),
        ((up + down) / 2).alias("balanced_accuracy"), (F.col("sq") / n).alias("brier"))


def block_bootstrap(pred: DataFrame, cells: list[str], date: str = "origin_date", block: int = BLOCK,
                    replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    scores = replicate_scores(pred, cells, date, block, replicates, seed)
    return _interval(scores, cells, ["accuracy", "balanced_accuracy", "brier"])


def _weights(text: str, days: int, block: int, replicates: int, seed: int) -> np.ndarray:
    """Draw counts (replicate x date) of one cell: the same hash as :func:`draws`."""
    out = np.zeros((replicates, days), dtype=np.int64)
    for r in range(replicates):
        for b in range(-(-days // block)):
            digest = hashlib.md5(f"{seed}|{text}{r}|{b}".encode()).hexdigest()[:8]
            start = int(int(digest, 16) / 4294967296.0 * (days - block + 1))
            out[r, start: start + min(block, days - b * block)] += 1
    return out


def _area_parts(block: int, replicates: int, seed: int, cells: list[str]):
    """Per slice of scores: pair sums inside it and its totals, one value per replicate."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p_up", kind="stable")
        text = "".join(f"{rows[f'_text_{c}'].iat[0]}|" for c in cells)
        w = _weights(text, int(rows["_days"].iat[0]), block, replicates, seed)
        inner = np.zeros(replicates)
        below = np.zeros(replicates, dtype=np.int64)
        positives = np.zeros(replicates, dtype=np.int64)
        p, d = rows["p_up"].to_numpy(), rows["_d"].to_numpy()
        pos, neg = rows["_pos"].to_numpy(), rows["_neg"].to_numpy()
        edges = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        step = 2048
        for lo in range(0, len(edges), step):
            first = edges[lo]
            last = edges[lo + step] if lo + step < len(edges) else len(p)
            cuts = edges[lo: lo + step] - first
            span = w[:, d[first:last]]
            up = np.add.reduceat(span * pos[first:last], cuts, axis=1)
            down = np.add.reduceat(span * neg[first:last], cuts, axis=1)
            under = below[:, None] + np.cumsum(down, axis=1) - down
            inner += (up * (under + down / 2.0)).sum(axis=1)
            below += down.sum(axis=1)
            positives += up.sum(axis=1)
        out = pd.DataFrame({"replicate": np.arange(replicates), "_inner": inner, "_p": positives, "_n": below})
        for c, v in zip([*cells, "_slice"], key):
            out[c] = v
        return out

    return run


def replicate_areas(pred: DataFrame, cells: list[str], date: str = "origin_date", block: int = BLOCK,
                    replicates: int = REPLICATES, seed: int = SEED, slice_rows: int = AREA_ROWS) -> DataFrame:
    """Area under the curve of every replicate.

    Scores are merged per (cell, score, date) and cut into score-ordered slices
    of bounded size.  A slice returns, per replicate, the pairs inside it and
    its totals of positives and negatives; pairs between slices are positives
    times the negatives of earlier slices.  Predictions are never multiplied
    by the number of replicates.
    """
    days = _dates(pred, cells, date).where(F.col("_days") >= max(2, block))
    merged = pred.groupBy(*cells, date, "p_up").agg(
        F.sum(F.col("y_true").cast("bigint")).alias("_pos"), F.sum((1 - F.col("y_true")).cast("bigint")).alias("_neg"))
    rows = merged.join(days, [*cells, date]).select(*cells, "p_up", "_d", "_days", "_pos", "_neg")
    if groups_fit(rows, cells, slice_rows):
        cut = rows.withColumn("_slice", F.lit(0))
    else:
        cut = sliced(rows, cells, [F.col("p_up").asc()], slice_rows)
    for c in cells:
        cut = cut.withColumn(f"_text_{c}", F.col(c).cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in cells)
    schema = f"replicate int, _inner double, _p bigint, _n bigint{', ' + kinds if kinds else ''}, _slice int"
    parts = cut.groupBy(*cells, "_slice").applyInPandas(_area_parts(block, replicates, seed, cells), schema)
    earlier = Window.partitionBy(*cells, "replicate").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    out = parts.groupBy(*cells, "replicate").agg(
        F.sum(F.col("_inner") + F.col("_p") * F.col("_before")).alias("_u"), F.sum("_p").alias("_p"),
        F.sum("_n").alias("_n"))
    return out.select(*cells, "replicate", ratio(F.col("_u"), F.col("_p").cast("double") * F.col("_n")).alias(
        "roc_auc")).where(F.col("roc_auc").isNotNull())


def block_bootstrap_area(pred: DataFrame, cells: list[str], date: str = "origin_date", block: int = BLOCK,
                         replicates: int = REPLICATES, seed: int = SEED, slice_rows: int = AREA_ROWS) -> DataFrame:
    areas = replicate_areas(pred, cells, date, block, replicates, seed, slice_rows)
    return _interval(areas, cells, ["roc_auc"])


