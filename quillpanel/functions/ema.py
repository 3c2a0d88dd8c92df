"""Recursive moving average without a UDF.

``y0 = x0, y = (1-a)*y_prev + a*x`` unrolls to a sum of ``weight * x * q**age``
with ``q = 1-a``.  Rows are cut into blocks by row number so that the powers
stay inside double range; a block's sum is carried into the next block by one
factor.  The block is long enough that anything older than the block before
weighs less than 1e-17, below the precision of a double.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import series


@dataclass(frozen=True)
class Ema:
    """One average: output name, input column, smoothing, rows skipped before the seed."""

    out: str
    source: str
    alpha: float
    skip: int = 0


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def wilder(n: int) -> float:
    return 1.0 / n


def _block_length(alphas: list[float]) -> int:
    length = max(math.ceil(39.2 / -math.log1p(-a)) for a in alphas)
    if max(-length * math.log1p(-a) for a in alphas) > 690:
        raise ValueError("these smoothing factors are too far apart; average them separately")
    return length


def number_rows(df: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """Add ``_rn``, the row's position in its series."""
    return df.withColumn("_rn", F.row_number().over(series(key, order)))


#: Rows of a block over gaps, if no average decays by more than e^-600 within so many.
GAP_BLOCK, MOST_DECAY = 2_500, 600.0


def add_emas_over_gaps(df: DataFrame, specs: list[Ema], key: str = "ticker", block: int = GAP_BLOCK) -> DataFrame:
    """Add every requested average, carried over missing inputs; ``df`` carries ``_rn`` from :func:`number_rows`.

    The seed is the first present input after the skipped rows.  A present input
    ``d`` rows after the one before it gives ``(q**d * y_prev + a * x) / (q**d + a)``,
    and a missing one leaves the average as it was.

    Each row is an affine map of the average before it.  Inside a block of rows,
    the same for all averages, maps compose by a sum scaled with the decay since
    the block's first input; a row's value is its composed map applied to what
    enters its block, and that is the composition of the maps of whole blocks
    before it, one short list for all averages.  Every window here asks for one
    order, by block and row, so one sort serves them all; the block's number
    stays as a column, so that a second level of averages uses the same sort.
    """
    block = max(1, min(block, *(int(MOST_DECAY / -math.log1p(-s.alpha)) for s in specs)))
    number = f"_blk_{block}"
    if number not in df.columns:
        df = df.withColumn(number, F.floor((F.col("_rn") - 1) / block))
    row, blk = F.col("_rn"), F.col(number)
    whole = Window.partitionBy(key).orderBy(number, "_rn").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, number).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(key).orderBy(number).rangeBetween(Window.unboundedPreceding, -1)

    # Where an input is present, and where the one before it was: the same for all averages of one input.
    inputs = {(s.source, s.skip): f"{s.source}_{s.skip}" for s in specs}
    at = {k: F.col(f"_at_{n}") for k, n in inputs.items()}
    last = {k: F.col(f"_last_{n}") for k, n in inputs.items()}
    df = df.withColumns({f"_at_{n}": F.when((row > skip) & F.col(source).isNotNull(), row)
                         for (source, skip), n in inputs.items()})
    df = df.withColumns({f"_last_{n}": F.last(at[k], ignorenulls=True).over(whole) for k, n in inputs.items()})

    def parts(s: Ema) -> tuple[Column, Column, Column, Column]:
        here, before = at[s.source, s.skip], last[s.source, s.skip]
        return here, before, F.pow(F.lit(1.0 - s.alpha), here - before), F.floor((before - 1) / block) < blk

    # The logarithm of a row's factor, without the power, which a very long gap makes zero.
    fades = {}
    for s in specs:
        here, before, old, opens = parts(s)
        log = (here - before) * math.log1p(-s.alpha) - F.log(old + s.alpha)
        fades[f"_fade_{s.out}"] = F.sum(F.when(opens, 0.0).otherwise(F.coalesce(log, F.lit(0.0)))).over(inside)
        fades[f"_open_{s.out}"] = F.max(F.when(before.isNull() & here.isNotNull(), float("-inf")).when(opens, log)).over(inside)
    df = df.withColumns(fades)
    inner = {}
    for s in specs:
        here, before, old, _ = parts(s)
        weight = F.when(before.isNull(), F.lit(1.0)).otherwise(s.alpha / (old + s.alpha))
        scaled = F.when(here.isNotNull(), weight * F.col(s.source) * F.exp(-F.col(f"_fade_{s.out}")))
        inner[f"_in_{s.out}"] = F.exp(F.col(f"_fade_{s.out}")) * F.coalesce(F.sum(scaled).over(inside), F.lit(0.0))
    df = df.withColumns(inner)

    def keep(s: Ema) -> Column:
        """What enters the block fades by its first input's factor too; before that input it stays as it is."""
        return F.exp(F.col(f"_fade_{s.out}") + F.coalesce(F.col(f"_open_{s.out}"), F.lit(0.0)))

    ends = F.struct(*[c for s in specs for c in (F.col(f"_in_{s.out}"), keep(s).alias(f"_keep_{s.out}"))])
    # Only a full block has one after it.
    df = df.withColumn("_maps", F.collect_list(F.when(row % block == 0, ends)).over(blocks))
    results = {}

    def entering(out: str) -> Column:
        return F.aggregate("_maps", F.lit(0.0), lambda y, m: m[f"_in_{out}"] + m[f"_keep_{out}"] * y)

    for s in specs:
        here, before, *_ = parts(s)
        value = F.when(blk == 0, F.col(f"_in_{s.out}")).otherwise(F.col(f"_in_{s.out}") + keep(s) * entering(s.out))
        results[s.out] = F.when(F.coalesce(here, before).isNotNull(), value)
    df = df.withColumns(results)
    return df.drop("_maps", *fades, *inner, *[f"_{p}_{n}" for n in inputs.values() for p in ("at", "last")])


def add_emas(df: DataFrame, specs: list[Ema], key: str = "ticker", block: int | None = None) -> DataFrame:
    """Add every requested average; ``df`` carries ``_rn`` from :func:`number_rows`.

    An input that is missing after the seed leaves the average undefined from
    there on: NULL, rather than a value that ignores the gap.  For series that
    may have gaps, see :func:`add_emas_over_gaps`.
    """
    block = block or _block_length([s.alpha for s in specs])
    pos = (F.col("_rn") - 1) % block
    blk = F.floor((F.col("_rn") - 1) / block).cast("int")
    df = df.withColumn("_pos", pos).withColumn("_blk", blk)
    inside = Window.partitionBy(key, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_blk").rangeBetween(-1, -1)

    part = {}
    for s in specs:
        q = 1.0 - s.alpha
        weight = F.when(F.col("_rn") == 1 + s.skip, F.lit(1.0)).when(F.col("_rn") > 1 + s.skip, F.lit(s.alpha))
        scaled = weight * F.col(s.source) * F.pow(F.lit(q), -F.col("_pos"))
        part[f"_in_{s.out}"] = F.pow(F.lit(q), F.col("_pos")) * F.sum(scaled).over(inside)
    df = df.withColumns(part)
    carried = {}
    for s in specs:
        end = F.max(F.when(F.col("_pos") == block - 1, F.col(f"_in_{s.out}"))).over(before)
        carried[f"_end_{s.out}"] = end
    df = df.withColumns(carried)
    result = {}
    so_far = Window.partitionBy(key).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    for s in specs:
        q = 1.0 - s.alpha
        whole = F.bool_and((F.col("_rn") <= s.skip) | F.col(s.source).isNotNull()).over(so_far)
        carry = F.pow(F.lit(q), F.col("_pos") + 1) * F.coalesce(F.col(f"_end_{s.out}"), F.lit(0.0))
        result[s.out] = F.when((F.col("_rn") > s.skip) & whole, F.col(f"_in_{s.out}") + carry)
    df = df.withColumns(result)
    return df.drop("_pos", "_blk", *part, *carried)
