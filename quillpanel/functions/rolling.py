"""Ordered windows over one security's rows.

A daily panel holds at most one row per (ticker, date), which the normalisers
in ``sources.bars`` establish by grouping, not by a window.  A ticker's series
is therefore never longer than the calendar (about 36,500 rows a century),
however many raw rows the ticker had, so a window partitioned by ticker is
bounded.  Cross-sections by date have no such bound and never use a plain
unbounded window: see ``plans.skew``.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def trailing(n: int, key: str = "ticker", order: str = "date") -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return series(key, order).rowsBetween(-(n - 1), 0)


def full(agg, x: Column, w: WindowSpec, n: int) -> Column:
    """Aggregate that stays NULL until the window holds n present values."""
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


class Rolled:
    """Trailing aggregates that several formulas share, each planned once.

    ``gaps`` names the inputs that may be NULL in the middle of a series; these
    are counted.  Any other input is present from row ``1 + skip`` on, so its
    window is full once the row number says so, which saves a second sliding
    aggregate per window.
    """

    def __init__(self, skips: dict[str, int], gaps: tuple[str, ...] = (), row: str = "_rn"):
        self.skips, self.gaps, self.row, self.columns = skips, gaps, row, {}

    def __call__(self, kind: str, source: str, n: int) -> Column:
        name = f"_{kind}_{source}_{n}"
        agg = {"mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop, "max": F.max}[kind]
        w = trailing(n)
        if source in self.gaps:
            self.columns[name] = full(agg, F.col(source), w, n)
        else:
            ready = F.col(self.row) >= n + self.skips.get(source, 0)
            self.columns[name] = F.when(ready, agg(F.col(source)).over(w))
        return F.col(name)


def roll_mean(x: Column, n: int, key: str = "ticker", order: str = "date") -> Column:
    return full(F.avg, x, trailing(n, key, order), n)


def roll_sum(x: Column, n: int, key: str = "ticker", order: str = "date") -> Column:
    return full(F.sum, x, trailing(n, key, order), n)


def roll_std(x: Column, n: int, key: str = "ticker", order: str = "date") -> Column:
    return full(F.stddev_samp, x, trailing(n, key, order), n)


def roll_std_pop(x: Column, n: int, key: str = "ticker", order: str = "date") -> Column:
    return full(F.stddev_pop, x, trailing(n, key, order), n)


def roll_max(x: Column, n: int, key: str = "ticker", order: str = "date") -> Column:
    return full(F.max, x, trailing(n, key, order), n)


def lagged(x: Column, k: int = 1, key: str = "ticker", order: str = "date") -> Column:
    return F.lag(x, k).over(series(key, order))


def ahead(x: Column, k: int = 1, key: str = "ticker", order: str = "date") -> Column:
    return F.lead(x, k).over(series(key, order))
