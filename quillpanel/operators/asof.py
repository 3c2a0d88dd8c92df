"""Point-in-time external series: features on their own calendar, then backward as-of alignment.

Features are computed on each source's own dates, so an aligned value carries
only what was known on its observation date.  A source has at most one row per
date after duplicates are settled, which bounds every window here by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_where, is_finite, ratio
from ..functions.rolling import lagged, roll_max, roll_mean, roll_std
from ..plans.skew import quantiles
from .quality import drop_degenerate, finite_rows
from .scaling import apply_scaler, fit_scaler

# Feature templates by asset class, in order.
PRICE_FEATURES = ("return_1", "return_3", "return_5", "return_10", "return_20", "realized_vol_5", "realized_vol_10",
                  "realized_vol_20", "drawdown_20", "drawdown_60", "distance_from_ma20", "distance_from_ma60")
VOLATILITY_FEATURES = ("level", "log_level", "change_1", "change_5", "zscore_20")
YIELD_FEATURES = ("level", "change_1", "change_5", "change_20")
VOLATILITY, YIELD = "VOLATILITY", "YIELD"
# Fixed value: annualising factor of a daily deviation, in percent.
ANNUAL_PERCENT = math.sqrt(252.0) * 100.0
# Classes whose value of the same date may be used; B needs a strictly earlier one.
SAME_DATE_CLASSES = ("A", "C")


class AvailabilityError(ValueError):
    """A rule would let a value be used before it was known."""


def templates(asset_class: str) -> tuple[str, ...]:
    return {VOLATILITY: VOLATILITY_FEATURES, YIELD: YIELD_FEATURES}.get(asset_class, PRICE_FEATURES)


def latest_per_date(observations: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per (source, date); the last of repeated rows stays."""
    values = [c for c in observations.columns if c not in ("source_id", "source_date", seq)]
    if seq is None:
        return observations.dropDuplicates(["source_id", "source_date"])
    row = F.max_by(F.struct(*values), F.col(seq)).alias("_r")
    return observations.groupBy("source_id", "source_date").agg(row).select("source_id", "source_date", "_r.*")


def _formulas() -> dict[str, dict[str, Column]]:
    """Feature expressions per template family over (source_id, source_date)."""
    at = {"key": "source_id", "order": "source_date"}
    v, lv, r = F.col("close"), F.col("_lv"), F.col("_lr")
    mean20, std20 = roll_mean(v, 20, **at), roll_std(v, 20, **at)
    price = {f"return_{k}": lv - lagged(lv, k, **at) for k in (1, 3, 5, 10, 20)}
    price |= {f"realized_vol_{n}": roll_std(r, n, **at) * F.lit(ANNUAL_PERCENT) for n in (5, 10, 20)}
    price |= {f"drawdown_{n}": _over_positive(v, roll_max(v, n, **at)) for n in (20, 60)}
    price |= {f"distance_from_ma{n}": _over_positive(v, roll_mean(v, n, **at)) for n in (20, 60)}
    level = {"level": v, **{f"change_{k}": v - lagged(v, k, **at) for k in (1, 5, 20)}}
    volatility = {"level": v, "log_level": lv, "change_1": level["change_1"], "change_5": level["change_5"],
                  "zscore_20": F.when(std20 > 0, (v - mean20) / std20)}
    return {"PRICE": price, VOLATILITY: volatility, YIELD: {f: level[f] for f in YIELD_FEATURES}}


def _over_positive(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b - 1.0)


def source_features(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (source_id, source_date, features): an array of (feature, value) by the source's asset class.

    ``observations`` holds one row per source and date; ``registry`` is
    (source_id, availability, asset_class), one row per source.
    """
    df = observations.select("source_id", "source_date", "close").join(
        F.broadcast(registry.select("source_id", "asset_class")), "source_id")
    lv = F.when(F.col("close") > 0, F.log("close"))
    df = df.withColumn("_lv", lv)
    df = df.withColumn("_lr", F.col("_lv") - lagged(F.col("_lv"), 1, "source_id", "source_date"))
    by_class = _formulas()
    named = {f"_{k}_{f}": c for k, fs in by_class.items() for f, c in fs.items()}
    df = df.withColumns(named)

    def cells(k: str) -> Column:
        return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_{k}_{f}").alias("value")) for f in by_class[k]])

    chosen = (F.when(F.col("asset_class") == VOLATILITY, cells(VOLATILITY))
              .when(F.col("asset_class") == YIELD, cells(YIELD)).otherwise(cells("PRICE")))
    return df.select("source_id", "source_date", chosen.alias("features"))


def long_features(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.inline("features"))


def align_asof(origins: DataFrame, features: DataFrame, registry: DataFrame, strict: bool | None = None) -> DataFrame:
    """For every origin date and source, the latest observation the source's class allows.

    ``origins`` has one DATE column ``origin_date``.  Class A and C may use the
    same date, class B only an earlier one.  ``strict=True`` forbids the same
    date for all; ``strict=False`` is refused while a class B source is present.

    Both sides are put into one ordered stream per source, and the last
    observation before each origin is carried forward: linear after the sort.
    The lag counts source sessions after the observation up to the origin.
    """
    rules = {r["source_id"]: r["availability"] for r in registry.select("source_id", "availability").collect()}
    unknown = sorted(set(rules.values()) - {"A", "B", "C"})
    if unknown:
        raise AvailabilityError(f"unknown availability classes {unknown}")
    if strict is False and "B" in rules.values():
        raise AvailabilityError("a class B source cannot be aligned to the same date")
    cls = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v))])[F.col("source_id")]
    same_ok = F.lit(not strict) if strict is not None else cls.isin(*SAME_DATE_CLASSES)

    asked = origins.select("origin_date").where(F.col("origin_date").isNotNull()).distinct().select(
        F.explode(F.array(*[F.lit(s) for s in rules])).alias("source_id"), F.col("origin_date").alias("_at"),
        F.lit(True).alias("_asked"))
    seen = features.select("source_id", F.col("source_date").alias("_at"), F.lit(False).alias("_asked"),
                           F.col("source_date").alias("_obs"), F.col("features").alias("_values"))
    stream = asked.unionByName(seen, allowMissingColumns=True)
    # An origin sorts after an observation of its date where that is allowed, before it otherwise.
    stream = stream.withColumn("_tag", F.when(~F.col("_asked"), 1).when(same_ok, 2).otherwise(0))
    up_to_date = Window.partitionBy("source_id").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    stream = stream.withColumn("_sessions", F.count("_obs").over(up_to_date))
    carried = Window.partitionBy("source_id").orderBy("_at", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("_asked"), F.struct("_obs", "_sessions", "_values")), ignorenulls=True).over(carried)
    out = stream.withColumn("_last", last).where("_asked")
    return out.select(
        "source_id", F.col("_at").alias("origin_date"), F.col("_last._obs").alias("observation_date"),
        F.col("_at").alias("effective_date"),
        (F.col("_sessions") - F.col("_last._sessions")).alias("lag_sessions"), cls.alias("availability"),
        F.col("_last._values").alias("features"))


def alignment_report(aligned: DataFrame) -> DataFrame:
    """Coverage, lag spread, same-date uses and rule violations per source."""
    obs = F.col("observation_date")
    same = obs == F.col("origin_date")
    late = F.when(F.col("availability").isin(*SAME_DATE_CLASSES), obs > F.col("origin_date")).otherwise(
        obs >= F.col("origin_date"))
    base = aligned.groupBy("source_id", "availability").agg(
        F.count(F.lit(1)).alias("n_origins"), F.count(obs).alias("n_with_observation"),
        F.count_if(obs.isNull()).alias("n_missing"), F.avg(obs.isNotNull().cast("double")).alias("coverage"),
        F.min("lag_sessions").alias("min_lag"), F.max("lag_sessions").alias("max_lag"),
        count_where(same).alias("n_same_date"), count_where(late).alias("violations"))
    median = quantiles(aligned, ["source_id"], "lag_sessions", {"median_lag": 0.5})
    return base.join(median, "source_id", "left")


def wide_exogenous(aligned: DataFrame, registry: DataFrame, provenance: bool = True) -> DataFrame:
    """One row per origin date with a column for every source feature, from a fixed column list."""
    specs = [(r["source_id"], f) for r in registry.select("source_id", "asset_class").orderBy("source_id").collect()
             for f in templates(r["asset_class"])]
    sources = sorted({s for s, _ in specs})
    value = F.map_from_entries("features")
    keyed = aligned.withColumn("_m", value)
    cols = [F.max(F.when(F.col("source_id") == s, F.col("_m")[f])).alias(f"{s}_{f}") for s, f in specs]
    if provenance:
        cols += [F.max(F.when(F.col("source_id") == s, F.col("observation_date"))).alias(f"{s}_observation_date")
                 for s in sources]
    return keyed.groupBy("origin_date").agg(*cols)


def exogenous_store(wide: DataFrame, min_share: float = 0.5) -> tuple[DataFrame, list[str]]:
    """The wide table without its degenerate feature columns, and their names; dates of observations stay."""
    features = [c for c in wide.columns if c != "origin_date" and not c.endswith("_observation_date")]
    return drop_degenerate(wide, features, min_share)


def composite_factor(wide: DataFrame, components: dict[str, int], train: tuple[str, str], name: str = "risk_factor",
                     date: str = "origin_date") -> DataFrame:
    """Mean of standardised components with fixed signs; undefined inputs count as 0.

    The standardisation is always fitted on the given training dates.
    """
    filled = wide.withColumns({f"_c_{c}": F.when(is_finite(F.col(c)), F.col(c)).otherwise(F.lit(0.0)) for c in components})
    names = [f"_c_{c}" for c in components]
    inside = F.col(date).between(F.lit(train[0]).cast("date"), F.lit(train[1]).cast("date"))
    scaled = apply_scaler(filled, fit_scaler(filled.where(inside), names), names, suffix="_z")
    total = sum([F.col(f"_c_{c}_z") * sign for c, sign in components.items()], F.lit(0.0))
    return scaled.withColumn(name, total / len(components)).drop(*names, *[f"{n}_z" for n in names])


def sector_index_mapping(sectors: DataFrame, index_of: DataFrame, confidence: float = 0.9) -> DataFrame:
    """External index of each ticker's sector; an unknown sector is never mapped.

    ``index_of`` is (sector, index_id).
    """
    known = ~F.upper(F.trim("sector")).isin("UNKNOWN", "", "NONE", "NAN")
    lookup = index_of.select(F.col("sector").alias("_s"), F.col("index_id").alias("_i"))
    df = sectors.select("ticker", "sector").join(F.broadcast(lookup), known & (F.col("sector") == F.col("_s")), "left")
    return df.select("ticker", "sector", F.coalesce("_i", F.lit("")).alias("index_id"),
                     F.when(F.col("_i").isNotNull(), confidence).otherwise(0.0).alias("confidence"))


def mapping_gate(mapping: DataFrame, floor: float = 0.5) -> DataFrame:
    """Share of tickers with an index; the block is used only from ``floor`` up."""
    out = mapping.agg(F.count(F.lit(1)).alias("n_tickers"), count_where(F.col("index_id") != "").alias("n_mapped"))
    return out.withColumn("coverage", ratio(F.col("n_mapped").cast("double"), F.col("n_tickers"))).withColumn(
        "included", F.col("coverage") >= floor)


def index_returns(aligned: DataFrame) -> DataFrame:
    """(index_id, date, return_1, return_5, return_20) of aligned price sources."""
    m = aligned.withColumn("_m", F.map_from_entries("features"))
    return m.select(F.col("source_id").alias("index_id"), F.col("origin_date").alias("date"),
                    *[F.col("_m")[f"return_{k}"].alias(f"index_return_{k}") for k in (1, 5, 20)])


def relative_to_index(stock: DataFrame, returns: DataFrame, index_id: str, prefix: str) -> DataFrame:
    """Stock return minus one index's aligned return at 1, 5 and 20 rows."""
    one = returns.where(F.col("index_id") == index_id).drop("index_id")
    df = stock.join(F.broadcast(one), "date", "left")
    return df.withColumns({f"{prefix}_{k}": F.col(f"log_return_{k}") - F.col(f"index_return_{k}") for k in (1, 5, 20)}
                          ).drop(*[f"index_return_{k}" for k in (1, 5, 20)])


def relative_to_sector_index(stock: DataFrame, returns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Stock return minus its own sector index's; NULL for tickers without one."""
    df = stock.join(mapping.select("ticker", "index_id"), "ticker", "left")
    df = df.join(returns, ["index_id", "date"], "left")
    return df.withColumns({f"stock_minus_sector_index_{k}": F.col(f"log_return_{k}") - F.col(f"index_return_{k}")
                           for k in (1, 5, 20)}).drop(*[f"index_return_{k}" for k in (1, 5, 20)])


def family_columns(columns: list[str], sources: list[str]) -> list[str]:
    """Columns a family takes: those named after one of its sources."""
    return [c for c in columns if any(c.startswith(f"{s}_") for s in sources) and not c.endswith("observation_date")]


def family_panel(stock: DataFrame, wide: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Stock rows with every exogenous column and one finite flag per family, plus the common flag.

    ``families`` maps a family to its source columns.  The common sample has
    the source columns of every family finite, so that all families can be
    compared on the same rows.
    """
    used = sorted({c for cols in families.values() for c in cols})
    exo = wide.select(F.col("origin_date").alias("date"), *[F.col(f"`{c}`") for c in used])
    df = stock.join(F.broadcast(exo), "date", "left")
    df = df.withColumns({f"ok_{f}": _all_finite(cols) for f, cols in families.items()})
    common = F.lit(True)
    for f in families:
        common = common & F.col(f"ok_{f}")
    return df.withColumn("ok_common", common)


def _all_finite(columns: list[str]) -> Column:
    return finite_rows([f"`{c}`" for c in columns])


def source_verdicts(gate: DataFrame, integrity: DataFrame, registry: DataFrame) -> DataFrame:
    """Accept or reject every registered source, with the reason and the integrity counts."""
    df = registry.join(gate.select("source_id", "passed", "reason", "n_observations"), "source_id", "left")
    df = df.join(integrity, "source_id", "left")
    passed = F.coalesce(F.col("passed"), F.lit(False))
    reason = F.when(passed, "").otherwise(F.coalesce("reason", F.lit("no observations at all")))
    return df.select("source_id", "availability", "asset_class", passed.alias("accepted"), reason.alias("rejection_reason"),
                     F.coalesce("n_observations", F.lit(0)).alias("n_observations"),
                     F.coalesce("duplicate_dates", F.lit(0)).alias("duplicate_dates"),
                     F.coalesce("suspicious_jumps", F.lit(0)).alias("suspicious_jumps"))
