"""Universe resolution, sectors, vocabularies, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_where
from ..plans.skew import positions

UNKNOWN = "UNKNOWN"

# Broad sector of each official industry label.
BROAD_SECTORS = {
    "Financial Services": "FINANCIALS",
    "Information Technology": "IT_AND_TELECOM",
    "Telecommunication": "IT_AND_TELECOM",
    "Healthcare": "HEALTHCARE",
    "Automobile and Auto Components": "INDUSTRIALS",
    "Capital Goods": "INDUSTRIALS",
    "Construction Materials": "INDUSTRIALS",
    "Metals & Mining": "ENERGY_AND_MATERIALS",
    "Power": "ENERGY_AND_MATERIALS",
    "Oil Gas & Consumable Fuels": "ENERGY_AND_MATERIALS",
    "Fast Moving Consumer Goods": "CONSUMER",
    "Consumer Durables": "CONSUMER",
    "Consumer Services": "CONSUMER",
    "Services": "SERVICES_AND_CONSTRUCTION",
    "Construction": "SERVICES_AND_CONSTRUCTION",
}


def resolve_universe(requested: DataFrame, discovered: DataFrame, aliases: DataFrame, unavailable: DataFrame
                     ) -> DataFrame:
    """Requested symbols matched exactly, then by alias; the rest with a reason.

    Inputs are one-column ``symbol`` tables; ``aliases`` is (symbol, alias).
    """
    have = discovered.select(F.upper("symbol").alias("_have")).distinct()
    al = aliases.select(F.upper("symbol").alias("_for"), F.upper("alias").alias("_alias"))
    gone = unavailable.select(F.upper("symbol").alias("_gone")).distinct()
    df = requested.select(F.upper("symbol").alias("symbol"))
    df = df.join(have, F.col("symbol") == F.col("_have"), "left")
    df = df.join(al, F.col("symbol") == F.col("_for"), "left")
    df = df.join(have.withColumnRenamed("_have", "_have2"), F.col("_alias") == F.col("_have2"), "left")
    df = df.join(gone, F.col("symbol") == F.col("_gone"), "left")
    match = F.coalesce("_have", "_have2")
    how = (F.when(F.col("_have").isNotNull(), "exact").when(F.col("_have2").isNotNull(), "alias")
           .when(F.col("_gone").isNotNull(), "known_unavailable").otherwise("not_found"))
    return df.select("symbol", match.alias("dataset_symbol"), how.alias("resolution"))


def compare_universes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new labels paired exactly, then by provider symbol, each label once; the rest one-sided.

    Inputs are (label, symbol, position), position being the declared order.
    """
    a = old.select(F.col("label").alias("old_label"), F.col("symbol").alias("old_symbol"),
                   F.col("position").alias("_op"))
    b = new.select(F.col("label").alias("new_label"), F.col("symbol").alias("new_symbol"),
                   F.col("position").alias("_np"))
    exact = a.join(b, F.col("old_label") == F.col("new_label")).withColumn("relationship", F.lit("exact"))
    left_a = a.join(b, F.col("old_label") == F.col("new_label"), "left_anti")
    left_b = b.join(a, F.col("old_label") == F.col("new_label"), "left_anti")
    # The n-th free old label of a symbol takes its n-th free new label.
    named = left_a.where(F.coalesce(F.col("old_symbol"), F.lit("")) != "")
    na = named.withColumn("_k", F.row_number().over(Window.partitionBy("old_symbol").orderBy("_op")))
    nb = left_b.withColumn("_k2", F.row_number().over(Window.partitionBy("new_symbol").orderBy("_np")))
    renamed = na.join(nb, (F.col("old_symbol") == F.col("new_symbol")) & (F.col("_k") == F.col("_k2"))).withColumn(
        "relationship", F.lit("renamed_equivalent"))
    cols = ["old_label", "new_label", "old_symbol", "new_symbol", "relationship"]
    only_a = left_a.join(renamed.select("old_label"), "old_label", "left_anti").select(
        "old_label", F.lit("").alias("new_label"), "old_symbol", F.lit("").alias("new_symbol"),
        F.lit("legacy_only").alias("relationship"))
    only_b = left_b.join(renamed.select("new_label"), "new_label", "left_anti").select(
        F.lit("").alias("old_label"), "new_label", F.lit("").alias("old_symbol"), "new_symbol",
        F.lit("modern_only").alias("relationship"))
    return exact.select(*cols).unionByName(renamed.select(*cols)).unionByName(only_a).unionByName(only_b)


def provider_symbols(labels: DataFrame, lineage: DataFrame, renames: DataFrame, suffix: str = ".NS") -> DataFrame:
    """Provider symbol of each label: lineage registry, then rename, then already qualified, else suffixed.

    ``lineage`` is (label, policy, candidate); policy ``do_not_download`` gives
    an empty symbol.  ``renames`` is (label, symbol).
    """
    lin = lineage.select("label", F.col("policy").alias("_policy"), F.col("candidate").alias("_candidate"),
                         F.lit(True).alias("_known"))
    ren = renames.select("label", F.col("symbol").alias("_rename"))
    df = labels.join(lin, "label", "left").join(ren, "label", "left")
    c = F.col("label")
    qualified = c.contains(".") | c.startswith("^") | c.contains("=")
    registry = F.when(F.coalesce(F.col("_policy"), F.lit("")) == "do_not_download", "").otherwise(
        F.coalesce("_candidate", F.lit("")))
    symbol = (F.when(F.col("_known"), registry).when(F.col("_rename").isNotNull(), F.col("_rename"))
              .when(qualified, c).otherwise(F.concat(c, F.lit(suffix))))
    return df.withColumn("provider_symbol", symbol).drop("_policy", "_candidate", "_known", "_rename")


def safe_label(c: Column) -> Column:
    """Filesystem-safe form of a label: '&' spelt out, quotes and brackets gone, separators underscored."""
    out = F.regexp_replace(F.trim(c), "&", "_AND_")
    out = F.regexp_replace(out, "['()]", "")
    out = F.regexp_replace(out, r"[ /\\.,:]", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_+|_+$", "")
    return F.when(out == "", "UNNAMED").otherwise(out)


def broad_sector(industry: Column) -> Column:
    pairs = [x for k, v in BROAD_SECTORS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[industry], F.lit(UNKNOWN))


def build_sectors(tickers: DataFrame, constituents: DataFrame, broad=broad_sector, seq: str = "seq") -> DataFrame:
    """(ticker, industry, sector) of every requested ticker; nothing is guessed.

    ``constituents`` is (symbol, industry) and ``seq``, the row's place in the
    list; the first listed row of a symbol counts, also where its industry is empty.
    """
    official = constituents.select(F.upper(F.trim("symbol")).alias("ticker"),
                                   F.struct(F.trim("industry").alias("i")).alias("_row"), F.col(seq).alias("_seq"))
    official = official.groupBy("ticker").agg(F.min_by("_row", "_seq")["i"].alias("_industry"))
    df = tickers.select(F.upper("ticker").alias("ticker")).join(official, "ticker", "left")
    industry = F.coalesce(F.when(F.col("_industry") != "", F.col("_industry")), F.lit(UNKNOWN))
    return df.select("ticker", industry.alias("industry"), F.col("_industry").isNotNull().alias("mapped")).withColumn(
        "sector", F.when(F.col("industry") == UNKNOWN, UNKNOWN).otherwise(broad(F.col("industry"))))


def sector_coverage(sectors: DataFrame) -> DataFrame:
    return sectors.agg(
        F.count(F.lit(1)).alias("n_tickers"), count_where(F.col("mapped")).alias("n_mapped"),
        count_where(~F.col("mapped")).alias("n_unmapped"),
        count_where((F.col("sector") == UNKNOWN) & (F.col("industry") != UNKNOWN)).alias("n_unknown_industry"),
        F.avg(F.col("mapped").cast("double")).alias("coverage_fraction"))


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """(value, id): UNKNOWN is 0, the other distinct values are numbered in sorted order from 1."""
    distinct = values.select(F.col(column).cast("string").alias("value")).where(
        F.col("value").isNotNull() & (F.col("value") != UNKNOWN)).distinct()
    numbered = positions(distinct, [], [F.col("value").asc()], "_p")
    known = numbered.select("value", (F.col("_p") + 1).cast("bigint").alias("id"))
    zero = values.sparkSession.range(1).select(F.lit(UNKNOWN).alias("value"), F.col("id"))
    return zero.unionByName(known)


def eligibility(samples: DataFrame, candidates: DataFrame, train_end: str, years: tuple[int, ...],
                min_train: int = 1000, min_year: int = 180) -> DataFrame:
    """One fixed universe by sample counts; every candidate appears, with its reasons.

    A training sample has origin and target up to ``train_end``; each listed
    year needs ``min_year`` origins.
    """
    edge = F.lit(train_end).cast("date")
    counts = samples.groupBy("ticker").agg(
        F.min("origin_date").alias("first_usable_sample"),
        count_where((F.col("origin_date") <= edge) & (F.col("target_date") <= edge)).alias("train_samples"),
        *[count_where(F.year("origin_date") == y).alias(f"samples_{y}") for y in years])
    df = candidates.join(counts, "ticker", "left").fillna(0, ["train_samples", *[f"samples_{y}" for y in years]])
    none = F.col("first_usable_sample").isNull()
    reasons = [F.when(F.col("train_samples") < min_train, F.concat(
        F.lit("A/B: only "), F.col("train_samples").cast("string"),
        F.lit(f" usable TRAIN samples through {train_end} (need {min_train})")))]
    for letter, y in zip("CDEFGH", years):
        n = F.col(f"samples_{y}")
        reasons.append(F.when(n < min_year, F.concat(
            F.lit(f"{letter}: only "), n.cast("string"), F.lit(f" samples in {y} (need {min_year})"))))
    reason = F.when(none, "no usable sample").otherwise(F.array_join(F.array_compact(F.array(*reasons)), "; "))
    return df.withColumn("exclusion_reason", reason).withColumn("eligible", F.col("exclusion_reason") == "")


def cohort_summary(universe: DataFrame) -> DataFrame:
    """Candidates, eligible and excluded per sector."""
    return universe.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_candidates"), count_where(F.col("eligible")).alias("n_eligible"),
        count_where(~F.col("eligible")).alias("n_excluded"))


def horizon_eligibility(samples: DataFrame, candidates: DataFrame, train: tuple[str, str], years: tuple[int, ...],
                        horizons: tuple[int, ...], reference_horizon: int = 10, min_train: int = 1000,
                        min_year: int = 180) -> DataFrame:
    """Universe usable at every horizon: enough training samples at the reference horizon, and in
    every (horizon, year) enough validation samples.  A year without samples counts zero."""
    o, t = F.col("origin_date"), F.col("target_date")
    lo, hi = F.lit(train[0]).cast("date"), F.lit(train[1]).cast("date")
    trained = (F.col("horizon") == reference_horizon) & o.between(lo, hi) & t.between(lo, hi)
    aggs = [count_where(trained).alias("train_reference")]
    for h in horizons:
        mine = F.col("horizon") == h
        per_year = [count_where(mine & (F.year(o) == y) & (F.year(t) == y)) for y in years]
        aggs += [count_where(mine).alias(f"samples_{h}"),
                 (F.least(*per_year) if len(per_year) > 1 else per_year[0]).alias(f"val_min_{h}")]
    counted = ["train_reference", *[f"{p}_{h}" for h in horizons for p in ("samples", "val_min")]]
    df = candidates.join(samples.groupBy("ticker").agg(*aggs), "ticker", "left").fillna(0, counted)
    total = sum([F.col(f"samples_{h}") for h in horizons[1:]], F.col(f"samples_{horizons[0]}"))
    reasons = [
        F.when(total == 0, "no usable causal sample at any horizon (insufficient history)"),
        F.when(F.col("train_reference") < min_train, F.concat(
            F.lit("only "), F.col("train_reference").cast("string"),
            F.lit(f" valid H={reference_horizon} training samples (need {min_train})")))]
    reasons += [F.when(F.col(f"val_min_{h}") < min_year, F.concat(
        F.lit("only "), F.col(f"val_min_{h}").cast("string"),
        F.lit(f" valid validation samples in the weakest development year at H={h} (need {min_year})")))
        for h in horizons]
    reason = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return df.withColumn("exclusion_reason", reason).withColumn("eligible", F.col("exclusion_reason") == "")
