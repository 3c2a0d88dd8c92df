"""From probabilities to decisions and explanations: column arithmetic over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import is_finite

FLOOR = 1e-8


def assemble_predictions(raw: DataFrame, calibrated: str = "p_calibrated") -> DataFrame:
    """Direction and its confidence next to raw and calibrated probability."""
    p = F.col(calibrated)
    return raw.withColumns({"direction": F.when(p >= 0.5, "UP").otherwise("DOWN"),
                            "confidence": F.when(p >= 0.5, p).otherwise(1.0 - p)})


def latest_per_ticker(predictions: DataFrame, date: str = "origin_date") -> DataFrame:
    """The newest prediction of each ticker (an aggregate, so old rows collapse before the shuffle)."""
    others = [c for c in predictions.columns if c != "ticker"]
    row = F.max_by(F.struct(*others), F.col(date)).alias("_r")
    return predictions.groupBy("ticker").agg(row).select("ticker", "_r.*")


def risk_decisions(predictions: DataFrame, snapshot: DataFrame, p: str = "p_up") -> DataFrame:
    """Confidence band, stop loss, take profit, reward-risk ratio and score of each prediction.

    ``snapshot`` has ticker, origin_date, close and atr_14; rows without a
    finite close and a positive range get no decision.
    """
    df = predictions.join(snapshot.select("ticker", "origin_date", "close", "atr_14"), ["ticker", "origin_date"])
    df = df.where(is_finite(F.col("close")) & is_finite(F.col("atr_14")) & (F.col("atr_14") > 0))
    up = F.col(p) >= 0.5
    confidence = F.when(up, F.col(p)).otherwise(1.0 - F.col(p))
    df = df.withColumns({"direction": F.when(up, "UP").otherwise("DOWN"), "confidence": confidence,
                         "atr": F.greatest("atr_14", F.lit(FLOOR))})
    # Bands and their multiples of the range.
    high, medium = F.col("confidence") > 0.80, F.col("confidence") > 0.60
    df = df.withColumns({
        "confidence_level": F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"),
        "lambda_sl": F.when(high, 0.8).when(medium, 1.0).otherwise(1.2),
        "lambda_tp": F.when(high, 1.5).when(medium, 1.0).otherwise(0.8)})
    sign = F.when(F.col("direction") == "UP", 1.0).otherwise(-1.0)
    df = df.withColumns({"stop_loss": F.col("close") - sign * F.col("lambda_sl") * F.col("atr"),
                         "take_profit": F.col("close") + sign * F.col("lambda_tp") * F.col("atr")})
    return df.withColumns({
        "rrr": F.abs(F.col("take_profit") - F.col("close")) / F.greatest(F.abs(F.col("close") - F.col("stop_loss")), F.lit(FLOOR)),
        "risk_score": F.col("confidence") / F.col("atr"),
        "reason_codes": F.array(F.concat(F.lit("direction="), "direction"), F.concat(F.lit("confidence_level="), "confidence_level"),
                                F.concat(F.lit("lambda_SL="), F.col("lambda_sl").cast("string")),
                                F.concat(F.lit("lambda_tp="), F.col("lambda_tp").cast("string")))}).drop("atr")


def mean_attributions(attributions: DataFrame, cells: list[str], k: int = 5) -> DataFrame:
    """The k features of largest mean absolute attribution per cell.

    ``attributions`` is long: cells, feature, value.
    """
    means = attributions.groupBy(*cells, "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    w = Window.partitionBy(*cells).orderBy(F.col("mean_abs").desc(), "feature")
    return means.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def reason_text(decisions: DataFrame, top: DataFrame) -> DataFrame:
    """One sentence per prediction from its three strongest features.

    ``top`` is (ticker, origin_date, feature, mean_abs, place).  Numbers are
    rounded half to even before they are written out.
    """
    keys = ["ticker", "origin_date"]
    listed = top.where(F.col("place") <= 3).groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("place", F.format_string("%s (|attribution|=%.4f)", F.col("feature"), F.bround("mean_abs", 4)).alias("t")))).alias("_f"))
    df = decisions.join(listed, keys, "left")
    text = F.concat(F.col("ticker"), F.lit(" on "), F.col("origin_date").cast("string"), F.lit(": "), F.col("direction"),
                    F.lit(" with confidence "), F.format_string("%.1f", F.bround(F.col("confidence") * 100, 1)),
                    F.lit("%. The prediction is primarily driven by "),
                    F.array_join(F.transform("_f", lambda x: x["t"]), ", "), F.lit("."))
    return df.withColumn("reason", F.when(F.col("_f").isNull(), "No dominant features identified.").otherwise(text)).drop("_f")
