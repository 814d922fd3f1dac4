"""Forecast accuracy: metrics per model, improvement over a baseline, and calibration bins with empty ones kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip
from ..sources.store import cut

METRICS = ("score_mae", "score_rmse", "spread_mae", "total_mae", "brier_score", "winner_accuracy")


def model_metrics(predicted: DataFrame, by: tuple[str, ...] = ("model",), low: float = 0.001) -> DataFrame:
    """Errors of long-form predictions with final scores; a tie counts as an away win, probabilities are clipped."""
    he, ae = F.col("home_points") - F.col("home_score"), F.col("away_points") - F.col("away_score")
    margin, actual = F.col("home_points") - F.col("away_points"), F.col("home_score") - F.col("away_score")
    won = (actual > 0).cast("double")
    scored = predicted.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    return scored.groupBy(*by).agg(
        F.count("*").alias("games"),
        ((F.avg(F.abs(he)) + F.avg(F.abs(ae))) / 2).alias("score_mae"),
        F.sqrt((F.avg(he * he) + F.avg(ae * ae)) / 2).alias("score_rmse"),
        F.avg(F.abs(margin - actual)).alias("spread_mae"),
        F.avg(F.abs(he + ae)).alias("total_mae"),
        F.avg(F.pow(clip("home_win_probability", low, 1 - low) - won, 2)).alias("brier_score"),
        F.avg(((margin > 0) == (actual > 0)).cast("double")).alias("winner_accuracy"),
    )


def long_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A row a metric and value."""
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("games", *METRICS) if m in metrics.columns))
    return metrics.select(*keys, F.explode(values).alias("x")).select(*keys, "x.*")


def improvement(metrics: DataFrame, baseline: str) -> DataFrame:
    """Percent by which each model betters the baseline, per metric; null where the baseline is 0."""
    long = long_metrics(metrics, ["model"]).where("metric <> 'games'")
    base = long.where(F.col("model") == baseline).select("metric", F.col("value").alias("base"))
    gain = F.try_divide(F.col("base") - F.col("value"), F.col("base")) * 100
    return long.where(F.col("model") != baseline).join(F.broadcast(base), "metric").select("model", "metric", gain.alias("improvement_pct"))


def calibration_bins(predicted: DataFrame, bins: int = 10, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Per model and right-closed bin of the probability (0 in the first): games, mean probability and home win share."""
    known = predicted.where(F.col("home_score").isNotNull() & F.col("home_win_probability").isNotNull())
    p = F.col("home_win_probability")
    index = F.greatest(F.ceil(p * bins) - 1, F.lit(0)).cast("int")
    won = (F.col("home_score") > F.col("away_score")).cast("double")
    grouped = cut(known.groupBy(*by, index.alias("bin")).agg(F.count("*").alias("games"), F.avg(p).alias("mean_probability"), F.avg(won).alias("home_win_rate")))  # a row a bin
    spark = predicted.sparkSession
    frame = grouped.select(*by).distinct().crossJoin(F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("bin"))))
    out = frame.join(grouped, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("games", F.lit(0)).alias("games"), "mean_probability", "home_win_rate")
