"""Pregame features: lagged means per team and season, and one row a game with both sides' features. No game sees itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rate_metrics
from ..schema import ROLLING, WINDOWS

FRAMES = {"l3": -3, "l5": -5, "season": Window.unboundedPreceding}


def history(team: str = "team_id", season: str = "season"):
    """Window of a team's season in playing order; ties of time end with the game id."""
    return Window.partitionBy(team, season).orderBy("game_date", "game_id")


def with_rates(stats: DataFrame) -> DataFrame:
    return stats.withColumns(rate_metrics())


def with_context(stats: DataFrame, games: DataFrame, unit: str = "season") -> DataFrame:
    """Stats of known games with season (and ``unit``), week, time and state. A game id that repeats in ``games`` fails the job."""
    context = list(dict.fromkeys(["season", unit, "week", "game_date", "completed"]))
    once = games.groupBy("game_id").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in context))
    told = F.raise_error(F.concat(F.lit("one game id, several games: "), F.coalesce(F.col("game_id").cast("string"), F.lit("null"))))
    once = once.where(F.when(F.col("_n") > 1, told.cast("boolean")).otherwise(True)).drop("_n")
    return stats.join(once, "game_id")


def team_pregame_features(games: DataFrame, stats: DataFrame, metrics: tuple[str, ...] = ROLLING, unit: str = "season") -> DataFrame:
    """Stats with rates and, per metric, the means of the last 3, last 5 and all earlier games of the season (of the unit that a column of ``games`` names)."""
    rows = with_context(with_rates(stats), games, unit)
    w = history(season=unit)
    lagged = {f"{m}_{name}": F.avg(m).over(w.rowsBetween(start, -1)) for m in metrics for name, start in FRAMES.items()}
    return rows.withColumns(lagged | {"prior_games": F.row_number().over(w) - 1})


def feature_names(metrics: tuple[str, ...] = ROLLING) -> list[str]:
    return [f"{m}_{w}" for m in metrics for w in WINDOWS]


def matchup_features(games: DataFrame, features: DataFrame, metrics: tuple[str, ...] = ROLLING) -> DataFrame:
    """One row a game with ``home_`` and ``away_`` features, prior games (0 if none) and the home-field indicator."""
    names = feature_names(metrics)
    out = games
    for side in ("home", "away"):
        own = features.select(
            "game_id",
            F.col("team_id").alias(f"{side}_team_id"),
            *(F.col(n).alias(f"{side}_{n}") for n in names),
            F.col("prior_games").alias(f"{side}_prior_games"),
        )
        out = out.join(own, ["game_id", f"{side}_team_id"], "left")
    return out.withColumns(
        {
            "home_field_indicator": (~F.col("neutral_site")).cast("int"),
            "home_prior_games": F.coalesce("home_prior_games", F.lit(0)),
            "away_prior_games": F.coalesce("away_prior_games", F.lit(0)),
        }
    )


def model_features(df: DataFrame) -> list[str]:
    """Numeric ``home_`` and ``away_`` columns that aren't ids, scores or counts, and the home-field indicator."""
    kinds = ("double", "float", "int", "bigint")
    barred = {"home_team_id", "away_team_id", "home_score", "away_score", "home_prior_games", "away_prior_games", "home_field_indicator"}
    return [c for c, k in df.dtypes if k in kinds and c.startswith(("home_", "away_")) and c not in barred] + ["home_field_indicator"]
