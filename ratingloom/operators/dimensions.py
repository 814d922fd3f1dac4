"""Team names and conferences from several sources, and tables enriched with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def team_dimension(*sources: DataFrame) -> DataFrame:
    """(team_id, name): names from schedules (home_team_id, home_name, away_team_id, away_name, captured_at), later sources first.

    Within a source the latest capture counts, then the later name in the alphabet.
    """
    parts = []
    for i, s in enumerate(sources):
        pair = F.array(*(F.struct(F.col(f"{x}_team_id").alias("team_id"), F.col(f"{x}_name").alias("name")) for x in ("home", "away")))
        parts.append(s.select(F.explode(pair).alias("p"), F.lit(i).alias("priority"), "captured_at").select("p.*", "priority", "captured_at"))
    rows = reduce(DataFrame.unionByName, parts).where("team_id IS NOT NULL AND name IS NOT NULL AND name <> ''")
    return rows.groupBy("team_id").agg(F.max_by("name", F.struct("priority", "captured_at", "name")).alias("name"))


def conference_dimension(teams: DataFrame, explicit: DataFrame | None = None, observed: DataFrame | None = None, defaults: DataFrame | None = None, fallback: str = "FBS") -> DataFrame:
    """(team_id, conference): explicit, else observed (both by id), else built-in by name, else the fallback."""
    out = teams.select("team_id", "name")
    picks = []
    for label, source, key in (("e", explicit, "team_id"), ("o", observed, "team_id"), ("d", defaults, "name")):
        if source is not None:
            out = out.join(source.select(key, F.col("conference").alias(f"_{label}")), key, "left")
            picks.append(F.col(f"_{label}"))
    return out.select("team_id", "name", F.coalesce(*picks, F.lit(fallback)).alias("conference"))


def matchup_text(away, home, neutral):
    return F.concat(away, F.when(neutral, F.lit(" vs ")).otherwise(F.lit(" @ ")), home, F.when(neutral, F.lit(" (N)")).otherwise(F.lit("")))


def enrich_predictions(predictions: DataFrame, teams: DataFrame) -> DataFrame:
    """Predictions with both names (the id as text where there is none, 'Unknown' for an empty one) and the matchup, these first."""
    out = predictions
    for s in ("home", "away"):
        own = teams.select(F.col("team_id").alias(f"{s}_team_id"), F.col("name").alias(f"_{s}"))
        out = out.join(own, f"{s}_team_id", "left")
        shown = F.coalesce(f"_{s}", F.col(f"{s}_team_id").cast("string"), F.lit(""))
        out = out.withColumn(f"{s}_team", F.when(shown == "", "Unknown").otherwise(shown))
    neutral = F.coalesce("neutral_site", F.lit(False)) if "neutral_site" in predictions.columns else F.lit(False)
    out = out.withColumn("matchup", matchup_text(F.col("away_team"), F.col("home_team"), neutral))
    first = ["game_id", "matchup", "away_team", "home_team"]
    return out.select(*first, *(c for c in predictions.columns if c not in first))


def enrich_stats(stats: DataFrame, teams: DataFrame) -> DataFrame:
    """Stats with the team's and the opponent's name."""
    out = stats
    for key, name in (("team_id", "team_name"), ("opponent_id", "opponent_name")):
        out = out.join(teams.select(F.col("team_id").alias(key), F.col("name").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.col(key).cast("string")))
    first = ["game_id", "team_id", "team_name", "opponent_id", "opponent_name"]
    return out.select(*first, *(c for c in stats.columns if c not in first))
