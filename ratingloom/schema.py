"""Canonical tables: column lists and Spark types. Extra columns are allowed everywhere and carried through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

def struct(text: str) -> T.StructType:
    """StructType from ``name type`` pairs, without a session."""
    kinds = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (p.split() for p in text.split(","))])


GAMES = struct(
    "game_id bigint,season int,week int,game_date timestamp,home_team_id bigint,away_team_id bigint,"
    "home_score bigint,away_score bigint,neutral_site boolean,completed boolean"
)
STATS = struct(
    "game_id bigint,team_id bigint,opponent_id bigint,is_home boolean,points bigint,points_allowed bigint,total_yards bigint,"
    "offensive_plays bigint,passing_yards bigint,rushing_yards bigint,turnovers bigint,takeaways bigint,third_down_attempts bigint,"
    "third_down_conversions bigint,red_zone_attempts bigint,red_zone_touchdowns bigint,penalties bigint,penalty_yards bigint,"
    "time_of_possession_seconds bigint"
)
PREDICTIONS = struct(
    "game_id bigint,season int,week int,game_date timestamp,away_team_id bigint,home_team_id bigint,away_expected_points double,"
    "home_expected_points double,projected_spread_home double,projected_total double,home_win_probability double,away_score_low double,"
    "away_score_high double,home_score_low double,home_score_high double,confidence_tier string,model_version string"
)
#: Metrics with lagged means in the pregame features.
ROLLING = (
    "points", "points_allowed", "yards_per_play", "passing_yards_per_play", "rushing_yards_per_play",
    "turnovers", "takeaways", "third_down_rate", "penalty_yards", "time_of_possession_seconds",
)
WINDOWS = ("l3", "l5", "season")


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` if it has all columns of ``schema``; extra columns stay."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the order of ``schema``, absent ones as null, then the extra ones."""
    from pyspark.sql import functions as F

    first = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*first, *(c for c in df.columns if c not in schema.names))
