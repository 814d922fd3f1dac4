"""Validation as data: every check returns rows (rule, key, detail). ``strict`` raises if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import period_label
from ..schema import ROLLING


class ValidationError(ValueError):
    """Raised by ``strict`` with the rules that were broken."""


def _rule(df: DataFrame, rule: str, broken: Column, key: Column, detail: Column) -> DataFrame:
    return df.where(broken).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _rules(df: DataFrame, key: Column, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All broken rules of each row, in one pass over ``df``."""
    found = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(name).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))) for name, (broken, detail) in rules.items())))
    return df.select(F.explode(found).alias("v")).select("v.*")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def strict(violations: DataFrame) -> None:
    rows = violations.groupBy("rule").count().orderBy("rule").collect()
    if rows:
        raise ValidationError("; ".join(f"{r['rule']}: {r['count']}" for r in rows))


def duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return counted.select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("key"), F.col("n").cast("string").alias("detail"))


def games(df: DataFrame) -> DataFrame:
    """Unique ids, known kickoffs, no negative score, no team against itself."""
    return union(
        duplicates(df, ["game_id"], "duplicate_game_id"),
        _rules(
            df,
            F.col("game_id"),
            {
                "missing_kickoff": (F.col("game_date").isNull(), F.lit("")),
                "negative_score": ((F.col("home_score") < 0) | (F.col("away_score") < 0), F.concat_ws(":", "home_score", "away_score")),
                "self_play": (F.col("home_team_id") == F.col("away_team_id"), F.col("home_team_id")),
            },
        ),
    )


def stats(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """Unique (game, team), no game that the schedule lacks, positive plays."""
    key = F.concat_ws("/", "game_id", "team_id")
    orphans = df.join(schedule.select("game_id"), "game_id", "left_anti")
    return union(
        duplicates(df, ["game_id", "team_id"], "duplicate_team_game"),
        _rule(orphans, "orphan_game", F.lit(True), key, F.lit("")),
        _rule(df, "plays_not_positive", F.col("offensive_plays") <= 0, key, F.col("offensive_plays")),
    )


def features(df: DataFrame, metrics: tuple[str, ...] = ROLLING) -> DataFrame:
    """Lagged columns that are missing or wholly null."""
    names = [f"{m}_{w}" for m in metrics for w in ("l3", "l5", "season")]
    present = [n for n in names if n in df.columns]
    counts = df.agg(*(F.count(n).alias(n) for n in present))
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("n")) for n in present))).alias("x")).select("x.*")
    out = long.where("n = 0").select(F.lit("feature_all_null").alias("rule"), "key", F.lit("").alias("detail"))
    gone = [n for n in names if n not in df.columns]
    if gone:
        spark = df.sparkSession
        out = out.unionByName(spark.createDataFrame([("feature_missing", n, "") for n in gone], "rule string, key string, detail string"))
    return out


def consistency(schedule: DataFrame, df: DataFrame) -> DataFrame:
    """Stats of completed games only, by exactly the two scheduled teams, with agreeing opponent, role and points, on one basis."""
    done = schedule.where("completed").select("game_id", "home_team_id", "away_team_id", "home_score", "away_score")
    extra = df.join(done.select("game_id"), "game_id", "left_anti")
    per_game = df.groupBy("game_id").agg(F.array_sort(F.collect_set("team_id")).alias("teams"))
    scheduled = F.array_sort(F.array("home_team_id", "away_team_id"))
    odd = done.join(per_game, "game_id", "left").where(F.col("teams").isNull() | (F.col("teams") != scheduled))
    joined = df.join(done, "game_id")
    home = F.col("team_id") == F.col("home_team_id")
    own, other = F.when(home, F.col("home_score")).otherwise(F.col("away_score")), F.when(home, F.col("away_score")).otherwise(F.col("home_score"))
    opponent = F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id"))
    agrees = (F.col("opponent_id") == opponent) & (F.col("is_home") == home) & F.col("points").eqNullSafe(own) & F.col("points_allowed").eqNullSafe(other)
    key = F.concat_ws("/", "game_id", "team_id")
    parts = [
        _rule(extra, "stats_of_unfinished_game", F.lit(True), key, F.lit("")),
        _rule(odd, "teams_differ_from_schedule", F.lit(True), F.col("game_id"), F.lit("")),
        _rule(joined, "row_disagrees_with_game", ~agrees, key, F.lit("")),
    ]
    if "offensive_plays_basis" in df.columns:
        bases = df.agg(F.count_distinct(F.coalesce("offensive_plays_basis", F.lit("missing"))).alias("n"))
        parts.append(_rule(bases, "mixed_play_basis", F.col("n") > 1, F.lit("all"), F.col("n")))
    return union(*parts)


def predictions(df: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Finite numbers, probability in [0, 1], no negative points, spread and total that follow from the points, one row a game and run."""
    numbers = ("home_expected_points", "away_expected_points", "projected_spread_home", "projected_total", "home_win_probability")
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in numbers))
    home, away = F.col("home_expected_points"), F.col("away_expected_points")
    key = F.concat_ws("/", "source_run", "game_id")
    return union(
        duplicates(df, ["source_run", "game_id"], "duplicate_prediction"),
        _rules(
            df,
            key,
            {
                "number_missing_or_not_finite": (bad, F.lit("")),
                "probability_out_of_range": (~F.col("home_win_probability").between(0, 1), F.col("home_win_probability")),
                "negative_points": ((home < 0) | (away < 0), F.lit("")),
                "spread_disagrees": (F.abs(home - away - F.col("projected_spread_home")) > tolerance, F.lit("")),
                "total_disagrees": (F.abs(home + away - F.col("projected_total")) > tolerance, F.lit("")),
            },
        ),
    )


def training(df: DataFrame, min_games: int = 20, min_periods: int = 2, by: str | None = None) -> DataFrame:
    """Enough completed games and periods to fit and test a model; with ``by``, a model for each of its values."""
    done = df.where("completed")
    counts = (done.groupBy(by) if by else done).agg(F.count("*").alias("games"), F.count_distinct(period_label(df.columns)).alias("periods"))
    return _rules(
        counts,
        F.col(by) if by else F.lit("all"),
        {"too_few_games": (F.col("games") < min_games, F.col("games")), "too_few_periods": (F.col("periods") < min_periods, F.col("periods"))},
    )


def results(records: DataFrame, season: int, week: int, season_type: str) -> DataFrame:
    """Rules of a results payload (schedule records as read from JSON): scope, classes, teams and whole, non-negative finals."""
    from functools import reduce as fold

    known = [F.col(f"{s}Classification").isin("fbs", "fcs") for s in ("home", "away")]
    fcs = (F.col("homeClassification") == "fcs") | (F.col("awayClassification") == "fcs")
    outside = ~(F.col("season").eqNullSafe(season) & F.col("week").eqNullSafe(week) & F.col("seasonType").eqNullSafe(season_type))
    no_final = F.col("completed") & (F.col("homePoints").isNull() | F.col("awayPoints").isNull() | (F.least("homePoints", "awayPoints") < 0))
    return union(
        duplicates(records, ["id"], "duplicate_result"),
        _rules(
            records,
            F.col("id"),
            {
                "outside_requested_scope": (outside, F.concat_ws("/", "season", "week", "seasonType")),
                "unknown_classification": (~F.coalesce(fold(lambda a, b: a & b, known), F.lit(False)), F.lit("")),
                "invalid_teams": (~fcs & ((F.col("homeId") == F.col("awayId")) | F.col("homeId").isNull() | F.col("awayId").isNull()), F.lit("")),
                "invalid_final": (~fcs & no_final, F.lit("")),
                "completed_not_boolean": (F.col("completed").isNull(), F.lit("")),
            },
        ),
    )
