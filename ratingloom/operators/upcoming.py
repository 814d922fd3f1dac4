"""Forecasts of upcoming games: which can be forecast, each team's history before kickoff, and rolling or rated projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, kickoff_text, mean_of, normal_cdf, round_to
from . import market, project


def completed_split(games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(completed games, all others)."""
    return games.where("completed"), games.where("NOT coalesce(completed, false)")


def split_upcoming(games: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(games to forecast, skipped games with a reason) among those not completed."""
    reason = F.when(F.col("home_score").isNotNull() | F.col("away_score").isNotNull(), "has scores but is not completed").when(
        F.col("game_date") <= F.lit(as_of).cast("timestamp"), "kickoff has passed or game is in progress"
    )
    rows = games.where("NOT completed").withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").select("game_id", "season", "week", "game_date", "reason")


def team_history(games: DataFrame, fixtures: DataFrame, unit: str = "season") -> DataFrame:
    """Per fixture and side, over the team's completed games of that unit (a season, or a league's) strictly before kickoff: n, mean points, mean allowed.

    As-of join as one window: results and queries share a timeline per (team, unit); a query sums what lies at least a
    microsecond before it. Results of units without a fixture stay where they are.
    """
    sides = [("home", "home_team_id", "home_score", "away_score"), ("away", "away_team_id", "away_score", "home_score")]
    units = fixtures.select(F.col(unit).alias("_unit")).distinct()
    done = games.where("completed").join(units, F.col(unit).eqNullSafe(F.col("_unit")), "left_semi")
    results = [done.select(F.col(t).alias("team_id"), F.col(unit).alias("unit"), "game_date", F.lit(None).cast("long").alias("game_id"), F.lit(None).cast("string").alias("side"), F.col(p).cast("double").alias("p"), F.col(q).cast("double").alias("q")) for _, t, p, q in sides]
    asks = [fixtures.select(F.col(t).alias("team_id"), F.col(unit).alias("unit"), "game_date", "game_id", F.lit(s).alias("side"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("q")) for s, t, _, _ in sides]
    line = results[0].unionByName(results[1]).unionByName(asks[0]).unionByName(asks[1])
    w = Window.partitionBy("team_id", "unit").orderBy(F.unix_micros(F.col("game_date").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    seen = line.select("game_id", "side", "team_id", F.count("p").over(w).alias("n"), F.avg("p").over(w).alias("scored"), F.avg("q").over(w).alias("allowed"))
    return seen.where("side IS NOT NULL")


def with_history(fixtures: DataFrame, history: DataFrame) -> DataFrame:
    out = fixtures
    for s in ("home", "away"):
        own = history.where(F.col("side") == s).select("game_id", F.col("n").alias(f"{s}_games_played"), F.col("scored").alias(f"{s}_scored"), F.col("allowed").alias(f"{s}_allowed"))
        out = out.join(own, "game_id", "left")
    return out


def league_means(games: DataFrame, league: str | None = None) -> DataFrame:
    """(league_home, league_away, scale) of the completed games, a row a league where a column names it."""
    margin = F.stddev_samp(F.col("home_score") - F.col("away_score"))
    return games.where("completed").groupBy(*([league] if league else [])).agg(F.avg("home_score").alias("league_home"), F.avg("away_score").alias("league_away"), F.greatest(F.coalesce(margin, F.lit(1.0)), F.lit(1.0)).alias("scale"))


def rolling_forecast(fixtures: DataFrame, games: DataFrame, unit: str = "season", league: str | None = None) -> DataFrame:
    """Forecasts from the unit's means before kickoff; the mean of the league (of all games where no column names leagues) where neither side has any."""
    rows = with_history(fixtures, team_history(games, fixtures, unit))
    means = league_means(games, league)
    rows = rows.join(means, league, "left") if league else rows.crossJoin(F.broadcast(means))
    rows = rows.withColumns(
        {"home_expected_points": F.coalesce(mean_of("home_scored", "away_allowed"), F.col("league_home")), "away_expected_points": F.coalesce(mean_of("away_scored", "home_allowed"), F.col("league_away"))}
    )
    home, away, band = F.col("home_expected_points"), F.col("away_expected_points"), F.col("scale") / 1.4
    return rows.withColumns(
        {
            "projected_spread_home": home - away, "projected_total": home + away, "home_win_probability": normal_cdf((home - away) / F.col("scale")),
            "home_score_low": clip(round_to(home - band), 0.0), "home_score_high": round_to(home + band), "away_score_low": clip(round_to(away - band), 0.0), "away_score_high": round_to(away + band),
            "confidence_tier": F.lit("Low"), "model": F.lit("rolling"),
        }
    )


def rated_forecast(fixtures: DataFrame, games: DataFrame, ratings: DataFrame, league: DataFrame, home_advantage: float = 2.5, unit: str = "season", league_col: str | None = None) -> DataFrame:
    """Projections from ratings where either side has a game behind it, the rolling forecast elsewhere. ``unit`` names the column of
    ``fixtures`` and ``games`` that holds the unit of ``ratings`` and ``league`` (its averages); ``league_col`` that of a game's league."""
    base = rolling_forecast(fixtures, games, unit, league_col)
    names = ("home_expected_points", "away_expected_points", "projected_spread_home", "projected_total", "home_win_probability", "home_score_low", "home_score_high", "away_score_low", "away_score_high", "confidence_tier")
    rated = project.project(fixtures.withColumn("unit", F.col(unit)), ratings, league, home_advantage).select("game_id", *(F.col(n).alias(f"r_{n}") for n in names))
    rows = base.join(rated, "game_id", "left")
    use = F.col("r_home_expected_points").isNotNull() & ((F.col("home_games_played") > 0) | (F.col("away_games_played") > 0))
    return rows.withColumns({n: F.when(use, F.col(f"r_{n}")).otherwise(F.col(n)) for n in names} | {"model": F.when(use, "ratings").otherwise("rolling")}).drop(*(f"r_{n}" for n in names))


def finish(forecast: DataFrame, teams: DataFrame, lines: DataFrame, min_history: int = 3, names: DataFrame | None = None) -> DataFrame:
    """The published columns: kickoff text, matchup text, low-history flag, market line (by game id, else by both names) and edges."""
    out = forecast
    for s in ("home", "away"):
        out = out.join(teams.select(F.col("team_id").alias(f"{s}_team_id"), F.col("name").alias(f"{s}_team")), f"{s}_team_id", "left")
    shown = {s: F.coalesce(f"{s}_team", F.col(f"{s}_team_id").cast("string")) for s in ("home", "away")}
    out = out.withColumns(
        {
            "kickoff_utc": kickoff_text("game_date"),
            "matchup": F.concat(shown["away"], F.when(F.col("neutral_site"), F.lit(" vs ")).otherwise(F.lit(" @ ")), shown["home"], F.when(F.col("neutral_site"), F.lit(" (N)")).otherwise(F.lit(""))),
            "low_history": F.least("home_games_played", "away_games_played") < min_history,
        }
    )
    return market.market_edges(market.attach_lines(out, lines, names))


def run_warnings(forecast: DataFrame, games: DataFrame, as_of: str, stale_days: int = 9) -> DataFrame:
    """One row of counts and flags: low-history games, newest result too old, games past kickoff without a result."""
    now = F.lit(as_of).cast("timestamp")
    done = games.agg(F.max(F.when(F.col("completed"), F.col("game_date"))).alias("newest"), F.count_if(~F.col("completed") & (F.col("game_date") <= now)).alias("missing_results"))
    low = forecast.agg(F.count("*").alias("forecasts"), F.count_if("low_history").alias("low_history"))
    return low.crossJoin(done).select("forecasts", "low_history", "missing_results", (F.datediff(now, "newest") > stale_days).alias("stale"))
