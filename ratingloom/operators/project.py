"""Projections of fixtures from ratings, situational edges, side-by-side tables and slate summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, confidence, normal_cdf, pick_label, round_to

#: Columns of a rating profile that projections and edges look at.
PROFILE = (
    "team_name", "conference", "rank", "tier", "power_rating", "offensive_rating", "defensive_rating", "strength_of_schedule", "recent_form_rating",
    "wins", "losses", "ties", "yards_per_play", "yards_per_play_allowed", "passing_yards_per_play", "rushing_yards_per_play", "third_down_rate",
    "third_down_rate_allowed", "red_zone_td_rate", "red_zone_td_rate_allowed", "turnover_margin_pg", "penalty_yards_pg", "success_rate", "success_rate_allowed", "ppa_per_play", "explosiveness", "havoc_rate",
)


def join_profiles(fixtures: DataFrame, ratings: DataFrame, unit: str = "unit") -> DataFrame:
    """Both sides' profiles (``a_``: home, ``b_``: away); an unknown team is a neutral one rated 0."""
    kinds = dict(ratings.dtypes)
    out = fixtures
    for side, key in (("a", "home_team_id"), ("b", "away_team_id")):
        names = [c for c in PROFILE if c in kinds]
        own = ratings.select(F.col("unit").alias(unit), F.col("team_id").alias(key), *(F.col(c).alias(f"{side}_{c}") for c in names))
        out = out.join(own, [unit, key], "left")
        out = out.withColumns({f"{side}_{c}": F.coalesce(F.col(f"{side}_{c}"), F.lit(0).cast(kinds[c])) for c in names if kinds[c] != "string"})
    return out


def project(fixtures: DataFrame, ratings: DataFrame, league: DataFrame, home_advantage: float = 2.5, adjust: tuple[str, str] | None = None) -> DataFrame:
    """Expected points, spread, total, win probability and bands of each fixture (unit, home_team_id, away_team_id, neutral_site).

    ``adjust`` names columns of roster adjustments in points for the home and the away side.
    """
    return _projected(join_profiles(fixtures, ratings), league, home_advantage, adjust)


def project_pairs(ratings: DataFrame, league: DataFrame, home_advantage: float = 2.5) -> DataFrame:
    """``project`` of ``all_pairs``: both sides' profiles meet in the join that makes the pairs, so that no pair is shuffled."""
    return _projected(_pairs(ratings, [c for c in PROFILE if c in ratings.columns]), league, home_advantage)


def _projected(rows: DataFrame, league: DataFrame, home_advantage: float = 2.5, adjust: tuple[str, str] | None = None) -> DataFrame:
    rows = rows.join(F.broadcast(league), "unit")
    half = F.when(F.col("neutral_site"), 0.0).otherwise(home_advantage / 2)
    add = [F.coalesce(F.col(c), F.lit(0.0)) for c in adjust] if adjust else [F.lit(0.0), F.lit(0.0)]
    points = lambda own, other, h, extra: clip(round_to(F.col("league_points") + F.col(f"{own}_offensive_rating") - F.col(f"{other}_defensive_rating") + h + extra), 3.0)
    rows = rows.withColumns({"home_expected_points": points("a", "b", half, add[0]), "away_expected_points": points("b", "a", -half, add[1])})
    spread, total = round_to(F.col("home_expected_points") - F.col("away_expected_points")), round_to(F.col("home_expected_points") + F.col("away_expected_points"))
    band = F.col("margin_std") / F.sqrt(F.lit(2.0))
    rows = rows.withColumns({"projected_spread_home": spread, "projected_total": total})
    return rows.withColumns(
        {
            "home_win_probability": clip(normal_cdf(F.col("projected_spread_home") / F.col("margin_std")), 0.01, 0.99),
            **{f"{s}_score_low": clip(F.col(f"{s}_expected_points") - band, 0.0) for s in ("home", "away")},
            **{f"{s}_score_high": F.col(f"{s}_expected_points") + band for s in ("home", "away")},
        }
    ).withColumns({"confidence_tier": confidence("home_win_probability"), "favored": pick_label("projected_spread_home", F.col("a_team_name"), F.col("b_team_name"))})


#: Blocks into which each side of a unit's pairs is dealt: a unit's pairs lie in the square of so many tasks' shares.
PAIR_BLOCKS = 16


def all_pairs(ratings: DataFrame) -> DataFrame:
    """Fixtures of every pair of teams inside a unit, on neutral ground; the number of pairs is what is asked for."""
    return _pairs(ratings, [])


def _pairs(ratings: DataFrame, profile: list[str]) -> DataFrame:
    """All pairs of a unit with the ``profile`` columns of both sides. Each side is dealt to blocks, and a task takes a pair of blocks."""
    block, others = F.pmod(F.xxhash64("team_id"), F.lit(PAIR_BLOCKS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1)))
    kinds = dict(ratings.dtypes)

    def side(s: str, key: str, own: str, other: str) -> DataFrame:
        known = [(F.col(c) if kinds[c] == "string" else F.coalesce(F.col(c), F.lit(0).cast(kinds[c]))).alias(f"{s}_{c}") for c in profile]
        return ratings.select("unit", F.col("team_id").alias(key), *known, block.alias(own), others.alias(other))

    a, b = side("a", "home_team_id", "_i", "_j"), side("b", "away_team_id", "_j", "_i")
    return a.join(b, ["unit", "_i", "_j"]).where("home_team_id < away_team_id").drop("_i", "_j").withColumn("neutral_site", F.lit(True))


def _edge(name: str, side: str, when: Column, own: Column, other: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("edge"), F.lit(side).alias("side"), own.cast("double").alias("own"), other.cast("double").alias("other")))


def situational_edges(projected: DataFrame) -> DataFrame:
    """Long form (game_id, edge, side, own, other): the six threshold rules of a matchup."""
    c = F.col
    out = [_edge("overall_rating", s, c(f"{s}_power_rating") > c(f"{o}_power_rating") + 5, c(f"{s}_power_rating"), c(f"{o}_power_rating")) for s, o in ("ab", "ba")]
    out += [_edge("offensive_efficiency", s, c(f"{s}_yards_per_play") - c(f"{o}_yards_per_play_allowed") > 0.6, c(f"{s}_yards_per_play"), c(f"{o}_yards_per_play_allowed")) for s, o in ("ab", "ba")]
    out += [_edge("third_down", s, c(f"{s}_third_down_rate") > c(f"{o}_third_down_rate_allowed") + 0.08, c(f"{s}_third_down_rate"), c(f"{o}_third_down_rate_allowed")) for s, o in ("ab", "ba")]
    out += [_edge("turnover_margin", s, c(f"{s}_turnover_margin_pg") - c(f"{o}_turnover_margin_pg") >= 0.7, c(f"{s}_turnover_margin_pg"), c(f"{o}_turnover_margin_pg")) for s, o in ("ab", "ba")]
    known = (c("a_success_rate") > 0) & (c("b_success_rate_allowed") > 0)
    better = {s: c(f"{s}_success_rate") > c(f"{o}_success_rate_allowed") + 0.04 for s, o in ("ab", "ba")}
    havoc = {s: (c(f"{s}_havoc_rate") >= 0.15) & (c(f"{s}_havoc_rate") > c(f"{o}_havoc_rate") + 0.03) for s, o in ("ab", "ba")}
    out.append(_edge("success_rate", "a", known & better["a"], c("a_success_rate"), c("b_success_rate_allowed")))
    out.append(_edge("success_rate", "b", known & better["b"] & ~better["a"], c("b_success_rate"), c("a_success_rate_allowed")))
    out.append(_edge("havoc", "a", havoc["a"], c("a_havoc_rate"), c("b_havoc_rate")))
    out.append(_edge("havoc", "b", havoc["b"], c("b_havoc_rate"), c("a_havoc_rate")))
    return projected.select("game_id", F.explode(F.array_compact(F.array(*out))).alias("e")).select("game_id", "e.*")


#: Metric, and whether less is better.
TAPE = (
    ("power_rating", False), ("offensive_rating", False), ("defensive_rating", False), ("strength_of_schedule", False), ("recent_form_rating", False),
    ("yards_per_play", False), ("yards_per_play_allowed", True), ("passing_yards_per_play", False), ("rushing_yards_per_play", False), ("third_down_rate", False),
    ("third_down_rate_allowed", True), ("red_zone_td_rate", False), ("red_zone_td_rate_allowed", True), ("turnover_margin_pg", False), ("penalty_yards_pg", True), ("wins", False), ("rank", True),
    ("success_rate", False), ("ppa_per_play", False), ("explosiveness", False), ("havoc_rate", False),
)

#: Difference up to which two values of a metric are the same. Rounding would part equal ones that lie about the middle of two digits.
SAME = 1e-10


def tale_of_tape(projected: DataFrame) -> DataFrame:
    """Long form (game_id, metric, a, b, better_side): the better side of a metric, ``b`` where they are within ``SAME`` of each other, since
    means of the same values differ by the order of their sums."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").cast("double").alias("a"), F.col(f"b_{m}").cast("double").alias("b"), F.lit(less).alias("less")) for m, less in TAPE))
    long = projected.select("game_id", F.explode(rows).alias("t")).select("game_id", "t.*")
    gain = F.col("a") - F.col("b")
    better = F.when(F.col("less"), gain < -SAME).otherwise(gain > SAME)
    return long.select("game_id", "metric", "a", "b", F.when(better, "a").otherwise("b").alias("better_side"))


def slate_summary(projected: DataFrame, by: list[str]) -> DataFrame:
    return projected.groupBy(*by).agg(
        F.count("*").alias("games"), F.avg("projected_total").alias("mean_total"), F.avg(F.abs("projected_spread_home")).alias("mean_abs_spread"),
        F.avg((F.col("projected_spread_home") > 0).cast("int")).alias("home_favored"),
    )


def filter_slate(projected: DataFrame, value_only: bool = False, name: str | None = None) -> DataFrame:
    """Only plays with a value tier above fair; only games of a team whose name contains a text."""
    out = projected
    if value_only:
        out = out.where(F.col("value_tier").isin("Strong Value", "Moderate Value"))
    if name:
        hit = reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(name.lower())) for c in ("home_team", "away_team")))
        out = out.where(hit)
    return out
