"""Market lines: one line a game, edges of a projection against it, and graded records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, round_to

#: The order in which providers are preferred; any other comes after them, in the order of the array.
PROVIDERS = ("consensus", "DraftKings", "Bovada", "ESPN Bet", "FanDuel", "Caesars")


def priority(provider: str | Column) -> Column:
    out = F.lit(len(PROVIDERS))
    for i in range(len(PROVIDERS) - 1, -1, -1):
        out = F.when(F.lower(col(provider)) == PROVIDERS[i].lower(), i).otherwise(out)
    return out


def consensus_lines(lines: DataFrame) -> DataFrame:
    """One line a game from (game_id, provider, spread, over_under, pos): the first usable by provider, else by position.

    A line is usable if it has a spread or a total. The names of both teams stay, where the lines have them.
    """
    usable = lines.where(F.col("spread").isNotNull() | F.col("over_under").isNotNull())
    names = [c for c in ("home_name", "away_name") if c in lines.columns]
    best = F.min_by(F.struct("provider", "spread", "over_under", *names), F.struct(priority("provider").alias("p"), F.col("pos")))
    picked = {"provider": "provider", "market_spread": "spread", "market_total": "over_under"} | {n: n for n in names}
    return usable.groupBy("game_id").agg(best.alias("l")).select("game_id", *(F.col(f"l.{c}").alias(n) for n, c in picked.items()))


def attach_lines(forecasts: DataFrame, lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Forecasts with their line: by game id, else by the lower-cased names of both teams; the line is taken as a whole.

    ``lines`` has game_id (text or number), market_spread, market_total; ``names`` has home_name, away_name and the same two, and is
    ``lines`` itself if that has names. Of several lines of a game or of a pair of names the one of the smallest game id counts.
    """
    if names is None and {"home_name", "away_name"} <= set(lines.columns):
        names = lines
    whole = F.struct("market_spread", "market_total")
    by_id = lines.where("game_id IS NOT NULL").groupBy(F.col("game_id").cast("string").alias("_gid")).agg(F.min(whole).alias("_line"))
    out = forecasts.join(by_id, F.col("game_id").cast("string") == F.col("_gid"), "left")
    line = F.col("_line")
    if names is not None:
        first = F.struct(F.col("game_id").try_cast("bigint") if "game_id" in names.columns else F.lit(0), whole)
        by_name = names.groupBy(F.lower("home_name").alias("_h"), F.lower("away_name").alias("_a")).agg(F.min_by(whole, first).alias("_named"))
        out = out.join(by_name, (F.lower("home_team") == F.col("_h")) & (F.lower("away_team") == F.col("_a")), "left")
        line = F.coalesce("_line", "_named")
    picked = out.withColumn("_pick", line)
    return picked.select(*forecasts.columns, F.col("_pick.market_spread").alias("market_spread"), F.col("_pick.market_total").alias("market_total"))


def market_edges(df: DataFrame, home: str = "home_expected_points", away: str = "away_expected_points") -> DataFrame:
    """Model spread and total, their edges against the line, the value tier and notes."""
    out = df.withColumns({"model_home_spread": round_to(F.col(away) - F.col(home)), "model_total": round_to(F.col(home) + F.col(away))})
    out = out.withColumns({"spread_edge": round_to(F.col("market_spread") - F.col("model_home_spread")), "total_edge": round_to(F.col("model_total") - F.col("market_total"))})
    s, t = F.coalesce(F.abs("spread_edge"), F.lit(0.0)), F.coalesce(F.abs("total_edge"), F.lit(0.0))
    value = F.when((s >= 3.5) | (t >= 4.0), "Strong Value").when((s >= 2.0) | (t >= 2.5), "Moderate Value").otherwise("Fair / Aligned")
    side = F.when(F.col("spread_edge") > 0, "Home").otherwise("Away")
    over = F.when(F.col("total_edge") > 0, "OVER").otherwise("UNDER")
    notes = F.array_compact(
        F.array(
            F.when(F.col("spread_edge").isNotNull() & (s >= 1.5), F.format_string("%s Spread Edge: %+.1f pts", side, s)),
            F.when(F.col("total_edge").isNotNull() & (t >= 2.0), F.format_string("%s Edge: %+.1f pts", over, t)),
        )
    )
    return out.withColumns({"value_tier": value, "edge_notes": notes})


def grade_market(predictions: DataFrame, games: DataFrame) -> DataFrame:
    """Predictions with lines and edges against completed games: ``ats`` and ``ou`` are win, loss, push, or null where not played."""
    done = games.where("completed").select("game_id", "home_score", "away_score")
    rows = predictions.join(done, "game_id")
    cover = F.col("home_score") - F.col("away_score") + F.col("market_spread")
    over = F.col("home_score") + F.col("away_score") - F.col("market_total")
    grade = lambda metric, edge: F.when(F.abs(metric) < 0.1, "push").when((metric > 0) == (F.col(edge) > 0), "win").otherwise("loss")
    return rows.withColumns(
        {
            "ats": F.when(F.col("market_spread").isNotNull() & (F.abs("spread_edge") >= 0.5), grade(cover, "spread_edge")),
            "ou": F.when(F.col("market_total").isNotNull() & (F.abs("total_edge") >= 1.0), grade(over, "total_edge")),
        }
    )


def market_record(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Wins, losses, pushes and win share of both kinds of bets."""
    aggs = []
    for kind in ("ats", "ou"):
        n = {r: F.count_if(F.col(kind) == r) for r in ("win", "loss", "push")}
        aggs += [n["win"].alias(f"{kind}_wins"), n["loss"].alias(f"{kind}_losses"), n["push"].alias(f"{kind}_pushes")]
        aggs.append(F.coalesce(round_to(F.try_divide(n["win"].cast("double"), (n["win"] + n["loss"]).cast("double")), 3), F.lit(0.0)).alias(f"{kind}_win_pct"))
    return (graded.groupBy(*by) if by else graded).agg(*aggs)
