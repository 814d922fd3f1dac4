"""Grading saved forecasts against results: eligibility, latest forecast, errors, summaries, weekly evaluation and calibration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import round_to

REPORT = (
    "game_id", "home_team_id", "away_team_id", "status", "actual_home_points", "actual_away_points", "home_expected_points", "away_expected_points", "projected_spread_home",
    "projected_total", "home_win_probability", "low_history", "model", "source_run", "actual_margin_home", "actual_total", "predicted_winner", "actual_winner", "winner_correct",
    "home_absolute_error", "away_absolute_error", "margin_absolute_error", "total_absolute_error", "brier",
)


def candidates(results: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every forecast of every result's game, with ``reason`` if it isn't eligible.

    ``results``: game_id, home_team_id, away_team_id, kickoff (null: unconfirmed), completed, home_score, away_score.
    """
    r = results.select("game_id", F.col("home_team_id").alias("_h"), F.col("away_team_id").alias("_a"), "kickoff")
    reason = (
        F.when((F.col("home_team_id") != F.col("_h")) | (F.col("away_team_id") != F.col("_a")), "team_identity_mismatch")
        .when(F.col("kickoff").isNull(), "unconfirmed_kickoff")
        .when(F.greatest("created", "as_of") >= F.least("kickoff", "saved_kickoff"), "not_created_and_asof_before_both_kickoffs")
    )
    return forecasts.join(r, "game_id").withColumn("reason", reason).drop("_h", "_a")


def excluded(cands: DataFrame) -> DataFrame:
    return cands.where("reason IS NOT NULL").select("game_id", "source_run", "reason")


def latest_eligible(cands: DataFrame) -> DataFrame:
    """The forecast of a game that was created last; ties go to the larger run id."""
    ok = cands.where("reason IS NULL")
    w = Window.partitionBy("game_id").orderBy(F.desc("created"), F.desc("source_run"))
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "reason", "kickoff")


def results_report(results: DataFrame, forecasts: DataFrame) -> DataFrame:
    """A row a result: its status, the forecast that counts, and the errors if it can be scored."""
    own = latest_eligible(candidates(results, forecasts)).drop("home_team_id", "away_team_id", "season", "week")
    rows = results.join(own, "game_id", "left")
    picked = F.col("source_run").isNotNull()
    status = (
        F.when(picked & F.col("completed") & F.col("kickoff").isNotNull(), "scored").when(F.col("kickoff").isNull(), "unconfirmed_kickoff")
        .when(~picked, "no_eligible_prediction").otherwise("result_pending")
    )
    rows = rows.withColumns({"status": status, "actual_home_points": F.when(F.col("completed"), F.col("home_score")), "actual_away_points": F.when(F.col("completed"), F.col("away_score"))})
    scored = F.col("status") == "scored"
    margin = F.col("actual_home_points") - F.col("actual_away_points")
    spread = F.col("projected_spread_home")
    rows = rows.withColumns(
        {
            "actual_margin_home": F.when(scored, margin), "actual_total": F.when(scored, F.col("actual_home_points") + F.col("actual_away_points")),
            "predicted_winner": F.when(spread > 0, "home").when(spread < 0, "away").when(spread.isNotNull(), "no_pick"),
            "actual_winner": F.when(scored, F.when(margin > 0, "home").when(margin < 0, "away").otherwise("tie")),
            "home_absolute_error": F.when(scored, F.abs(F.col("home_expected_points") - F.col("actual_home_points"))),
            "away_absolute_error": F.when(scored, F.abs(F.col("away_expected_points") - F.col("actual_away_points"))),
            "margin_absolute_error": F.when(scored, F.abs(spread - margin)),
            "total_absolute_error": F.when(scored, F.abs(F.col("projected_total") - F.col("actual_home_points") - F.col("actual_away_points"))),
            "brier": F.when(scored & (margin != 0), F.pow(F.col("home_win_probability") - (margin > 0).cast("int"), 2)),
        }
    )
    correct = F.when(F.col("brier").isNotNull() & (F.col("predicted_winner") != "no_pick"), F.col("predicted_winner") == F.col("actual_winner"))
    return rows.withColumn("winner_correct", correct).select(*REPORT)


def report_summary(report: DataFrame) -> DataFrame:
    """Accuracy of all scored games, of those with low history and of the others: three rows always."""
    groups = F.array(
        F.struct(F.lit("all").alias("group"), F.lit(True).alias("own")),
        F.struct(F.lit("low_history").alias("group"), F.col("low_history").alias("own")),
        F.struct(F.lit("established_history").alias("group"), (~F.col("low_history")).alias("own")),
    )
    names = report.sparkSession.createDataFrame([("all",), ("low_history",), ("established_history",)], "group string")
    rows = report.where("status = 'scored'").withColumn("g", F.explode(groups)).where("g.own").withColumn("group", F.col("g.group"))
    agg = rows.groupBy("group").agg(
        F.count("*").alias("games_scored"), F.count("winner_correct").alias("winner_picks"), F.count_if("winner_correct").alias("correct_picks"),
        F.avg(F.col("winner_correct").cast("double")).alias("winner_accuracy"), F.count("brier").alias("brier_games"), F.avg("brier").alias("brier_score"),
        ((F.avg("home_absolute_error") + F.avg("away_absolute_error")) / 2).alias("score_mae"), F.avg("margin_absolute_error").alias("margin_mae"), F.avg("total_absolute_error").alias("total_mae"),
    )
    counts = ("games_scored", "winner_picks", "correct_picks", "brier_games")
    return names.join(agg, "group", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def covering_runs(week_games: DataFrame, forecasts: DataFrame, share: float = 0.7) -> DataFrame:
    """Forecasts of the week's games from the newest runs, until one run alone covers ``share`` of the games."""
    own = forecasts.join(week_games.select("game_id"), "game_id", "left_semi")
    n = week_games.agg(F.count("*").alias("_games"))
    runs = own.groupBy("source_run").agg(F.count("*").alias("hits")).crossJoin(F.broadcast(n))
    before = Window.orderBy(F.desc("source_run")).rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    used = runs.withColumn("_done", F.coalesce(F.max((F.col("hits") >= F.col("_games") * share).cast("int")).over(before), F.lit(0))).where("_done = 0")
    return own.join(F.broadcast(used.select("source_run")), "source_run", "left_semi")


def weekly_evaluation(week_games: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row: coverage, accuracy (ties count as wrong), errors, Brier score and bias; a game's newest run counts."""
    w = Window.partitionBy("game_id").orderBy(F.desc("source_run"))
    first = covering_runs(week_games, forecasts).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    rows = week_games.select("game_id", "home_score", "away_score").join(first.select("game_id", "projected_spread_home", "projected_total", "home_win_probability"), "game_id", "left")
    hit = F.col("projected_spread_home").isNotNull()
    margin, total = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    correct = ((F.col("projected_spread_home") > 0) == (margin > 0)) & (margin != 0)
    won = (margin > 0).cast("int")
    mean = lambda c: F.avg(F.when(hit, c))
    return rows.agg(
        F.count("*").alias("games_in_scope"), F.count_if(hit).alias("scored"), mean(correct.cast("double")).alias("winner_accuracy"),
        mean(F.abs(F.col("projected_spread_home") - margin)).alias("margin_mae"), mean(F.abs(F.col("projected_total") - total)).alias("total_mae"),
        mean(F.pow(F.col("home_win_probability") - won, 2)).alias("brier_score"), mean(margin - F.col("projected_spread_home")).alias("margin_bias"),
    )


def calibrate(games: DataFrame, margin_mae: DataFrame | None = None) -> DataFrame:
    """One row: home advantage shrunk to 2.5 by ten games, margin deviation from the error or the sample, both clamped.

    ``margin_mae`` is a one-row DataFrame with that column, as from ``weekly_evaluation``.
    """
    m = F.col("home_score") - F.col("away_score")
    open_ = ~F.col("neutral_site")
    agg = games.where("completed").agg(F.count("*").alias("n"), F.count_if(open_).alias("k"), F.avg(F.when(open_, m)).alias("mean"), F.stddev_samp(m).alias("std"))
    agg = agg.crossJoin(margin_mae.select("margin_mae")) if margin_mae is not None else agg.withColumn("margin_mae", F.lit(None).cast("double"))
    k = F.col("k").cast("double")
    edge = F.when(F.col("k") > 0, round_to(10 / (10 + k) * 2.5 + k / (10 + k) * F.col("mean"), 2)).otherwise(2.5)
    std = F.when(F.col("margin_mae") > 0, round_to(F.col("margin_mae") * math.sqrt(math.pi / 2), 2)).when(F.col("n") > 1, round_to("std", 2)).otherwise(13.5)
    return agg.select(
        F.when(F.col("n") == 0, 2.5).otherwise(F.greatest(F.lit(0.5), F.least(edge, F.lit(5.0)))).alias("calibrated_hfa"),
        F.when(F.col("n") == 0, 13.5).otherwise(F.greatest(F.lit(8.0), F.least(std, F.lit(20.0)))).alias("margin_std"),
        F.col("n").alias("sample_size"), F.coalesce(round_to("mean", 2), F.lit(2.5)).alias("actual_home_margin_avg"),
    )


def report_counts(report: DataFrame, left_out: DataFrame) -> DataFrame:
    """One row: games in scope, scored or not, forecasts left out, and completed games without a forecast."""
    games = report.agg(
        F.count("*").alias("games_in_scope"), F.count_if(F.col("status") == "scored").alias("scored"), F.count_if(F.col("status") != "scored").alias("not_scored"),
        F.count_if(F.col("actual_home_points").isNotNull() & F.col("source_run").isNull()).alias("completed_without_prediction"),
    )
    return games.crossJoin(F.broadcast(left_out.agg(F.count("*").alias("excluded_candidates"))))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def used_warnings(runs: DataFrame, report: DataFrame) -> DataFrame:
    """Warnings of the runs that a report took forecasts from."""
    used = report.select(F.col("source_run").alias("run_id")).distinct()
    return runs.join(used, "run_id", "left_semi").select("run_id", F.explode("warnings").alias("warning"))
