"""User-level pipelines: chains of the operators that publish their tables as runs of a ``Store``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, features, grade, models, project, ratings, upcoming, validate, versions
from ..schema import ROLLING
from ..sources import raw_json
from ..sources.store import Store, cut


@dataclass
class Dataset:
    games: DataFrame
    stats: DataFrame


def load(store: Store, run_id: str | None = None) -> Dataset:
    """A published dataset, by default the newest, verified."""
    run_id = run_id or store.newest("dataset")
    if run_id is None:
        raise ValueError("no dataset is published")
    return Dataset(store.load("games", run_id), store.load("team_game_stats", run_id))


def train(store: Store, run_id: str, data: Dataset, as_of: str | None = None) -> models.Ridge:
    """Validate, build features, fit the score models, and publish predictions of all games and their accuracy."""
    validate.strict(validate.games(data.games))
    validate.strict(validate.stats(data.stats, data.games))
    validate.strict(validate.training(data.games))
    own = cut(features.team_pregame_features(data.games, data.stats))  # checked, joined to games and published
    validate.strict(validate.features(own))
    matchups = cut(features.matchup_features(data.games, own))
    model = models.fit_ridge(matchups.where("completed"), features.model_features(matchups))
    predicted = cut(models.predict_ridge(matchups, model))
    long = predicted.select("home_score", "away_score", "home_win_probability", F.col("home_expected_points").alias("home_points"), F.col("away_expected_points").alias("away_points"), F.lit("ridge").alias("model"))
    metrics = evaluate.long_metrics(evaluate.model_metrics(long), ["model"])
    store.publish(run_id, "model", {"predictions": predicted, "team_features": own, "metrics": metrics}, as_of, model="ridge", sort={"predictions": ["game_date", "game_id"]})
    return model


def power_rankings(store: Store, run_id: str, data: Dataset, teams: DataFrame, s: ratings.Settings = ratings.Settings(), **given) -> DataFrame:
    rated = cut(ratings.fit_ratings(data.games, data.stats, teams, s=s, **given))
    store.publish(run_id, "ratings", {"ratings": rated, "conferences": ratings.conference_table(rated), "profiles": ratings.export_profile(rated)}, sort={"ratings": ["unit", "rank"]})
    return rated


def compare(data: Dataset, rated: DataFrame, fixtures: DataFrame, s: ratings.Settings = ratings.Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projections, edges, tape) of fixtures (game_id, unit, home_team_id, away_team_id, neutral_site)."""
    out = cut(project.project(fixtures, rated, ratings.league_summary(data.games, data.stats, s), s.home_advantage))
    return out, project.situational_edges(out), project.tale_of_tape(out)


def merge(games: DataFrame, stats: DataFrame, decisions: DataFrame | None = None, token: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(games, stats, upgraded) of versions of games and stats (with run_id and captured_at), checked; conflicts need decisions."""
    if decisions is not None:
        plan = cut(versions.review_plan(games, stats))
        games = cut(versions.apply_decisions(games, plan, decisions, token))
        chosen = decisions.select("game_id", F.col("run_id").alias("_chosen"))
        stats = stats.join(chosen, "game_id", "left").where("_chosen IS NULL OR run_id = _chosen").drop("_chosen")
    # what is settled and what is in conflict is told in one reading of the versions, and written once
    merged, conflicts, upgraded = versions.split_games(cut(versions.settled_games(games)))
    boxes, box_conflicts = versions.split_stats(cut(versions.settled_stats(stats)))
    if not conflicts.isEmpty() or not box_conflicts.isEmpty():
        raise validate.ValidationError("versions are in conflict; review them")
    validate.strict(validate.consistency(merged, boxes))
    return merged, boxes, upgraded


def assemble(store: Store, run_id: str, games: DataFrame, stats: DataFrame, decisions: DataFrame | None = None, token: str | None = None) -> Dataset:
    """Publish the dataset to which versions of games and stats merge."""
    merged, boxes, upgraded = merge(games, stats, decisions, token)
    store.publish(run_id, "dataset", {"games": merged, "team_game_stats": boxes, "upgraded": upgraded}, sort={"games": ["game_date", "game_id"], "team_game_stats": ["game_id", "team_id"]})
    return Dataset(store.written("games", run_id), store.written("team_game_stats", run_id))


def normalise(store: Store, run_id: str, schedule: DataFrame, boxes: DataFrame) -> Dataset:
    """Landed schedule and box JSON to a published snapshot with its exclusions; any broken rule within the scope raises."""
    scope = cut(raw_json.capture_scope(schedule))
    kept = scope.where("reason IS NULL").select("game_id")
    games, rejected = raw_json.read_schedule(schedule)
    bad = rejected.join(kept, "game_id", "left_semi")
    validate.strict(bad)
    games = cut(games.join(kept, "game_id", "left_semi"))
    stats, refused = raw_json.read_boxes(boxes, games)
    validate.strict(refused.join(kept, "game_id", "left_semi"))
    store.publish(run_id, "snapshot", {"snapshot_games": games, "snapshot_stats": stats, "exclusions": scope.where("reason IS NOT NULL")})
    return Dataset(store.load("snapshot_games", run_id), store.load("snapshot_stats", run_id))


def forecast(store: Store, run_id: str, data: Dataset, teams: DataFrame, lines: DataFrame, as_of: str, s: ratings.Settings = ratings.Settings(), min_history: int = 3, rated: DataFrame | None = None) -> DataFrame:
    """Publish forecasts of the upcoming games, the skipped ones with reasons, and warnings."""
    todo, skipped = upcoming.split_upcoming(data.games, as_of)
    if rated is None:
        rated = ratings.fit_power(data.games, data.stats, teams, s=s)  # no more of a profile is asked for
    league = ratings.league_summary(data.games, data.stats, s)
    out = cut(upcoming.finish(upcoming.rated_forecast(todo, data.games, rated, league, s.home_advantage), teams, lines, min_history))
    note = upcoming.run_warnings(out, data.games, as_of).first()
    warnings = [w for w, on in (("low history", note["low_history"]), ("results missing", note["missing_results"]), ("newest result is old", note["stale"])) if on]
    store.publish(run_id, "forecast", {"forecasts": out, "skipped": skipped, "skip_reasons": grade.reason_counts(skipped)}, as_of, model="ratings", warnings=warnings, sort={"forecasts": ["game_date", "game_id"]})
    return out


def walk_forward(store: Store, run_id: str, data: Dataset, names: list[str] | None = None, baseline: str = "rolling_average", min_periods: int = 2, registry: models.Registry | None = None) -> DataFrame:
    """Out-of-sample predictions of every period by the registered models, ridges among them; publishes weekly and overall metrics,
    improvement over the baseline and calibration."""
    metrics = models.COLUMN_METRICS if names and set(names) <= set(models.COLUMN_MODELS) and registry is None else ROLLING
    own = features.team_pregame_features(data.games, data.stats, metrics)
    periods = cut(features.matchup_features(models.with_periods(data.games), own, metrics))
    summary = models.training_summary(periods)
    predicted = cut(models.predict(models.eligible(periods, summary, min_periods), names, periods, registry))
    overall = cut(evaluate.model_metrics(predicted))
    tables = {
        "walk_predictions": predicted, "walk_weekly": evaluate.model_metrics(predicted, ("model", "period")), "walk_overall": overall,
        "walk_calibration": evaluate.calibration_bins(predicted), "walk_improvement": evaluate.improvement(overall, baseline), "walk_skipped": models.skipped_periods(periods, summary, min_periods),
    }
    store.publish(run_id, "walk_forward", tables, sort={"walk_predictions": ["ord", "game_id"]})
    return overall


def results(store: Store, run_id: str, finals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Grade saved forecasts against results; publishes the report, what was not scored or excluded, and the summary."""
    cands = grade.candidates(finals, forecasts)
    report = cut(grade.results_report(finals, forecasts))
    left_out = cut(grade.excluded(cands))
    tables = {"report_counts": grade.report_counts(report, left_out), "report_games": report, "report_not_scored": report.where("status <> 'scored'").select("game_id", "status"), "report_summary": grade.report_summary(report), "report_excluded": left_out}
    store.publish(run_id, "report", tables)
    return report


def weekly_update(store: Store, run_id: str, games: DataFrame, stats: DataFrame, teams: DataFrame, lines: DataFrame, forecasts: DataFrame | None, as_of: str, season: int, week: int) -> DataFrame:
    """Assemble, activate, evaluate the last week, calibrate, refit and forecast."""
    return weekly_forecast(store, run_id, assemble(store, f"{run_id}-data", games, stats), teams, lines, forecasts, as_of, season, week)


def weekly_forecast(store: Store, run_id: str, data: Dataset, teams: DataFrame, lines: DataFrame, forecasts: DataFrame | None, as_of: str, season: int, week: int) -> DataFrame:
    """The weekly update of a dataset that is assembled."""
    data.games.createOrReplaceTempView("current_games")  # as ``Store.activate`` does, of tables that were verified when written
    data.stats.createOrReplaceTempView("current_team_game_stats")
    evaluation = None
    if forecasts is not None:
        done = data.games.where(F.col("completed") & (F.col("season") == season) & (F.col("week") == week))
        evaluation = cut(grade.weekly_evaluation(done, forecasts))
    this = data.games.where(F.col("season") == season)
    calibration = grade.calibrate(this, evaluation).first()
    # the calibrated edge reaches the published ranking; the forecasts keep the default, as parameters may say otherwise
    power_rankings(store, f"{run_id}-ratings", data, teams, ratings.Settings(home_advantage=calibration["calibrated_hfa"]))
    return forecast(store, f"{run_id}-forecast", data, teams, lines, as_of)


def refresh(store: Store, run_id: str, schedules: DataFrame, boxes: DataFrame, teams: DataFrame, lines: DataFrame, as_of: str) -> DataFrame:
    """Several weeks' landed JSON in one job: normalise, assemble and forecast."""
    snap = normalise(store, f"{run_id}-snapshot", schedules, boxes)
    stamp = {"run_id": F.lit(f"{run_id}-snapshot"), "captured_at": F.lit(as_of).cast("timestamp")}
    data = assemble(store, f"{run_id}-data", snap.games.withColumns(stamp), snap.stats.withColumns(stamp))
    return forecast(store, f"{run_id}-forecast", data, teams, lines, as_of)
