"""Hand-computed values, leakage and invariants of the league operators."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom import functions as fn
from ratingloom.operators import dimensions, evaluate, features, grade, market, models, project, ratings, upcoming, validate, versions
from ratingloom.schema import GAMES, STATS
from ratingloom.sources import raw_json, store

START = datetime(2026, 9, 1)


def season(spark, teams=6, weeks=8, strength=3.0, seed=1, home=2.0):
    """A round of games a week; team k scores more the larger k is."""
    rng = np.random.default_rng(seed)
    games, stats, gid = [], [], 0
    for w in range(1, weeks + 1):
        order = rng.permutation(np.arange(1, teams + 1)).tolist()
        for h, a in zip(order[::2], order[1::2]):
            gid += 1
            p = {t: max(0, round(24 + strength * (t - (teams + 1) / 2) - strength * (o - (teams + 1) / 2) + (home if t == h else -home) / 2 + rng.normal(0, 2))) for t, o in ((h, a), (a, h))}
            games.append((gid, 2026, w, START + timedelta(days=7 * w, hours=gid), h, a, p[h], p[a], False, True))
            for t, o, is_home in ((h, a, True), (a, h, False)):
                stats.append((gid, t, o, is_home, p[t], p[o], 300 + 10 * t, 60, 200, 100 + 10 * t, 1, 1, 12, 5, 3, 2, 5, 40, 1800))
    return spark.createDataFrame(games, GAMES), spark.createDataFrame(stats, STATS)


@pytest.fixture(scope="module")
def league(spark):
    games, stats = season(spark)
    teams = spark.createDataFrame([(k, f"Team {k}", "East" if k % 2 else "West") for k in range(1, 7)], "team_id bigint, name string, conference string")
    return games.cache(), stats.cache(), teams.cache()


def test_scalars(spark):
    r = spark.range(1).select(
        fn.safe_divide(F.lit(1), F.lit(0)).alias("zero"), fn.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("null"), fn.round_to(F.lit(0.25), 1).alias("half"),
        fn.normal_cdf(F.lit(1.0)).alias("phi"), fn.normal_cdf(F.lit(-1.0)).alias("ihp"), fn.mean_of(F.lit(None).cast("double"), F.lit(3.0)).alias("one"),
        fn.neutralise(F.lit("=1+1")).alias("safe"), fn.zoned_timestamp(F.lit("2026-08-29T16:00:00")).alias("zoneless"), fn.parse_kickoff(fn.kickoff_text(F.lit("2026-08-29 16:00:00").cast("timestamp"))).alias("back"),
        fn.tier(F.lit(14.0)).alias("tier"), fn.confidence(F.lit(0.675)).alias("high"), fn.model_confidence(F.lit(0.66)).alias("medium"),
    ).first()
    assert r.zero is None and r.null is None and r.half == pytest.approx(0.3) and r.one == 3.0 and r.safe == "'=1+1" and r.zoneless is None
    assert r.phi == pytest.approx(0.5 * (1 + math.erf(1 / math.sqrt(2))), abs=2e-7) and r.phi + r.ihp == pytest.approx(1)
    assert r.back == datetime(2026, 8, 29, 16) and (r.tier, r.high, r.medium) == ("Tier 1: Elite", "High", "Medium")
    assert fn.snake_case("successRatesOverall") == "success_rates_overall"


def test_features_look_back_only(spark, league):
    games, stats, _ = league
    own = features.team_pregame_features(games, stats).orderBy("team_id", "game_date").toPandas()
    one = own[own.team_id == 1].reset_index(drop=True)
    assert one.points_l3.isna()[0] and one.points_l3[1] == one.points[0] and one.points_season[3] == pytest.approx(one.points[:3].mean())
    changed = stats.withColumn("points", F.when(F.col("game_id") > 21, 99).otherwise(F.col("points")))
    again = features.team_pregame_features(games, changed).orderBy("team_id", "game_date").toPandas()
    assert again[again.week < 8].points_l5.fillna(-1).tolist() == own[own.week < 8].points_l5.fillna(-1).tolist()


def test_ratings_order_and_strategies(spark, league):
    games, stats, teams = league
    a = ratings.fit_ratings(games, stats, teams, strategy="grouped").orderBy("team_id").toPandas()
    b = ratings.fit_ratings(games, stats, teams, strategy="rounds").orderBy("team_id").toPandas()
    for c in ("power_rating", "offensive_rating", "defensive_rating", "strength_of_schedule", "recent_form_rating"):
        assert np.allclose(a[c], b[c], atol=1e-9)
    assert a.sort_values("power_rating").team_id.tolist() == [1, 2, 3, 4, 5, 6]
    assert np.allclose(a.power_rating, a.offensive_rating + a.defensive_rating)
    wide = ratings.fit_ratings(games, stats, teams, s=ratings.Settings(conference_weight=0.9)).toPandas()
    gap = lambda d: abs(d[d.conference == "East"].power_rating.mean() - d[d.conference == "West"].power_rating.mean())
    assert gap(wide) > gap(a)


def test_advanced_metrics_find_their_team_by_id_text_or_name(spark, league):
    games, stats, teams = league
    named = spark.createDataFrame([("1", 0.1, 0.2), ("Team 2", 0.3, 0.4), ("Nobody", 0.9, 0.9), ("Team 1", 0.8, 0.8)], "team string, success_rate double, havoc_rate double")
    got = {r.team_id: (r.success_rate, r.havoc_rate, r.explosiveness) for r in ratings.fit_ratings(games, stats, teams, named).collect()}
    assert got[1] == (0.1, 0.2, 0.0) and got[2] == (0.3, 0.4, 0.0) and got[3] == (0.0, 0.0, 0.0) and len(got) == 6


def test_large_units_take_the_path_of_rounds(spark, league, monkeypatch):
    games, stats, teams = league
    monkeypatch.setattr(ratings, "GROUPED_EDGES", 10)
    monkeypatch.setattr(ratings, "_grouped", None)
    got = {r.team_id: r.power_rating for r in ratings.fit_ratings(games, stats, teams).collect()}
    monkeypatch.undo()
    want = {r.team_id: r.power_rating for r in ratings.fit_ratings(games, stats, teams).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_season_types_are_periods_of_their_own(spark):
    rows = [(i, 2026, 1, START + timedelta(days=120 * (i > 2)), 1, 2, 10, 7, False, True, "postseason" if i > 2 else "regular") for i in range(1, 5)]
    g = spark.createDataFrame(rows, GAMES.simpleString()[7:-1].replace(":", " ") + ", season_type string")
    assert {(r.period, r.ord, r["count"]) for r in models.with_periods(g).groupBy("period", "ord").count().collect()} == {("2026 regular week 1", 1, 2), ("2026 postseason week 1", 2, 2)}
    merged, _, _ = versions.merge_games(g.withColumns({"run_id": F.lit("a"), "captured_at": F.lit(START)}))
    assert {r.season_type for r in merged.collect()} == {"regular", "postseason"}


def test_run_warnings(spark):
    g = spark.createDataFrame([(1, 2026, 1, START, 1, 2, 10, 7, False, True), (2, 2026, 2, START + timedelta(days=5), 1, 2, None, None, False, False)], GAMES)
    f = spark.createDataFrame([(True,), (False,)], "low_history boolean")
    late = upcoming.run_warnings(f, g, "2026-09-20 00:00:00").first()
    assert (late.forecasts, late.low_history, late.missing_results, late.stale) == (2, 1, 1, True)
    assert upcoming.run_warnings(f, g, "2026-09-03 00:00:00").first().stale is False


def test_priors_and_cutoff(spark, league):
    games, stats, teams = league
    priors = spark.createDataFrame([(1, 20.0)], "team_id bigint, prior double")
    talent = spark.createDataFrame([(k, 100.0 + k) for k in range(1, 7)], "team_id bigint, score double")
    p = {r.team_id: r.prior for r in ratings.team_priors(stats, priors, talent).collect()}
    assert p[1] == 20.0 and p[2] == pytest.approx((102 - 103.5) * 0.25)
    base = {r.team_id: r.power_rating for r in ratings.fit_ratings(games, stats, teams).collect()}
    lifted = {r.team_id: r.power_rating for r in ratings.fit_ratings(games, stats, teams, priors=priors).collect()}
    assert lifted[1] > base[1]
    early = ratings.fit_ratings(games, stats, teams, cutoff="2026-10-01").toPandas()
    assert early.games_played.max() < 8


def test_home_edge_and_adjustment_shift_the_spread(spark, league):
    games, stats, teams = league
    rated = ratings.fit_ratings(games, stats, teams).cache()
    lg = ratings.league_summary(games, stats)
    fx = spark.createDataFrame([(1, 2026, 6, 5, False, 0.0), (2, 2026, 6, 5, True, 0.0), (3, 2026, 6, 5, True, 4.0), (4, 2026, 6, 99, True, 0.0)], "game_id bigint, unit int, home_team_id bigint, away_team_id bigint, neutral_site boolean, plus double")
    p = {r.game_id: r for r in project.project(fx, rated, lg, adjust=("plus", "plus")).collect()}
    zero = {r.game_id: r for r in project.project(fx.withColumn("none", F.lit(0.0)), rated, lg, adjust=("plus", "none")).collect()}
    assert p[1].projected_spread_home - p[2].projected_spread_home == pytest.approx(2.5, abs=0.2)
    assert zero[3].projected_spread_home - zero[2].projected_spread_home == pytest.approx(4.0, abs=0.11)
    assert p[4].b_power_rating == 0.0 and 0.01 <= p[4].home_win_probability <= 0.99


def test_market_hand_values(spark):
    lines = spark.createDataFrame([(1, "other", -3.0, 50.0, 0), (1, "DraftKings", None, None, 1), (1, "Bovada", -4.0, None, 2), (2, "other", None, None, 0), (3, "zzz", None, 41.0, 1), (3, "aaa", 1.0, 40.0, 0)], "game_id bigint, provider string, spread double, over_under double, pos int")
    got = {r.game_id: (r.market_spread, r.market_total) for r in market.consensus_lines(lines).collect()}
    assert got == {1: (-4.0, None), 3: (1.0, 40.0)}
    f = spark.createDataFrame([(1, 31.0, 24.0, -3.5, 50.0), (2, 20.0, 20.0, None, None)], "game_id bigint, home_expected_points double, away_expected_points double, market_spread double, market_total double")
    e = {r.game_id: r for r in market.market_edges(f).collect()}
    assert (e[1].model_home_spread, e[1].spread_edge, e[1].total_edge, e[1].value_tier) == (-7.0, 3.5, 5.0, "Strong Value")
    assert e[1].edge_notes == ["Home Spread Edge: +3.5 pts", "OVER Edge: +5.0 pts"] and e[2].value_tier == "Fair / Aligned" and e[2].spread_edge is None
    preds = spark.createDataFrame([(1, -3.0, 3.0, 45.0, 2.0), (2, -3.0, 3.0, 45.0, -2.0), (3, -3.0, 3.0, 45.0, 0.5)], "game_id bigint, market_spread double, spread_edge double, market_total double, total_edge double")
    games = spark.createDataFrame([(1, 30, 20, True), (2, 20, 30, True), (3, 23, 20, True)], "game_id bigint, home_score bigint, away_score bigint, completed boolean")
    r = market.market_record(market.grade_market(preds, games)).first()
    assert (r.ats_wins, r.ats_losses, r.ats_pushes, r.ats_win_pct) == (1, 1, 1, 0.5) and (r.ou_wins, r.ou_losses) == (1, 1)


def test_lines_fall_back_to_names(spark):
    f = spark.createDataFrame([(1, "Alpha", "Beta"), (2, "Gamma", "Delta")], "game_id bigint, home_team string, away_team string")
    by_id = spark.createDataFrame([("1", -1.0, 40.0)], "game_id string, market_spread double, market_total double")
    names = spark.createDataFrame([("GAMMA", "delta", 2.0, None)], "home_name string, away_name string, market_spread double, market_total double")
    got = {r.game_id: (r.market_spread, r.market_total) for r in market.attach_lines(f, by_id, names).collect()}
    assert got == {1: (-1.0, 40.0), 2: (2.0, None)}


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[::7, 1] = np.nan
    y, z = 20 + 3 * x[:, 0] + rng.normal(size=60), 18 - 2 * x[:, 2] + rng.normal(size=60)
    df = spark.createDataFrame([(i, *[None if v != v else float(v) for v in row], float(a), float(b)) for i, (row, a, b) in enumerate(zip(x, y, z))], "game_id int, home_a double, home_b double, away_c double, home_score double, away_score double")
    out = models.predict_ridge(df, models.fit_ridge(df, ["home_a", "home_b", "away_c"])).orderBy("game_id").toPandas()
    full = np.column_stack([x[:, 0], np.where(np.isnan(x[:, 1]), np.nanmedian(x[:, 1]), x[:, 1]), x[:, 2], np.isnan(x[:, 1])])
    mean = full.mean(0)
    for target, got in ((y, out.home_expected_points), (z, out.away_expected_points)):
        w = np.linalg.solve((full - mean).T @ (full - mean) + 12 * np.eye(4), (full - mean).T @ (target - target.mean()))
        assert np.allclose(got, (full - mean) @ w + target.mean(), atol=1e-6)
    scaled = lambda d: models.predict_ridge(d, models.fit_ridge(d, ["home_a", "home_b", "away_c"], 10.0, indicators=False, scaled=True)).orderBy("game_id").toPandas().home_expected_points
    assert np.allclose(scaled(df), scaled(df.withColumn("home_a", F.col("home_a") * 1000)), atol=1e-6)  # units don't matter


def test_expanding_ridges_equal_a_fit_of_each_training_set(spark, league):
    games, stats, _ = league
    p = models.with_periods(features.matchup_features(games, features.team_pregame_features(games, stats))).cache()
    names = ("home_points_season", "away_points_l3", "home_turnovers_l5", "home_field_indicator", "away_yards_per_play_season")
    table = p.orderBy("ord", "game_id").toPandas()
    for how in (dict(alpha=12.0, indicators=True, scaled=False), dict(alpha=10.0, indicators=False, scaled=True)):
        model = models.ExpandingRidge(names, **how)
        got = {r.game_id: r for r in models.predict(p, ["m"], p, models.Registry(trained={"m": model})).collect()}
        assert {table.ord[table.game_id == g].iloc[0] for g in got} == set(range(8, 9))  # 20 games and more: the last week only
        for o in (8,):
            train, target = table[table.ord < o], table[table.ord == o]
            x, t = train[list(names)].astype(float), target[list(names)].astype(float)
            md = x.median().fillna(0)
            full = lambda f: np.column_stack([f.fillna(md), f.isna().astype(float)]) if how["indicators"] else f.fillna(md).to_numpy()
            a, b = full(x), full(t)
            mean, std = a.mean(0), np.where(how["scaled"] & (a.std(0) > 0), a.std(0), 1.0)
            a, b = (a - mean) / std, (b - mean) / std
            out, fitted = [], []
            for y in ("home_score", "away_score"):
                w = np.linalg.solve(a.T @ a + how["alpha"] * np.eye(a.shape[1]), a.T @ (train[y] - train[y].mean()))
                out.append(np.clip(b @ w + train[y].mean(), 0, 70))
                fitted.append(a @ w + train[y].mean())
            scale = max(1.0, np.std(train.home_score - train.away_score - fitted[0] + fitted[1], ddof=1))
            for g, h, v in zip(target.game_id, *out):
                assert (got[g].home_points, got[g].away_points) == (pytest.approx(h, abs=1e-8), pytest.approx(v, abs=1e-8))
                assert got[g].home_win_probability == pytest.approx(0.5 * (1 + math.erf((h - v) / scale / math.sqrt(2))), abs=1e-6)
    with pytest.raises(ValueError, match="trained"):
        models.predict(p, ["ridge"])


def test_shrunk_limits(spark, league):
    games, stats, _ = league
    m = features.matchup_features(games, features.team_pregame_features(games, stats))
    p = models.with_periods(m)
    target = models.eligible(p, models.training_summary(p), min_games=6).cache()
    own = models.Registry().registered("k0", models.shrunk(0.0)).registered("kinf", models.shrunk(1e9))
    with pytest.raises(ValueError, match="already"):
        own.registered("k0", models.shrunk(0.0))
    got = models.predict(target.where("home_prior_games > 0 AND away_prior_games > 0"), ["k0", "kinf", "rolling_average"], registry=own).toPandas().set_index(["model", "game_id"]).home_points.unstack(0)
    assert np.allclose(got.k0, got.rolling_average)
    lg = target.select("game_id", ((F.col("train_home") + F.col("train_away")) / 2).alias("l")).toPandas().set_index("game_id").l
    assert np.allclose(got.kinf, lg.loc[got.index], atol=1e-5)


def test_period_order_and_calibration(spark, league):
    games, stats, _ = league
    p = models.with_periods(features.matchup_features(games, features.team_pregame_features(games, stats)))
    assert [r.period for r in p.select("period", "ord").distinct().orderBy("ord").collect()][:2] == ["2026 regular week 1", "2026 regular week 2"]
    q = spark.createDataFrame([("m", 0.0, 1, 0), ("m", 0.1, 1, 0), ("m", 0.95, 1, 0)], "model string, home_win_probability double, home_score int, away_score int")
    bins = evaluate.calibration_bins(q).orderBy("bin").collect()
    assert [b.games for b in bins] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_upcoming_history_is_strictly_before_kickoff(spark):
    t = START
    g = spark.createDataFrame([(1, 2026, 1, t, 1, 2, 10, 7, False, True), (2, 2026, 1, t + timedelta(hours=1), 1, 3, 30, 3, False, True), (3, 2026, 2, t + timedelta(hours=1), 1, 2, None, None, False, False)], GAMES)
    h = {(r.side): (r.n, r.scored, r.allowed) for r in upcoming.team_history(g, g.where("NOT completed")).collect()}
    assert h == {"home": (1, 10.0, 7.0), "away": (1, 7.0, 10.0)}
    todo, skipped = upcoming.split_upcoming(g, "2026-09-01 01:00:00")
    assert todo.count() == 0 and skipped.first().reason == "kickoff has passed or game is in progress"


def test_grading_hand_values(spark):
    k = START
    finals = spark.createDataFrame([(1, 1, 2, k, True, 30, 20), (2, 3, 4, k, True, 10, 10), (3, 5, 6, None, False, None, None), (4, 7, 8, k, False, None, None)], "game_id bigint, home_team_id bigint, away_team_id bigint, kickoff timestamp, completed boolean, home_score bigint, away_score bigint")
    day = timedelta(days=1)
    row = lambda run, g, h, a, made, he, ae, p: (run, g, h, a, 2026, 1, k, made, made, he, ae, he - ae, he + ae, p, g == 1, "m")
    f = spark.createDataFrame([row("r1", 1, 1, 2, k - 2 * day, 20.0, 20.0, 0.5), row("r2", 1, 1, 2, k - day, 24.0, 21.0, 0.6), row("r3", 1, 1, 2, k, 99.0, 0.0, 0.9), row("r2", 2, 3, 4, k - day, 20.0, 14.0, 0.7), row("r2", 3, 5, 6, k - day, 1.0, 1.0, 0.5), row("r2", 4, 8, 7, k - day, 1.0, 1.0, 0.5)],
        "source_run string, game_id bigint, home_team_id bigint, away_team_id bigint, season int, week int, saved_kickoff timestamp, created timestamp, as_of timestamp, home_expected_points double, away_expected_points double, projected_spread_home double, projected_total double, home_win_probability double, low_history boolean, model string")
    rep = {r.game_id: r for r in grade.results_report(finals, f).collect()}
    assert [rep[i].status for i in (1, 2, 3, 4)] == ["scored", "scored", "unconfirmed_kickoff", "no_eligible_prediction"]
    assert rep[1].source_run == "r2" and rep[1].brier == pytest.approx(0.16) and rep[1].winner_correct is True and rep[1].margin_absolute_error == 7.0
    assert rep[2].actual_winner == "tie" and rep[2].brier is None and rep[2].winner_correct is None
    reasons = {(r.game_id, r.source_run): r.reason for r in grade.excluded(grade.candidates(finals, f)).collect()}
    assert reasons == {(1, "r3"): "not_created_and_asof_before_both_kickoffs", (3, "r2"): "unconfirmed_kickoff", (4, "r2"): "team_identity_mismatch"}
    s = {r.group: r for r in grade.report_summary(grade.results_report(finals, f)).collect()}
    assert s["all"].games_scored == 2 and s["low_history"].games_scored == 1 and s["all"].brier_games == 1 and s["established_history"].winner_accuracy is None


def test_calibration_shrinks_and_clamps(spark):
    g = spark.createDataFrame([(i, 2026, 1, START, 1, 2, 30, 10, False, True) for i in range(10)], GAMES)
    r = grade.calibrate(g).first()
    assert r.calibrated_hfa == 5.0 and r.margin_std == 8.0 and r.sample_size == 10 and r.actual_home_margin_avg == 20.0
    assert grade.calibrate(g.where("false")).first().calibrated_hfa == 2.5


def test_validation_is_strict(spark, league):
    games, stats, _ = league
    validate.strict(validate.union(validate.games(games), validate.stats(stats, games), validate.consistency(games, stats)))
    with pytest.raises(validate.ValidationError, match="self_play: 1"):
        validate.strict(validate.games(games.withColumn("away_team_id", F.when(F.col("game_id") == 1, F.col("home_team_id")).otherwise(F.col("away_team_id")))))
    with pytest.raises(validate.ValidationError, match="too_few_periods"):
        validate.strict(validate.training(games.where("week = 1"), 1))
    gone = validate.features(spark.createDataFrame([(1.0,)], "points_l3 double"), ("points",)).collect()
    assert {r.key for r in gone} == {"points_l5", "points_season"}


def test_versions_merge_conflict_and_review(spark):
    base = (2026, 1, START, 1, 2)
    v = lambda g, run, day, done, hs: (g, *base, hs, 7 if done else None, False, done, run, START + timedelta(days=day))
    rows = [v(1, "a", 1, False, None), v(1, "b", 2, True, 14), v(1, "c", 3, True, 14), v(2, "a", 1, True, 10), v(2, "b", 2, True, 11), v(3, "a", 1, True, 3), v(3, "b", 2, False, None), v(4, "a", 1, False, None), v(4, "b", 2, False, None)]
    d = spark.createDataFrame(rows, "game_id bigint, season int, week int, game_date timestamp, home_team_id bigint, away_team_id bigint, home_score bigint, away_score bigint, neutral_site boolean, completed boolean, run_id string, captured_at timestamp")
    merged, conflicts, up = versions.merge_games(d)
    assert {(r.game_id, r.home_score) for r in merged.collect()} == {(1, 14), (3, 3), (4, None)}
    assert {(r.game_id, r.run_id) for r in conflicts.collect()} == {(2, "a"), (2, "b")} and [r.game_id for r in up.collect()] == [1]
    plan = versions.review_plan(d)
    pick = spark.createDataFrame([(2, "b")], "game_id bigint, run_id string")
    chosen = versions.merge_games(versions.apply_decisions(d, plan, pick, versions.review_token(d)))[0]
    assert {r.game_id: r.home_score for r in chosen.collect()}[2] == 11
    with pytest.raises(ValueError, match="changed"):
        versions.apply_decisions(d, plan, pick, "0-0")
    with pytest.raises(ValueError, match="decision_missing"):
        versions.apply_decisions(d, plan, pick.where("false"))
    diff = versions.version_diff(d.where("game_id = 2"), ["a", "b"]).collect()
    assert [(r.field, r.a, r.b) for r in diff] == [("home_score", "10", "11")]


def test_json_golden_game(spark):
    schedule = '[{"id":1,"season":2026,"week":1,"seasonType":"regular","startDate":"2026-08-29T16:00:00.000Z","startTimeTBD":false,"completed":true,"neutralSite":true,"homeId":2628,"homeClassification":"fbs","homePoints":10,"awayId":153,"awayClassification":"fbs","awayPoints":15},{"id":2,"homeClassification":"fcs","awayClassification":"fbs"}]'
    games, bad = raw_json.read_schedule(spark.createDataFrame([(schedule,)], "payload string"))
    assert bad.first().rule == "not_two_fbs_teams" and games.first().game_date == datetime(2026, 8, 29, 16)
    stat = lambda turnovers, comp, rush, clock: "[" + ",".join(f'{{"category":"{c}","stat":"{s}"}}' for c, s in (("totalYards", 300), ("netPassingYards", 200), ("rushingYards", 100), ("turnovers", turnovers), ("thirdDownEff", "7-16"), ("totalPenaltiesYards", "5-40"), ("completionAttempts", comp), ("rushingAttempts", rush), ("possessionTime", clock))) + "]"
    box = f'[{{"id":1,"teams":[{{"teamId":2628,"homeAway":"home","points":10,"stats":{stat(1, "20-40", 31, "33:02")}}},{{"teamId":153,"homeAway":"away","points":15,"stats":{stat(2, "15-30", 27, "26:58")}}}]}}]'
    stats, refused = raw_json.read_boxes(spark.createDataFrame([(box,)], "payload string"), games)
    got = {r.team_id: (r.offensive_plays, r.time_of_possession_seconds, r.takeaways) for r in stats.collect()}
    assert got == {2628: (71, 1982, 2), 153: (57, 1618, 1)} and refused.count() == 0
    twice = spark.createDataFrame([(box,), (box,)], "payload string")
    assert raw_json.read_boxes(twice, games)[1].first().rule == "more_than_one_box"


def test_store_publishes_verifies_and_detects_tampering(spark, league, tmp_path):
    games, stats, _ = league
    s = store.Store(spark, str(tmp_path))
    s.publish("d1", "dataset", {"games": games, "team_game_stats": stats}, sort={"games": ["game_date", "game_id"]})
    assert s.newest("dataset") == "d1" and s.load("games", "d1", ["game_id"]).count() == games.count()
    s.activate("d1", ["games"])
    assert spark.table("current_games").count() == games.count()
    games.limit(1).write.mode("append").parquet(f"{tmp_path}/games/run_id=d1")
    with pytest.raises(ValueError, match="differs"):
        s.load("games", "d1")
    assert store.fingerprint(games).first() == store.fingerprint(games.repartition(7)).first()
    assert store.fingerprint(games).first() != store.fingerprint(games.union(games)).first() and store.fingerprint(games.where("false")).first().rows == 0
    parts = [tuple(store.fingerprint(games.where(w)).first()) for w in ("week < 3", "week >= 3", "week < 0")]
    assert store.add_fingerprints(parts) == tuple(store.fingerprint(games).first())
    near = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "n"), ("n", None), ("1:a", "")], "x string, y string")
    assert len({r.digest for r in store.fingerprint(near, ["x", "y"], by=["x", "y"]).collect()}) == 5
    # a partition is verified without the others, and files are in the order asked for
    s.publish("d2", "dataset", {"games": games}, sort={"games": ["game_date"]}, partition={"games": "week"})
    s.publish("d3", "dataset", {"games": games.repartition(5)}, sort={"games": ["game_date", "game_id"]})
    ends = spark.read.parquet(f"{tmp_path}/games/run_id=d3").groupBy(F.input_file_name().alias("f")).agg(F.min("game_date").alias("a"), F.max("game_date").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(ends, ends[1:]))
    next((tmp_path / "games/run_id=d2/week=5").glob("*.parquet")).unlink()
    assert s.load("games", "d2", only=[2, 3, 99]).count() == 6
    with pytest.raises(ValueError, match="games/5: content differs"):
        s.load("games", "d2", only=[2, 5])
    with pytest.raises(ValueError, match="without partitions"):
        s.load("games", "d3", only=[2])
    store.write_csv(spark.createDataFrame([("=x",)], "name string"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().name == "'=x"


def test_dimensions(spark):
    s = lambda rows: spark.createDataFrame(rows, "home_team_id bigint, home_name string, away_team_id bigint, away_name string, captured_at timestamp")
    d = dimensions.team_dimension(s([(1, "Old", 2, "Two", START)]), s([(1, "New", 3, "", START)]))
    assert {(r.team_id, r.name) for r in d.collect()} == {(1, "New"), (2, "Two")}
    p = spark.createDataFrame([(9, 1, 4, True)], "game_id bigint, home_team_id bigint, away_team_id bigint, neutral_site boolean")
    assert dimensions.enrich_predictions(p, d).first().matchup == "4 vs New (N)"
