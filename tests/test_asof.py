"""Ratings at many dates and of many leagues: one job against one fit a date, both strategies, plans, and units of every operator."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_league import START, season

from ratingloom.operators import asof, features, ratings, upcoming
from ratingloom.operators.ratings import Settings

NUMBERS = ["prior_rating", "offensive_rating", "defensive_rating", "power_rating", "strength_of_schedule", "recent_form_rating"]


@pytest.fixture(scope="module")
def two(spark):
    """Two leagues in one table: the second has twice the weeks, other strengths, and team ids of its own."""
    g1, s1 = season(spark)
    g2, s2 = season(spark, teams=8, weeks=16, strength=1.0, seed=5)
    move = lambda df, cols: df.withColumns({c: F.col(c) + (1000 if c == "game_id" else 100) for c in cols})
    g2, s2 = move(g2, ("game_id", "home_team_id", "away_team_id")), move(s2, ("game_id", "team_id", "opponent_id"))
    games = g1.withColumn("league", F.lit("one")).unionByName(g2.withColumn("league", F.lit("two"))).withColumn("season_type", F.lit("regular"))
    games = games.withColumn("unit", F.concat_ws(" ", "league", F.col("season").cast("string")))
    ids = [*range(1, 7), *range(101, 109)]
    teams = spark.createDataFrame([(k, f"Team {k}", ("East", "West", None)[k % 3]) for k in ids], "team_id bigint, name string, conference string")
    return games.cache(), s1.unionByName(s2).cache(), teams.cache()


S = Settings(unit="unit", rounds=4)


def table(df, *keys):
    return df.orderBy(*keys).toPandas()


@pytest.mark.parametrize("strategy, given", [("grouped", False), ("rounds", True)])
def test_every_date_equals_its_own_fit(spark, two, strategy, given, monkeypatch):
    monkeypatch.setattr(ratings, "BUCKETS", 3)
    games, stats, teams = two
    priors = spark.createDataFrame([(1, 4.0), (102, -3.0)], "team_id bigint, prior double") if given else None
    days = [START + timedelta(days=d) for d in (8, 31, 62, 400)]
    dates = games.select("unit").distinct().crossJoin(spark.createDataFrame([(d,) for d in [*days, START]], "as_of timestamp"))
    got = asof.fit_ratings_asof(games, stats, teams, dates.union(dates), priors=priors, s=S, strategy=strategy).cache()
    assert got.where(F.col("as_of") == F.lit(START)).isEmpty()  # nothing before it
    for day in days:
        one = table(ratings.fit_ratings(games, stats, teams, priors=priors, s=S, cutoff=str(day)), "unit", "team_id")
        mine = table(got.where(F.col("as_of") == F.lit(day)), "unit", "team_id")
        assert mine.unit.tolist() == one.unit.tolist() and mine.team_id.tolist() == one.team_id.tolist()
        for c in NUMBERS:
            assert mine[c].tolist() == pytest.approx(one[c].tolist(), abs=1e-9), c
        assert mine[["wins", "losses", "ties", "tier", "conference"]].values.tolist() == one[["wins", "losses", "ties", "tier", "conference"]].values.tolist()
        assert mine["rank"].tolist() == one["rank"].tolist() and mine.games.tolist() == one.games_played.tolist()


def test_weeks_start_at_their_first_kickoff(two):
    games, stats, teams = two
    starts = asof.week_starts(games, S).groupBy("unit").count().orderBy("unit").collect()
    assert [tuple(r) for r in starts] == [("one 2026", 7), ("two 2026", 15)]
    weekly = asof.fit_ratings_asof(games, stats, teams, s=S)
    assert weekly.groupBy("unit").agg(F.count_distinct("as_of").alias("n")).orderBy("unit").collect() == starts


def test_no_date_no_game_no_rating(spark, two):
    games, stats, teams = two
    none = spark.createDataFrame([], "unit string, as_of timestamp")
    assert asof.fit_ratings_asof(games, stats, teams, none, s=S).count() == 0
    assert asof.fit_ratings_asof(games.where("false"), stats, teams, s=S).count() == 0
    elsewhere = spark.createDataFrame([("three 2026", START)], "unit string, as_of timestamp")
    for strategy in ("grouped", "rounds"):
        assert asof.fit_ratings_asof(games, stats, teams, elsewhere, s=S, strategy=strategy).count() == 0


def test_a_team_without_an_opponents_row_still_counts(spark, two):
    games, stats, teams = two
    lone = stats.where("NOT (team_id = 3 AND game_id < 1000)")
    day = START + timedelta(days=40)
    dates = games.select("unit").distinct().withColumn("as_of", F.lit(day))
    one = table(ratings.fit_ratings(games, lone, teams, s=S, cutoff=str(day)), "unit", "team_id")
    for strategy in ("grouped",):
        mine = table(asof.fit_ratings_asof(games, lone, teams, dates, s=S, strategy=strategy), "unit", "team_id")
        assert mine.power_rating.tolist() == pytest.approx(one.power_rating.tolist(), abs=1e-9)


def test_a_round_moves_no_edges(spark, two, monkeypatch):
    games, stats, teams = two
    e = ratings.edges(stats, games, S).withColumn("prior", F.lit(0.0))
    with ratings.bucketed(e, 4) as kept:
        x = kept.select("unit", "team_id").distinct().withColumns({"off": F.lit(0.0), "de": F.lit(0.0)})
        x = spark.createDataFrame(x.collect(), x.schema)
        plan = lambda: ratings.round_sums(kept, x, S, ["unit"], ratings.is_small(x))._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan() and "Exchange hashpartitioning" not in plan() and "BroadcastExchange" in plan()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        monkeypatch.setattr(ratings, "VECTOR_ROWS", 3)  # vectors too large to send whole
        try:
            assert "BroadcastExchange" not in plan()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        few = ratings._by_rounds(e, S).orderBy("team_id").toPandas()
    want = ratings.raw_ratings(e, S, "grouped").orderBy("team_id").toPandas()
    assert few.off.tolist() == pytest.approx(want.off.tolist(), abs=1e-9) and few.de.tolist() == pytest.approx(want.de.tolist(), abs=1e-9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_")]


def test_rounds_over_many_teams_move_sums_only(spark, two, monkeypatch):
    """Where vectors are too large to send whole, edges lie in buckets of the opponent and a round reads no more than their weights."""
    games, stats, teams = two
    e = ratings.edges(stats, games, S).withColumn("prior", F.col("team_id") / 7.0)
    want = table(ratings.raw_ratings(e, S, "grouped"), "unit", "team_id")
    monkeypatch.setattr(ratings, "VECTOR_ROWS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = table(ratings.raw_ratings(e, S, "rounds"), "unit", "team_id")
        with ratings.bucketed(e, 4, "opponent_id") as kept:
            x = spark.createDataFrame(want[["unit", "team_id", "off", "de"]])
            plan = ratings.round_moves(kept, x.withColumns({c: F.lit(1.0) for c in ("p", "q", "total")}), x, ["unit"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.off.tolist() == pytest.approx(want.off.tolist(), abs=1e-9) and got.de.tolist() == pytest.approx(want.de.tolist(), abs=1e-9)
    assert "Bucketed: true" in plan and not any(c in plan for c in ("pts#", "allowed#", "league#", "hfa#"))


def test_newest_rating_at_kickoff(spark, two):
    games, stats, teams = two
    weekly = asof.fit_ratings_asof(games, stats, teams, s=S)
    found = asof.at_kickoff(games, weekly, "unit")
    brute = {}
    days = {}
    for r in weekly.collect():
        days.setdefault((r["unit"], r["team_id"]), []).append((r["as_of"], r["power_rating"]))
    for g in games.collect():
        for side in ("home", "away"):
            before = [x for x in days.get((g["unit"], g[f"{side}_team_id"]), []) if x[0] <= g["game_date"]]
            if before:
                brute[g["game_id"], side] = max(before)[1]
    got = {(r["game_id"], r["side"]): r["power_rating"] for r in found.collect()}
    assert got.keys() == brute.keys() and all(got[k] == pytest.approx(v) for k, v in brute.items())


def test_forecasts_and_features_keep_leagues_apart(spark, two):
    games, stats, teams = two
    rated, averages = ratings.fit_ratings(games, stats, teams, s=S), ratings.league_summary(games, stats, S)
    ahead = games.where("week = 4").withColumns({"game_id": F.col("game_id") + 5000, "game_date": F.col("game_date") + F.expr("INTERVAL 400 DAYS"), "completed": F.lit(False)})
    both = upcoming.rated_forecast(ahead, games, rated, averages, unit="unit", league_col="league")
    assert {r["model"] for r in both.collect()} == {"ratings"}
    for name in ("one", "two"):
        own = games.where(F.col("league") == name)
        alone = upcoming.rated_forecast(ahead.where(F.col("league") == name), own, rated, averages, unit="unit")
        fields = ["game_id", "home_games_played", "league_home", "scale", "home_expected_points", "home_win_probability"]
        a, b = (table(x.select(*fields), "game_id") for x in (both.where(F.col("league") == name), alone))
        assert a.values.ravel().tolist() == pytest.approx(b.values.ravel().tolist())
    # a team that plays in both leagues has two histories
    shared = stats.withColumn("team_id", F.col("team_id") % 100)
    own = features.team_pregame_features(games, shared, ("points",), unit="unit")
    alone = features.team_pregame_features(games.where("league = 'one'"), shared, ("points",))
    a, b = (table(x.select("game_id", "team_id", "points_season", "prior_games"), "game_id", "team_id").fillna(-1).values.tolist() for x in (own.where("unit = 'one 2026'"), alone))
    assert a == b


def test_a_repeated_game_id_fails_instead_of_multiplying_rows(two):
    games, stats, _ = two
    with pytest.raises(Exception, match="several games"):
        features.with_context(stats, games.union(games.limit(1))).count()
