"""What a round's findings asked for: one reading of a box, pairs without a shuffle of pairs, equal means, one pass over features."""

import pandas as pd
from pyspark.sql import functions as F

from ratingloom.operators import evaluate, models, project, ratings, scans
from ratingloom.plans import pipelines, registry
from ratingloom.sources import raw_json, store
from ratingloom.streaming import overdue


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_box_is_read_and_joined_once(spark, data):
    stats, rejected = raw_json.read_boxes(registry.box_payloads(spark, data), registry.games(spark, data))
    for df in (stats, rejected):
        assert plan(df).count("from_json") == 1


def test_equal_means_have_no_better_side(spark):
    row = {f"{s}_{m}": (0.1 + 0.2 if s == "a" else 0.3) for s in "ab" for m, _ in project.TAPE}
    got = project.tale_of_tape(spark.createDataFrame([(1, *row.values())], ["game_id", *row]))
    assert {r["better_side"] for r in got.collect()} == {"b"}


def test_pairs_meet_in_blocks_and_are_joined_once(spark):
    rated = spark.createDataFrame([(u, k, f"T{k}", float(k), float(k % 3), float(k % 5)) for u in (1, 2) for k in range(1, 21)], "unit int, team_id bigint, team_name string, power_rating double, offensive_rating double, defensive_rating double")
    league = spark.createDataFrame([(1, 25.0, 10.0), (2, 27.0, 12.0)], "unit int, league_points double, margin_std double")
    keys = ["unit", "home_team_id", "away_team_id", "projected_spread_home", "projected_total", "home_win_probability"]
    fast, plain = project.project_pairs(rated, league).select(*keys), project.project(project.all_pairs(rated), rated, league).select(*keys)
    assert fast.count() == 2 * 190 and fast.exceptAll(plain).isEmpty() and plain.exceptAll(fast).isEmpty()
    assert plan(fast).count("Join ") == 2 and "_i" in plan(fast)  # the pairs, and the league's row


def test_constant_columns_are_found_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(models.F, "count_distinct", None)  # many distinct counts at once repeat every row for each
    rows = [(i, float(i % 5), 1.0, None if i % 4 else float(i % 3), float(20 + i % 7), float(17 + i % 4)) for i in range(40)]
    train = spark.createDataFrame(rows, "game_id int, home_a double, home_b double, away_c double, home_score double, away_score double")
    assert models.fit_ridge(train, ["home_a", "home_b", "away_c"]).features == ["home_a", "away_c"]


class Calls:
    """A state handle, and its states, in memory: counts what is asked of it."""

    def __init__(self):
        self.n, self.rows, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*given):
            self.n += 1
            if name.startswith("get") and given:
                state = Calls()
                self.states = [*getattr(self, "states", []), state] if "states" in self.__dict__ else [state]
                return state
            if name == "exists":
                return self.rows is not None
            if name == "get":
                return self.rows
            if name in ("put", "update"):
                self.rows = given[0]
            if name == "appendList":
                self.rows = [*(self.rows or []), *given[0]]
            if name == "clear":
                self.rows = None
            if name == "registerTimer":
                self.timers.add(given[0])
            if name == "deleteTimer":
                self.timers.discard(given[0])

        return call


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_to_the_state_do_not_grow_with_the_games():
    handle, games = Calls(), overdue.OverdueGames(3, None)
    games.init(handle)
    day = overdue.DAY_MS
    rows = pd.DataFrame({"game_id": range(1000), "at": [g % 5 for g in range(1000)], "done": False, "kickoff": day})
    list(games.handleInputRows((0,), iter([rows]), Clock(0)))
    list(games.handleInputRows((0,), iter([rows.assign(at=5 * day, done=rows["game_id"] % 2 == 0)]), Clock(0)))
    found = []
    while due := sorted(t for t in handle.timers if t <= 6 * day):
        handle.timers.discard(due[0])
        found += list(games.handleExpiredTimer((0,), Clock(6 * day), None))
    events = pd.concat(found)
    assert events["event"].value_counts().to_dict() == {"overdue": 1000, "result": 500}
    assert set(events[events["event"] == "overdue"]["at"]) == {4 * day} and set(events[events["event"] == "result"]["at"]) == {5 * day}
    assert handle.n + sum(s.n for s in handle.states) < 50


def test_rounds_send_ratings_of_blocks_and_no_sums_of_teams(spark, monkeypatch):
    rows = [(u, a, (a * k + 3) % 31, float(20 + (a * k) % 17), float(18 + a % 5), 1.25, 0.9**k, 24.0, a / 7.0) for u in (1, 2) for a in range(1, 30) for k in range(1, 6)]
    e = spark.createDataFrame(rows, "unit int, team_id bigint, opponent_id bigint, pts double, allowed double, hfa double, w double, league double, prior double")
    want = ratings.raw_ratings(e, ratings.Settings(), "grouped").toPandas().set_index(["unit", "team_id"]).sort_index()
    for name, value in {"VECTOR_ROWS": 3, "BLOCK_EDGES": 40, "BUCKETS": 4}.items():
        monkeypatch.setattr(ratings, name, value)
    monkeypatch.setattr(ratings, "round_moves", None)  # a sum for every team, task and round
    got = ratings.raw_ratings(e, ratings.Settings(), "rounds").toPandas().set_index(["unit", "team_id"]).sort_index()
    assert len(got) == 58 and (got - want).abs().max().max() < 1e-9


def test_ridges_share_one_reading_and_a_task_gives_a_row_a_period(spark, monkeypatch):
    rows = [(i, 1 + i % 4, float(i % 5), None if i % 7 == 0 else float(i % 11), float(20 + i % 7), float(17 + i % 4)) for i in range(400)]
    games = spark.createDataFrame(rows, "game_id int, ord int, home_a double, away_b double, home_score double, away_score double").withColumn(models.LEAGUE, F.lit("")).coalesce(1)
    trained = {"one": models.ExpandingRidge(("home_a", "away_b")), "two": models.ExpandingRidge(("away_b",), 10.0, False, True)}
    alone = {n: sorted(m(games, games).select("game_id", "home_points", "away_points").collect()) for n, m in trained.items()}
    asked, sizes, gather, totals = [], [], models.gather, models.running_totals
    monkeypatch.setattr(models, "gather", lambda p, names: asked.append(names) or gather(p, names))
    monkeypatch.setattr(models, "running_totals", lambda per, *a: sizes.append(per.count()) or totals(per, *a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        both = models.predict(games, ["one", "two"], games, models.Registry({}, trained)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert asked == [["home_a", "away_b"]] and sizes == [4]
    for name, want in alone.items():
        got = sorted((r["game_id"], r["home_points"], r["away_points"]) for r in both if r["model"] == name)
        assert len(got) == len(want) == 300
        assert all(g[0] == w[0] and abs(g[1] - w[1]) < 1e-9 and abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_places_among_cuts_and_points_are_worked_out_once(spark):
    cuts = sorted({float(k * k % 97) for k in range(64)})
    rows = spark.createDataFrame([(float(v) / 2, cuts[:n]) for v in range(-3, 200) for n in (0, 1, 5, len(cuts))], "value double, cuts array<double>")
    got = rows.withColumn("place", scans._place("cuts", "value", 64)).collect()
    assert all(r["place"] == sum(c < r["value"] for c in r["cuts"]) for r in got)
    games = spark.createDataFrame([(i, 1 + i % 4, "", float(i % 5), 20.0 + i % 7, 17.0 + i % 4) for i in range(200)], f"game_id int, ord int, {models.LEAGUE} string, home_a double, home_score double, away_score double")
    predicted = models.predict(games, ["one"], games, models.Registry({}, {"one": models.ExpandingRidge(("home_a",))}))
    assert plan(evaluate.model_metrics(predicted)).count("aggregate(") == 2


def test_a_weekly_update_takes_a_digest_once_a_table(spark, data, tmp_path, monkeypatch):
    taken, fingerprint = [], store.fingerprint
    monkeypatch.setattr(store, "fingerprint", lambda df, *a, **k: taken.append(df.columns) or fingerprint(df, *a, **k))
    kept = store.Store(spark, str(tmp_path / "store"))
    g = registry.games(spark, data).withColumns({"run_id": F.lit("run"), "captured_at": F.lit("2001-07-01").cast("timestamp"), "game_date": F.col("game_date").cast("timestamp")})
    s = registry.stats(spark, data).withColumns({"run_id": F.lit("run"), "captured_at": F.lit("2001-07-01").cast("timestamp")})
    made = pipelines.assemble(kept, "one", g, s)
    assert len(taken) == 3 and made.games.count() == g.count() and made.stats.count() == s.count()
    assert kept.load("games", "one").count() == g.count() and len(taken) == 4
