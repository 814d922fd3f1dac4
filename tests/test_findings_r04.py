"""What a round's findings asked for: versions told apart in one shuffle, digests and medians without repeated work."""

import numpy as np
from pyspark.sql import functions as F

from ratingloom.operators import models, project, ratings, upcoming, versions
from ratingloom.plans import pipelines, registry
from ratingloom.sources import store


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_wide_row_makes_each_value_text_once(spark):
    wide = spark.range(5).select(*(F.when(F.col("id") != i % 5, F.col("id") / (i + 1)).alias(f"c{i:02}") for i in range(store.NARROW + 6)))
    long, short = store.row_text(wide.columns), store.row_text(wide.columns[: store.NARROW])
    parts = F.concat_ws("|", *(store.row_text([c]) for c in wide.columns))
    assert wide.where(long != parts).isEmpty() and wide.where(~F.startswith(long, short)).isEmpty()
    kept = store.cut(wide)
    assert plan(kept.select(store.row_text(kept.columns))).count("cast(c07") == 1


def test_medians_are_exact_and_found_again_where_a_bound_is_off(spark):
    draw = np.random.default_rng(4)
    rows = [(float(draw.normal()), float(draw.integers(0, 4)), None if k % 3 else float(k), float("nan") if k % 2 else float(k % 7), None) for k in range(3001)]
    df = store.cut(spark.createDataFrame(rows, "a double, b double, c double, d double, e double"))
    want = {c: float(np.nanmedian([np.nan if r[i] is None else r[i] for r in rows])) for i, c in enumerate("abcd")}
    assert models.exact_medians(df, list("abcde")) == want
    known = models.summaries(df, list("abcde"))
    off = known | {"a": (*known["a"][:3], [9.0, 10.0]), "b": (*known["b"][:3], [-2.0, -1.0])}
    assert models.exact_medians(df, list("abcde"), off) == want


def test_a_ridge_holds_vectors_and_scores_only(spark, monkeypatch):
    held, cache = [], type(spark.range(1)).cache
    monkeypatch.setattr(type(spark.range(1)), "cache", lambda df: held.append(df.columns) or cache(df))
    rows = [(i, float(i % 5), None if i % 4 else float(i % 3), float(20 + i % 7), float(17 + i % 4)) for i in range(40)]
    train = spark.createDataFrame(rows, "game_id int, home_a double, away_b double, home_score double, away_score double")
    model = models.fit_ridge(train, ["home_a", "away_b"])
    assert held == [["_features", "home_score", "away_score"]] and model.indicators == ["away_b"]


def test_versions_of_a_game_are_shuffled_once(spark):
    rows = [(g, run, f"2001-07-0{k}", 20 + g + (g % 7 == 0 and k == 3), g % 3 > 0 or k > 1) for g in range(1, 40) for k, run in enumerate("abc", 1) if g % 4 or k > 1]
    df = store.cut(spark.createDataFrame(rows, "game_id int, run_id string, captured_at string, home_score int, completed boolean"))
    made = versions.merge_games(df)
    assert all(" Join " not in plan(x) and plan(x).count("RepartitionByExpression") == 1 for x in made)
    want = {"merged": set(), "conflicts": set(), "upgraded": set()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        final = [r for r in own if r[4]] or own
        if len({(r[3], r[4]) for r in final}) > 1:
            want["conflicts"] |= {(g, r[1]) for r in final}
        else:
            want["merged"].add((g, final[0][3], final[0][4]))
            want["upgraded"] |= {(g,)} if final[0][4] and not own[0][4] else set()
    assert all(want.values())
    for x, (name, keys) in zip(made, {"merged": ("game_id", "home_score", "completed"), "conflicts": ("game_id", "run_id"), "upgraded": ("game_id",)}.items()):
        got = [tuple(r) for r in x.select(*keys).collect()]
        assert set(got) == want[name] and len(got) == len(want[name])


def test_equal_means_about_the_middle_of_two_digits_have_no_better_side(spark):
    middle = 5 / 1024  # 0.0048828125: ten digits, the last a five
    sides = {"a": middle + 1e-15, "b": middle - 1e-15}
    row = {f"{s}_{m}": sides[s if not less else "ab"[s == "a"]] for s in "ab" for m, less in project.TAPE}
    near = {k: v + (1e-9 if (k[0] == "a") != dict(project.TAPE)[k[2:]] else 0.0) for k, v in row.items()}
    got = project.tale_of_tape(spark.createDataFrame([(1, *row.values()), (2, *near.values())], ["game_id", *row]))
    assert {(r["game_id"], r["better_side"]) for r in got.collect()} == {(1, "b"), (2, "a")}


def test_models_are_worked_out_before_their_rows_are_made(spark):
    rows = spark.createDataFrame([(1, 20.0, 17.0, 21.0, 18.0, 7.0, 0.5)], "game_id int, home_score double, away_score double, train_home double, train_away double, scale double, home_rate double")
    rows = rows.withColumns({f"{s}_{c}_season": F.lit(20.0) for s in ("home", "away") for c in ("points", "points_allowed")})
    made = plan(models.predict(rows, ["train_mean", "rolling_average"]))
    assert "explode(_of" in made and "explode(array(" not in made


def test_forecasts_need_ratings_and_no_profiles(spark, data, tmp_path, monkeypatch):
    g, s, t = registry.games(spark, data).withColumn("game_date", F.col("game_date").cast("timestamp")), registry.stats(spark, data), registry.teams(spark, data)
    whole = ratings.fit_ratings(g, s, t)
    power = ratings.fit_power(g, s, t)
    both = power.join(whole.select("unit", "team_id", *(F.col(f"{c}_rating").alias(c) for c in ("power", "offensive", "defensive"))), ["unit", "team_id"])
    assert both.count() == power.count() == whole.count()
    assert both.where(" OR ".join(f"abs({c} - {c}_rating) > 1e-9" for c in ("power", "offensive", "defensive"))).isEmpty()

    def refused(*args, **kwargs):
        raise AssertionError("profiles aren't asked for")

    for name in ("season_totals", "with_advanced"):
        monkeypatch.setattr(ratings, name, refused)
    lines = registry.market.consensus_lines(registry.derived(spark, data, "line_items"))
    out = pipelines.forecast(store.Store(spark, str(tmp_path)), "f", pipelines.Dataset(g, s), t, lines, registry.AS_OF)
    assert out.where("model = 'ratings'").count() > 0


def test_a_dataset_is_verified_once_a_session(spark, data, monkeypatch):
    loaded = []
    monkeypatch.setattr(registry, "_CYCLED", {})
    monkeypatch.setattr(pipelines, "load", lambda kept: loaded.append(kept.root) or pipelines.Dataset(kept.written("games", "weekly-data"), kept.written("team_game_stats", "weekly-data")))
    kept = registry.cycled(spark, data)
    first, second = registry._dataset(kept, spark, data), registry._dataset(kept, spark, data)
    assert loaded == [kept.root] and first.games.count() == second.games.count() == registry.games(spark, data).count()


def test_a_weekly_update_chooses_lines_of_open_games_alone(spark, data, monkeypatch):
    asked = []
    monkeypatch.setattr(registry, "_CYCLED", {})
    monkeypatch.setattr(pipelines, "weekly_forecast", lambda kept, run, data, teams, lines, *a: asked.append(lines))
    registry._weekly(registry.cycled(spark, data), spark, data)
    made = plan(asked[0])
    assert "Join LeftSemi" in made and made.rindex("Join LeftSemi") > made.index("Aggregate")
    assert asked[0].count() == registry.market.consensus_lines(registry.derived(spark, data, "line_items")).join(registry.todo(spark, data), "game_id", "left_semi").count() > 0


def test_results_count_for_fixtures_of_their_unit_alone(spark):
    rows = [(1, 2000, "2000-01-01", 1, 2, 10, 7, True), (2, None, "2000-01-01", 1, 3, 20, 6, True), (3, 2001, "2001-01-01", 1, 2, 30, 5, True), (4, 2001, "2001-02-01", 1, 2, None, None, False), (5, None, "2001-02-01", 3, 1, None, None, False)]
    games = spark.createDataFrame(rows, "game_id long, season int, game_date string, home_team_id int, away_team_id int, home_score int, away_score int, completed boolean").withColumn("game_date", F.col("game_date").cast("timestamp"))
    seen = upcoming.team_history(games, games.where("NOT completed"))
    assert "Join LeftSemi" in plan(seen)
    got = {(r["game_id"], r["side"]): (r["n"], r["scored"], r["allowed"]) for r in seen.collect()}
    assert got == {(4, "home"): (1, 30.0, 5.0), (4, "away"): (1, 5.0, 30.0), (5, "home"): (1, 6.0, 20.0), (5, "away"): (1, 20.0, 6.0)}
