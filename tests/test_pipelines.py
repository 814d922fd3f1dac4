"""Pipelines end to end on a small season, and the incremental merge as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from ratingloom.plans import pipelines, registry
from ratingloom.sources.store import Store
from ratingloom.streaming import current_games, game_store, run_available


@pytest.fixture(scope="module")
def tables(spark, data):
    games = registry.games(spark, data).withColumn("game_date", F.col("game_date").cast("timestamp")).cache()
    return games, registry.stats(spark, data).cache(), registry.teams(spark, data).cache()


def versions(df, run, day):
    return df.withColumns({"run_id": F.lit(run), "captured_at": F.lit(day).cast("timestamp")})


def test_assemble_train_walk_forward_and_weekly_update(spark, data, tables, tmp_path):
    games, stats, teams = tables
    store = Store(spark, str(tmp_path))
    lines = registry.market.consensus_lines(registry.derived(spark, data, "line_items"))
    g = versions(games, "a", "2001-07-01").unionByName(versions(games, "b", "2001-07-02"))
    s = versions(stats, "a", "2001-07-01").unionByName(versions(stats, "b", "2001-07-02"))
    out = pipelines.weekly_update(store, "w1", g, s, teams, lines, registry.forecasts(spark, data), "2001-06-15 00:00:00", 2000, 20)
    assert out.count() == 35
    ds = pipelines.load(store)
    assert ds.games.count() == games.count()
    pipelines.train(store, "m1", ds)
    metrics = {r.metric: r.value for r in store.load("metrics", "m1").collect()}
    assert metrics["games"] == games.where("completed").count() and 0 < metrics["brier_score"] < 0.3
    overall = {r.model: r for r in pipelines.walk_forward(store, "f1", ds, ["train_mean", "rolling_average"]).collect()}
    assert overall["train_mean"].games == 1281
    rated = store.load("ratings", "w1-ratings")
    pairs = games.where("NOT completed").select("game_id", F.col("season").alias("unit"), "home_team_id", "away_team_id", "neutral_site")
    projected, edges, tape = pipelines.compare(ds, rated, pairs)
    assert projected.count() == 45 and tape.count() == 45 * 21 and edges.count() > 0
    finals = games.where("season = 2001").withColumn("kickoff", F.col("game_date"))
    assert pipelines.results(store, "r1", finals, registry.forecasts(spark, data)).where("status = 'scored'").count() > 0
    assert {r.kind for r in store.runs().collect()} == {"dataset", "ratings", "forecast", "model", "walk_forward", "report"}


def test_conflicts_stop_an_assembly_until_decided(spark, tables, tmp_path):
    games, stats, _ = tables
    store = Store(spark, str(tmp_path))
    some = games.where("season = 1995")
    changed = some.withColumn("home_score", F.col("home_score") + (F.col("game_id") == some.first().game_id).cast("int"))
    g = versions(some, "a", "2001-07-01").unionByName(versions(changed, "b", "2001-07-02")).cache()
    s = versions(stats.join(some.select("game_id"), "game_id", "left_semi"), "a", "2001-07-01")
    with pytest.raises(pipelines.validate.ValidationError, match="conflict"):
        pipelines.assemble(store, "x", g, s)


def test_refresh_from_json(spark, data, tmp_path):
    ok = "game_id % 101 > 1 AND game_id % 107 <> 0 AND game_id % 103 <> 0 AND game_id % 109 <> 0 AND (completed OR game_id % 11 <> 0) AND game_id > 0"
    games = registry.games(spark, data).where(ok).withColumns({c: F.col(c) + 1000 for c in ("home_team_id", "away_team_id")})
    cols = {"id": "game_id", "season": "season", "week": "week", "completed": "completed", "neutralSite": "neutral_site", "homeId": "home_team_id", "awayId": "away_team_id", "homePoints": "home_score", "awayPoints": "away_score"}
    rec = F.struct(*(F.col(v).alias(k) for k, v in cols.items()), F.date_format("game_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startDate"), F.lit("fbs").alias("homeClassification"), F.lit("fbs").alias("awayClassification"), F.lit("regular").alias("seasonType"))
    schedule = games.groupBy("week").agg(F.to_json(F.collect_list(rec)).alias("payload")).select("payload")
    good = registry.box_payloads(spark, data)
    boxes = good.withColumn("payload", F.regexp_replace("payload", '"teamId":(\\d)(?=,)', '"teamId":100$1'))
    faulty = F.get_json_object("payload", "$[0].id").cast("bigint")
    boxes = boxes.withColumn("g", faulty).where("g % 101 <> 0 AND g % 127 <> 0 AND g % 131 <> 0 AND g % 113 <> 0").join(games.where("completed").select(F.col("game_id").alias("g")), "g", "left_semi").select("payload")
    n = games.where("completed AND game_id % 127 <> 0 AND game_id % 131 <> 0 AND game_id % 113 <> 0")
    kept = games.where("NOT completed").unionByName(n)
    schedule = kept.groupBy("week").agg(F.to_json(F.collect_list(rec)).alias("payload")).select("payload")
    teams = registry.teams(spark, data).withColumn("team_id", F.col("team_id") + 1000)
    lines = registry.market.consensus_lines(registry.derived(spark, data, "line_items"))
    out = pipelines.refresh(Store(spark, str(tmp_path)), "j1", schedule, boxes, teams, lines, "2001-05-31 00:00:00")
    assert out.count() == kept.where("NOT completed").count()


def test_stream_merges_late_results(spark, tmp_path):
    landed, root = tmp_path / "landed", tmp_path / "root"
    landed.mkdir()

    def game(i, done, hp=None):
        return {"id": i, "season": 2026, "week": 1, "seasonType": "regular", "startDate": "2026-08-29T16:00:00Z", "startTimeTBD": False, "completed": done, "neutralSite": False, "homeId": 1, "awayId": 2, "homeClassification": "fbs", "awayClassification": "fbs"} | ({"homePoints": hp, "awayPoints": 3} if done else {})

    (landed / "1.json").write_text(json.dumps([game(1, False), game(2, True, 10), game(3, True, 7)]))
    run_available(spark, str(landed), str(root))
    # one batch of two files: an upcoming and a completed record of game 4, a new final of game 2, a record twice in a file
    (landed / "2.json").write_text(json.dumps([game(1, True, 21), game(2, True, 11), game(4, False)]))
    (landed / "3.json").write_text(json.dumps([game(4, True, 30), game(5, True, 1), game(5, True, 2)]))
    run_available(spark, str(landed), str(root))
    now = {r.game_id: (r.home_score, r.season_type) for r in current_games(spark, str(root)).collect()}
    assert now == {1: (21, "regular"), 2: (10, "regular"), 3: (7, "regular"), 4: (30, "regular")}
    store = game_store(spark, str(root))
    assert {(r.game_id, r.batch) for r in store.versions().collect()} == {(1, 0), (2, 0), (3, 0), (1, 1), (2, 1), (4, 1)}  # game 4 twice
    assert {(r.game_id, r.batch) for r in store.conflicts().collect()} == {(2, 0), (2, 1)}
    assert [(r.game_id, r.rule) for r in spark.read.parquet(f"{root}/quarantine/batch=1").collect()] == [(5, "duplicate_id")] * 2


def test_walk_forward_needs_no_ratings_and_features_of_its_models_only(spark, data, monkeypatch):
    from ratingloom.operators import models, ratings

    def refused(*args, **kwargs):
        raise AssertionError("ratings aren't asked for")

    metrics, made = [], pipelines.features.team_pregame_features
    monkeypatch.setattr(registry, "_CYCLED", {})
    monkeypatch.setattr(ratings, "fit_ratings", refused)
    monkeypatch.setattr(pipelines.features, "team_pregame_features", lambda g, s, m: metrics.append(m) or made(g, s, m))
    assert registry.QUERIES["pipeline_walk_overall"].run(spark, data).count() == len(models.COLUMN_MODELS)
    assert metrics == [models.COLUMN_METRICS]
