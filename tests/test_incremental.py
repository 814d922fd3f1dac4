"""Late results recompute what they touch, and give what a full run gives."""

from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ratingloom.operators import features, ratings
from ratingloom.operators.validate import ValidationError
from ratingloom.plans import incremental, registry
from ratingloom.plans.pipelines import Dataset
from ratingloom.sources.store import Store


@pytest.fixture(scope="module")
def league(spark, data):
    games = registry.games(spark, data).withColumn("game_date", F.col("game_date").cast("timestamp")).where("season >= 1998").cache()
    return games, registry.stats(spark, data).join(games, "game_id", "left_semi").cache(), registry.teams(spark, data).cache()


@pytest.fixture(scope="module")
def first(spark, league, tmp_path_factory):
    """A store whose first run lacks one result of 1999, and that game."""
    games, stats, teams = league
    late = games.where("completed AND season = 1999").orderBy("game_date", "game_id").first()
    is_late = F.col("game_id") == late.game_id
    was = games.withColumns({c: F.when(~is_late, F.col(c)) for c in ("home_score", "away_score")} | {"completed": F.col("completed") & ~is_late})
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    incremental.start(store, "a", Dataset(was, stats.where(~is_late)), teams)
    incremental.weekly(store, "b", "a", games.where(is_late), stats.where(is_late), teams)
    return store, late


def written(store, table, run):
    return {p.name for p in Path(store.root, table, f"run_id={run}").iterdir() if p.is_dir()}


def same(a, b):
    return rows(a.toPandas()) == rows(b.select(*a.columns).toPandas())


def test_a_late_result_recomputes_one_season_and_equals_a_full_run(first, league):
    store, late = first
    games, stats, teams = league
    assert written(store, "games", "b-data") == written(store, "team_features", "b-features") == {"season=1999"} and written(store, "ratings", "b-ratings") == {"unit=1999"}
    assert same(store.load("games", "b-data"), games)
    assert same(store.load("ratings", "b-ratings"), ratings.fit_ratings(games, stats, teams))
    assert same(store.load("team_features", "b-features"), features.team_pregame_features(games, stats))


def test_only_the_game_s_teams_are_dirty(first):
    store, late = first
    pairs = incremental.dirty_teams(incremental.load_dataset(store, "a-data", [1999]), incremental.load_dataset(store, "b-data", [1999]))
    assert {tuple(r) for r in pairs.collect()} == {(late.home_team_id, 1999), (late.away_team_id, 1999)}
    assert incremental.dirty_seasons(store, "a-data", "b-data") == [1999]


def test_nothing_new_writes_nothing(first, league):
    store, _ = first
    games, stats, teams = league
    old = games.where("season = 2000")
    incremental.weekly(store, "same", "b", old, stats.join(old, "game_id", "left_semi"), teams)
    assert written(store, "ratings", "same-ratings") == written(store, "team_features", "same-features") == set()
    assert same(store.load("ratings", "same-ratings"), store.load("ratings", "b-ratings"))
    assert store.load("ratings", "same-ratings", only=[1999]).count() > 0


def test_other_parameters_make_all_seasons_dirty(first, league):
    store, _ = first
    games, stats, teams = league
    assert incremental.update_ratings(store, "other", "b-data", teams, "b-ratings", ratings.Settings(decay=0.9)) is None
    assert same(store.load("ratings", "other"), ratings.fit_ratings(games, stats, teams, s=ratings.Settings(decay=0.9)))


def test_contradictions_need_decisions(first, league):
    store, late = first
    games, stats, _ = league
    is_late = F.col("game_id") == late.game_id
    game = games.where(is_late).withColumn("home_score", F.col("home_score") + 1)
    own = F.when(F.col("is_home"), F.col("points") + 1).otherwise(F.col("points"))
    box = stats.where(is_late).withColumns({"points": own, "points_allowed": F.when(F.col("is_home"), F.col("points_allowed")).otherwise(F.col("points_allowed") + 1)})
    with pytest.raises(ValidationError, match="conflict"):
        incremental.add_results(store, "c1", "b-data", game, box)
    decided = game.select("game_id", F.lit("c2").alias("run_id"))
    assert incremental.add_results(store, "c2", "b-data", game, box, decided) == [1999]
    assert store.load("games", "c2", only=[1999]).where(is_late).first().home_score == late.home_score + 1
    with pytest.raises(ValidationError, match="stats_of_unknown_game"):
        incremental.add_results(store, "c3", "b-data", game, stats.where("game_id <> -1"))


def test_bases_are_checked(first, league):
    store, _ = first
    games = league[0]
    with pytest.raises(ValueError, match="outside"):
        store.publish("x1", "dataset", {"games": games}, partition={"games": "season"}, base="b-data", replaces={"games": [1999]})
    with pytest.raises(ValueError, match="needs partitions"):
        store.publish("x2", "dataset", {"games": games}, base="b-data")
    store.publish("x3", "dataset", {"games": games.limit(0)}, partition={"games": "season"}, base="b-data", replaces={"games": [1999]})
    assert store.load("games", "x3").where("season = 1999").count() == 0 and store.load("games", "x3", only=[1999]).count() == 0
    assert store.load("games", "x3").count() == games.where("season <> 1999").count()
    part = next(Path(store.root, "games", "run_id=a-data", "season=2000").glob("*.parquet"))
    kept = part.read_bytes()
    try:
        games.where("season = 2000").limit(1).drop("season").toPandas().to_parquet(part)
        Path(part.parent, f".{part.name}.crc").unlink(missing_ok=True)
        with pytest.raises(Exception):
            store.load("games", "b-data")
        assert store.load("games", "b-data", only=[1999]).count() > 0
    finally:
        part.write_bytes(kept)


def test_ratings_after_late_results_do_not_wait_for_features(spark, data, monkeypatch):
    from ratingloom.plans import registry

    registry._UPDATED.pop((spark.sparkContext.applicationId, data), None)
    monkeypatch.setattr(incremental, "update_features", lambda *a, **k: (_ for _ in ()).throw(AssertionError("features aren't asked for")))
    assert registry.QUERIES["ratings_after_late_results"].run(spark, data).count() > 0
    assert registry.QUERIES["seasons_of_late_results"].run(spark, data).count() > 0
    monkeypatch.undo()
    assert registry.QUERIES["features_after_late_results"].run(spark, data).count() > 0
