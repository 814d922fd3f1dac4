"""The stream's store of versions: what stands, open conflicts and decisions, pruning, compaction and repeated batches."""

import itertools
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ratingloom.operators.versions import merge_games
from ratingloom.streaming import RECORD, current_games, decision_batch, game_store, merge_batch, run_available

DAY = datetime(2026, 9, 1)
SCHEMA = "game_id bigint, season int, week int, game_date timestamp, home_team_id bigint, away_team_id bigint, home_score bigint, away_score bigint, neutral_site boolean, completed boolean, season_type string, run_id string, captured_at timestamp"


def rows(spark, batch, games):
    """Versions from (game, season, home score or None for upcoming)."""
    return spark.createDataFrame([(g, s, 1, DAY, 1, 2, h, None if h is None else 3, False, h is not None, "regular", f"run-{batch}", DAY) for g, s, h in games], SCHEMA)


def standing(df):
    return {r.game_id: r.home_score for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return game_store(spark, str(tmp_path / "store"))


def test_what_stands_and_what_is_open(spark, store):
    assert store.append(rows(spark, 0, [(1, 2025, None), (2, 2025, 10), (3, 2026, 7), (3, 2026, 8), (4, 2026, None)]), 0) == [2025, 2026]
    assert standing(store.current()) == {1: None, 2: 10, 4: None}  # the first batch disagrees with itself about game 3
    store.append(rows(spark, 1, [(1, 2025, 21), (2, 2025, 11), (2, 2025, 10), (4, 2026, 5), (4, 2026, 6)]), 1)
    assert standing(store.current()) == {1: 21, 2: 10, 4: None}
    assert standing(store.current(before=1)) == {1: None, 2: 10, 4: None}
    assert {(r.game_id, r.batch) for r in store.conflicts().collect()} == {(2, 0), (2, 1), (3, 0), (4, 1)}
    assert standing(store.current([2025])) == {1: 21, 2: 10}
    assert {r.batch for r in store.versions([2025]).where("game_id = 2 AND home_score = 10").collect()} == {0}  # sent again, kept once


def digest_of(store, game, score):
    return next(r.digest for r in store.versions().where((F.col("game_id") == game) & (F.col("home_score") == score)).collect())


def test_a_decision_in_a_later_batch_settles_the_game(spark, store):
    store.append(rows(spark, 0, [(2, 2025, 10), (5, 2025, 1)]), 0)
    store.append(rows(spark, 1, [(2, 2025, 11)]), 1)
    pick = spark.createDataFrame([(2, digest_of(store, 2, 11)), (5, digest_of(store, 5, 1)), (2025, "x")], "game_id bigint, digest string")
    refused = store.decide(pick, 2)
    assert {(r.game_id, r.rule) for r in refused.collect()} == {(5, "no_such_conflict"), (2025, "no_such_conflict")}
    assert standing(store.current()) == {2: 11, 5: 1} and store.conflicts().isEmpty()
    assert standing(store.current(before=2)) == {2: 10, 5: 1}
    store.append(rows(spark, 3, [(2, 2025, 10)]), 3)  # ruled out, sent again
    assert standing(store.current()) == {2: 11, 5: 1} and store.conflicts().isEmpty()
    store.append(rows(spark, 4, [(2, 2025, 12)]), 4)  # something new: open again
    assert {r.batch for r in store.conflicts().collect()} == {1, 4} and standing(store.current())[2] == 11
    twice = spark.createDataFrame([(2, digest_of(store, 2, 11), 2025), (2, digest_of(store, 2, 12), 2025)], "game_id bigint, digest string, season int")
    assert {r.rule for r in store.decide(twice, 5).collect()} == {"decided_twice"}
    assert {r.rule for r in store.decide(twice.limit(1).withColumn("digest", F.lit("none")), 5).collect()} == {"no_such_candidate"}
    for _ in range(2):  # a repeated call is the same call
        assert store.decide(twice.where(F.col("digest") == digest_of(store, 2, 12)), 5, 6).isEmpty()
    assert standing(store.current())[2] == 12 and store.conflicts().isEmpty()


def test_a_batch_reads_only_the_seasons_it_touches(spark, store, monkeypatch):
    for n in range(6):
        store.append(rows(spark, n, [(100 * n + s, 2020 + s, n) for s in range(6)]), n)
    read = []
    whole = store._read
    monkeypatch.setattr(store, "_read", lambda *a: (lambda df: (read.extend(df.inputFiles()), df)[1])(whole(*a)))
    store.append(rows(spark, 6, [(7, 2021, 1), (103, 2023, 3)]), 6)
    assert {f.split("season=")[1][:4] for f in read} == {"2021", "2023"} and len(read) <= 2 * 6
    read.clear()
    assert len(standing(store.current([2024]))) == 6
    assert {f.split("season=")[1][:4] for f in read} == {"2024"}
    store.compact(2024, 5)
    read.clear()
    store.current([2024]).count()
    assert len({f.split("part=")[1].split("/")[0] for f in read}) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_compaction_and_repeats_change_nothing(spark, tmp_path, seed):
    rng = random.Random(seed)
    batches = [[(g, 2025 + g % 2, rng.choice([None, None, 1, 1, 2])) for g in rng.choices(range(12), k=9)] for _ in range(5)]
    plain, busy = (game_store(spark, str(tmp_path / n)) for n in ("plain", "busy"))
    for n, games in enumerate(batches):
        plain.append(rows(spark, n, games), n)
        busy.append(rows(spark, n, games), n)
        busy.append(rows(spark, n, games), n)  # the batch once more
        if n == 2:
            open_ = [r for r in plain.conflicts().collect()]
            pick = {r.game_id: r.digest for r in sorted(open_, key=lambda r: r.digest)[: len(open_) // 2]}
            chosen = spark.createDataFrame(list(pick.items()), "game_id bigint, digest string")
            assert plain.decide(chosen, n).isEmpty() and busy.decide(chosen, n).isEmpty()
        if n in (1, 2, 3):
            for s in (2025, 2026):
                assert busy.compact(s, n) == busy.compact(s, n) == f"base-{n:012d}"
                if n == 3:
                    assert busy.vacuum(s) and not busy.vacuum(s)
        for view in ("current", "conflicts"):
            a, b = (sorted(map(str, getattr(x, view)().collect())) for x in (plain, busy))
            assert a == b, (view, n)
    # where no decision was taken, what stands without conflict is what a merge of all versions gives
    merged, conflicts, _ = merge_games(plain.versions().drop("digest", "ruled_out", "batch", "part"))
    decided = [r.game_id for r in plain.decisions().collect()]
    settled = {k: v for k, v in standing(merged).items() if k not in decided}
    assert {k: v for k, v in standing(plain.current()).items() if k in settled} == settled
    assert {r.game_id for r in conflicts.collect()} - set(decided) == {r.game_id for r in plain.conflicts().collect()} - set(decided)


def test_an_unfinished_base_is_not_read(spark, store, tmp_path):
    for n in range(2):
        store.append(rows(spark, n, [(n, 2025, n)]), n)
    store.compact(2025, 1)
    (tmp_path / "store/versions/season=2025/part=base-000000000001/_SUCCESS").unlink()
    assert store.parts(2025) == ["delta-000000000000", "delta-000000000001"] and store.vacuum(2025) == []
    assert standing(store.current()) == {0: 0, 1: 1}
    store.compact(2025, 1)
    assert store.parts(2025) == ["base-000000000001"] and standing(store.current()) == {0: 0, 1: 1}


def test_stream_with_compaction_and_decisions(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "root")
    landed.mkdir()

    def land(n, *games):
        body = [{"id": i, "season": 2026, "week": 1, "seasonType": "regular", "startDate": "2026-08-29T16:00:00Z", "startTimeTBD": False, "completed": True, "neutralSite": False, "homeId": 1, "awayId": 2, "homePoints": h, "awayPoints": 3, "homeClassification": "fbs", "awayClassification": "fbs"} for i, h in games]
        (landed / f"{n}.json").write_text(json.dumps(body))

    land(0, (1, 10), (2, 20))
    run_available(spark, str(landed), root)
    land(1, (1, 11))
    run_available(spark, str(landed), root)
    store = game_store(spark, root)
    assert standing(current_games(spark, root)) == {1: 10, 2: 20}
    decision_batch(root)(spark.createDataFrame([(1, digest_of(store, 1, 11)), (2, "?")], "game_id bigint, digest string"), 0)
    assert standing(current_games(spark, root)) == {1: 11, 2: 20}
    assert [(r.game_id, r.rule) for r in spark.read.parquet(f"{root}/refused/batch=0").collect()] == [(2, "no_such_conflict")]
    write = merge_batch(root, compact_every=2)
    payload = spark.createDataFrame([("f.json", (landed / "0.json").read_text())], "file string, payload string")
    write(payload, 2)
    assert store.parts(2026) == ["base-000000000002"] or len(store.parts(2026)) <= 2
    assert standing(current_games(spark, root)) == {1: 11, 2: 20} and store.conflicts().isEmpty()


def test_empty_store(spark, store):
    assert store.seasons() == [] and store.current().isEmpty() and store.conflicts().isEmpty() and store.append(rows(spark, 0, []), 0) == []
    assert set(store.current().columns) == set(RECORD.names)
    assert list(itertools.chain(store.parts(2025))) == []
