"""Overdue results: the rule over tables and the stream with timers against a plain simulation."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ratingloom.streaming.overdue import PROVIDER, landed_versions, overdue_events, watch_overdue

SCHEMA = "game_id bigint, captured_at timestamp, completed boolean, game_date timestamp, note map<string,int>"
ZERO = datetime(2026, 9, 1)


def day(n):
    return None if n is None else ZERO + timedelta(days=n)


def frame(spark, versions):
    return spark.createDataFrame([(g, day(at), done, day(kick), {"x": 1}) for g, at, done, kick in versions], SCHEMA)


def events(df):
    number = lambda t: None if t is None else (t - ZERO) / timedelta(days=1)
    return sorted((r.game_id, number(r.noted_at), r.event, number(r.kickoff)) for r in df.collect())


def plain(versions, wait, until):
    """Hour by hour: what a clerk with a calendar would note down."""
    out = []
    for game in {g for g, *_ in versions if g is not None}:
        kickoff = late = done = None
        for hour in range(-24 * 30, int(until * 24) + 1):
            now = hour / 24
            here = [(bool(d), k is not None, k or 0, k) for g, at, d, k in versions if g == game and at == now]
            if here and not done:
                done, _, _, kickoff = max(here)
                if late and done:
                    out.append((game, now, "result", kickoff))
                elif late and (kickoff is None or kickoff + wait > now):
                    out.append((game, now, "rescheduled", kickoff))
                    late = False
            if not done and not late and kickoff is not None and kickoff + wait <= now:
                late = True
                out.append((game, now, "overdue", kickoff))
    return sorted(out)


CASES = [
    (1, 0, False, 1), (1, 10, True, 1),  # overdue at 4, result at 10
    (2, 0, False, 1), (2, 3, True, 1),  # in time
    (3, 0, False, 1), (3, 4, True, 1),  # the result comes as the wait ends
    (4, 0, False, 1), (4, 6, False, 8), (4, 20, False, 8), (4, 21, True, 8),  # overdue, moved, overdue again
    (5, 9, False, 1), (5, 11, False, 1), (5, 12, False, 1),  # first heard of when overdue; warned once
    (6, 0, None, None), (6, 9, False, None), (7, 0, None, 2), (7, 0, None, 2), (7, 8, False, None),  # no kickoff, no flag
    (8, 0, False, 1), (8, 9, True, 1), (8, 9, False, 30), (8, 12, False, 40),  # a result wins a tie and is final
    (9, 0, True, -9), (None, 0, False, 0), (10, 0, False, 22), (10, 0, False, 3), (11, 25, False, 40),
]


def test_rule_over_a_table(spark):
    got = overdue_events(frame(spark, [*CASES, (12, None, False, 0)]), 3)
    assert events(got) == plain(CASES, 3, 25)
    assert [e[1:] for e in events(got) if e[0] == 4] == [(4, "overdue", 1), (6, "rescheduled", 8), (11, "overdue", 8), (21, "result", 8)]
    assert [e[1:] for e in events(got) if e[0] in (3, 5, 8)] == [(9, "overdue", 1), (4, "overdue", 1), (9, "result", 1)]
    cut = str(day(10))
    assert events(overdue_events(frame(spark, CASES), 3, cut)) == plain([c for c in CASES if c[1] <= 10], 3, 10)
    assert events(overdue_events(frame(spark, [(1, 0, False, 0)]).limit(0), 3)) == []


def test_random_versions_by_rule(spark):
    rng = random.Random(5)
    versions = [(rng.randrange(60), rng.randrange(48) / 2, rng.random() < 0.2, rng.choice([None, 0, 3, 6, 9, 15])) for _ in range(400)]
    assert events(overdue_events(frame(spark, versions), 3, str(day(24)))) == plain(versions, 3, 24)


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_gives_the_same_events_whatever_the_batches(spark, tmp_path, batches):
    before, folder, root = spark.conf.get(PROVIDER), tmp_path / "versions", str(tmp_path / "root")
    versions = sorted(CASES, key=lambda c: c[1])
    for n in range(batches):  # each run is a restart of the query; captures overlap by less than the delay
        part = [v for v in versions if n == min(int((v[1] + (v[0] or 0) % 2) / 25 * batches), batches - 1)]
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(folder))
        watch_overdue(spark.readStream.schema(SCHEMA).parquet(str(folder)), root, 3, "2 days")
    frame(spark, [(99, 27, True, 0)]).write.mode("append").parquet(str(folder))  # a later capture takes the clock to day 25
    watch_overdue(spark.readStream.schema(SCHEMA).parquet(str(folder)), root, 3, "2 days")
    assert events(spark.read.parquet(f"{root}/events")) == plain(CASES, 3, 25)
    assert spark.conf.get(PROVIDER) == before


def test_late_versions_and_forgotten_results(spark, tmp_path):
    folder, root = str(tmp_path / "versions"), str(tmp_path / "root")

    def run(*versions):
        frame(spark, list(versions)).coalesce(1).write.mode("append").parquet(folder)
        watch_overdue(spark.readStream.schema(SCHEMA).parquet(folder), root, 3, forget_days=20)

    run((1, 0, False, 1), (2, 5, True, 0))
    run((1, 2, True, 1), (2, 30, False, 20))  # the result lies before the clock, at 5, and is dropped; game 2 starts anew
    run((3, 40, True, 30))
    assert events(spark.read.parquet(f"{root}/events")) == [(1, 4, "overdue", 1), (2, 30, "overdue", 20)]


def test_landed_schedule_files(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "root")
    landed.mkdir()
    for n, (at, done) in enumerate([(0, False), (9, False), (12, True), (13, True)]):
        body = [{"id": 1, "season": 2026, "week": 1, "startDate": "2026-09-02T00:00:00Z", "completed": done, "homePoints": 7 if done else None}, {"id": 2, "startDate": "soon", "completed": False}]
        path = landed / f"{n}.json"
        path.write_text(json.dumps(body))
        stamp = (day(at) - datetime(1970, 1, 1)).total_seconds()
        os.utime(path, (stamp, stamp))
        watch_overdue(landed_versions(spark, str(landed)), root, 3)
    found = spark.read.parquet(f"{root}/events").where(F.col("game_id") == 1)
    assert events(found) == [(1, 4, "overdue", 1), (1, 12, "result", 1)]
