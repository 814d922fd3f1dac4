"""Running totals and expanding medians against numpy, and periods, training sets and ridges of several leagues."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_asof import two  # noqa: F401
from test_league import league, season  # noqa: F401

from ratingloom.operators import features, models, scans
from ratingloom.sources import store


@pytest.mark.parametrize("block, n", [(1, 9), (4, 9), (32, 70), (1000, 5)])
def test_running_totals(spark, block, n):
    rng = np.random.default_rng(n)
    rows = [(k, o, rng.normal(size=3)) for k in ("a", "b") for o in range(1, n + (k == "b"))]
    d = spark.createDataFrame([(k, o, v.tobytes()) for k, o, v in rows], "k string, ord int, v binary").repartition(5)
    got = {(r["k"], r["ord"]): np.frombuffer(r["v"]) for r in scans.running_totals(d, ["k"], "ord", "v", block).collect()}
    assert len(got) == len(rows)
    for k, o, _ in rows:
        assert np.allclose(got[k, o], sum((v for q, p, v in rows if q == k and p < o), np.zeros(3)), atol=1e-12)


def medians(spark, rows, asks, bucket_rows):
    d = spark.createDataFrame(rows, "k string, f int, ord int, value double").repartition(4)
    a = spark.createDataFrame(asks, "k string, f int, ord int")
    return {(r["k"], r["f"], r["ord"]): r["median"] for r in scans.expanding_medians(d, a, ["k", "f"], bucket_rows).collect()}


@pytest.mark.parametrize("bucket_rows", [4, 60, 10_000])
def test_expanding_medians_equal_numpy(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(scans, "BUCKETS", 5)
    rng = np.random.default_rng(7)
    rows = []
    for k in ("a", "b"):
        for f, draw in enumerate((lambda: rng.normal(), lambda: float(rng.integers(3)), lambda: 0.0, lambda: 1e300 * rng.normal(), lambda: rng.choice([None, float("nan"), 1.5, -2.0]))):
            rows += [(k, f, int(rng.integers(1, 13)), None if (v := draw()) is None else float(v)) for _ in range(150)]
    rows += [("c", 0, 5, 2.0), ("c", 0, 5, 4.0)]
    asks = [(k, f, o) for k in "abc" for f in range(5) for o in (1, 2, 5, 6, 9, 14)]
    want = {}
    for k, f, o in asks:
        v = [x for q, g, p, x in rows if (q, g) == (k, f) and p < o and x is not None and x == x]
        if v:
            want[k, f, o] = float(np.median(v))
    assert medians(spark, rows, asks, bucket_rows) == pytest.approx(want)
    assert medians(spark, rows, asks, bucket_rows)["c", 0, 14] == 3.0


def test_no_values_no_medians(spark):
    assert medians(spark, [], [("a", 0, 1)], 10) == {}
    assert medians(spark, [("a", 0, 1, None)], [("a", 0, 2)], 10) == {}
    assert medians(spark, [("a", 0, 1, 1.0)], [], 10) == {}


def test_no_task_sorts_more_than_a_bucket(spark, monkeypatch):
    """Every group that is sorted is within the bound, though one value holds half of all rows and another half lies close together."""
    rng = np.random.default_rng(1)
    value = np.where(rng.random(3000) < 0.5, 7.0, 1 + rng.random(3000) * 1e-9)
    value[:5] = 1e12
    d = spark.createDataFrame([("a", int(o), float(v)) for o, v in zip(rng.integers(1, 40, 3000), value)], "k string, ord int, value double")
    rounds = []

    def watched(df):
        out = store.cut(df)
        if "_rows" in df.columns:
            rounds.append(out.agg(F.max(F.when(F.col("_low") < F.col("_high"), F.col("_rows")))).first()[0] or 0)
        return out

    monkeypatch.setattr(scans, "cut", watched)
    asks = spark.createDataFrame([("a", o) for o in range(2, 42)], "k string, ord int")
    got = {r["ord"]: r["median"] for r in scans.expanding_medians(d, asks, ["k"], 100).collect()}
    assert len(rounds) > 1 and rounds[0] > 100 >= rounds[-1]  # a group of one value needs no sort, and has a row a period
    table = d.toPandas()
    assert got == {o: float(np.median(table.value[table.ord < o])) for o in range(2, 42)}


def test_leagues_have_periods_and_training_sets_of_their_own(spark, two):  # noqa: F811
    games, stats, _ = two
    m = features.matchup_features(games, features.team_pregame_features(games, stats, unit="unit")).cache()
    p = models.with_periods(m, "league").cache()
    assert [tuple(r) for r in p.groupBy("league").agg(F.max("ord"), F.min("ord")).orderBy("league").collect()] == [("one", 8, 1), ("two", 16, 1)]
    names = ("home_points_season", "away_points_l3", "home_field_indicator")
    own = models.Registry(trained={"m": models.ExpandingRidge(names)})
    both = models.predict(models.eligible(p, models.training_summary(p)), ["train_mean", "rolling_average", "m"], p, own)
    for name in ("one", "two"):
        q = models.with_periods(m.where(F.col("league") == name)).cache()
        alone = models.predict(models.eligible(q, models.training_summary(q)), ["train_mean", "rolling_average", "m"], q, own)
        low = 0 if name == "one" else 1000
        cols = ["game_id", "model", "ord", "home_points", "away_points", "home_win_probability"]
        a, b = (x.select(*cols).orderBy("game_id", "model").toPandas() for x in (both.where(F.col("game_id").between(low, low + 999)), alone))
        assert len(a) > 0 and a.iloc[:, :3].values.tolist() == b.iloc[:, :3].values.tolist()
        assert np.allclose(a.iloc[:, 3:].astype(float), b.iloc[:, 3:].astype(float), atol=1e-9)


def test_exact_medians_of_columns(spark):
    d = spark.createDataFrame([(1.0, None, 3), (2.0, None, 1), (None, None, 2), (5.0, None, 10)], "a double, b double, c int")
    assert models.exact_medians(d, ["a", "b", "c"]) == {"a": 2.0, "c": 2.5}
