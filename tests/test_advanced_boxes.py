"""Dynamic advanced boxes: any depth, all kinds of values, and broken boxes set aside whole."""

import json

from ratingloom.sources.raw_json import flatten_advanced, pivot_advanced, snake
from pyspark.sql import functions as F


def boxes(spark, *payloads):
    texts = [p if p is None or isinstance(p, str) else json.dumps(p) for p in payloads]
    return spark.createDataFrame(list(enumerate(texts, 1)), "game_id bigint, payload string")


def nested(depth, leaf):
    for k in range(depth, 0, -1):
        leaf = {f"level{k}": leaf}
    return leaf


def test_any_depth_and_kind_of_value(spark):
    record = {"team": "A{", "plays": 60, "note": 'a "quoted\\" } brace', "isHome": True, "gone": None, "list": [1, {"x": 2}], "empty": {}, "deep": nested(20, {"team": "kept", "overallTotal": 0.25})}
    long, rejected = flatten_advanced(boxes(spark, {"teams": {"ppa": [record]}, "other": {"a": {"b": 1}}}))
    got = {r.metric: (r.value, r.text, r.flag) for r in long.collect()}
    deep = "ppa_deep_" + "_".join(f"level{k}" for k in range(1, 21))
    assert got == {
        "ppa_plays": (60.0, None, None), "ppa_note": (None, 'a "quoted\\" } brace', None), "ppa_is_home": (None, None, True), "ppa_gone": (None, None, None),
        f"{deep}_team": (None, "kept", None), f"{deep}_overall_total": (0.25, None, None),
    }
    assert {r.team for r in long.collect()} == {"A{"} and rejected.count() == 0


def test_flat_records_and_no_boxes(spark):
    long, _ = flatten_advanced(boxes(spark, {"teams": {"havoc": [{"team": "A", "total": 1}, {"team": "B"}]}}))
    assert [(r.team, r.metric, r.value) for r in long.collect()] == [("A", "havoc_total", 1.0)]
    for empty in (boxes(spark).limit(0), boxes(spark, {"teams": {}}), boxes(spark, {"teams": {"ppa": []}})):
        long, rejected = flatten_advanced(empty)
        assert long.count() == 0 and rejected.count() == 0


def test_broken_boxes_give_no_rows(spark):
    good = {"team": "A", "plays": 1}
    broken = {
        "invalid_json": [None, "", '{"teams": {', "nothing"],
        "no_teams": [{"gameInfo": {}}, {"teams": None}, {"teams": [good]}, {"teams": "x"}, [], "3"],
        "category_not_a_list": [{"teams": {"ppa": {"team": "A"}}}, {"teams": {"ppa": [good], "havoc": None}}],
        "entry_without_team": [{"teams": {"ppa": [good, {"plays": 1}]}}, {"teams": {"ppa": [{"team": ""}]}}, {"teams": {"ppa": [3]}}, {"teams": {"ppa": [None]}}, {"teams": {"ppa": [{"team": None}]}}, {"teams": {"ppa": [{"team": {"id": 1}}]}}],
        "too_deep": [{"teams": {"ppa": [{"team": "A", **nested(80, 1)}]}}],
    }
    cases = [(rule, p) for rule, ps in broken.items() for p in ps]
    long, rejected = flatten_advanced(boxes(spark, *(p for _, p in cases)))
    assert long.count() == 0
    assert [(r.game_id, r.rule) for r in rejected.orderBy("game_id").collect()] == [(k, rule) for k, (rule, _) in enumerate(cases, 1)]


def test_the_last_of_repeated_entries_counts(spark):
    long, _ = flatten_advanced(boxes(spark, {"teams": {"ppa": [{"team": "A", "plays": 9}, {"team": "B", "plays": 5}, {"team": "A", "plays": 2}]}}))
    assert {(r.team, r.ppa_plays) for r in pivot_advanced(long).collect()} == {("A", 2.0), ("B", 5.0)}


def test_snake_case(spark):
    names = ["successRates", "PPA", "quarter1", "already_snake", "pointsPerOpportunity"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(snake(F.col("n"))).collect()]
    assert got == ["success_rates", "p_p_a", "quarter1", "already_snake", "points_per_opportunity"]


def test_boxes_are_read_once_and_without_a_pass_for_their_depth(spark):
    made = spark.sparkContext.accumulator(0)

    def payloads(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(payload='{"teams":{"ppa":[{"team":"A","overall":{"total":0.5}}]}}')[["game_id", "payload"]]

    long, _ = flatten_advanced(spark.range(50).withColumnRenamed("id", "game_id").mapInPandas(payloads, "game_id bigint, payload string"))
    assert made.value == 0
    assert long.count() == 50 and made.value == 50


def test_teams_that_are_numbers_or_flags_and_numbers_of_any_form(spark):
    texts = ['{"teams":{"ppa":[{"team":%s,"x":%s}]}}' % c for c in (("12", "-0"), ("1.50", "1e400"), ("true", "12345678901234567890123"), ('"a"', "NaN"), ('"{b"', '"\\ud800"'), ('"c"', '1,"x":2'))]
    long, rejected = flatten_advanced(boxes(spark, *texts))
    assert [(r.team, str(r.value), r.text) for r in long.orderBy("game_id").collect()] == [("12", "0.0", None), ("1.5", "inf", None), ("true", "1.2345678901234568e+22", None), ("{b", "None", "?")]
    assert [(r.game_id, r.rule) for r in rejected.orderBy("game_id").collect()] == [(4, "invalid_json"), (6, "invalid_json")]
