"""Landed JSON to canonical tables. Each reader gives (rows, rejected): a bad record is set aside with the rule it broke."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.market import consensus_lines

SCHEDULE = (
    "array<struct<id:bigint,season:bigint,week:bigint,seasonType:string,startDate:string,startTimeTBD:boolean,completed:boolean,neutralSite:boolean,"
    "homeId:bigint,homeTeam:string,homeClassification:string,homeConference:string,homePoints:bigint,"
    "awayId:bigint,awayTeam:string,awayClassification:string,awayConference:string,awayPoints:bigint>>"
)
BOXES = "array<struct<id:bigint,teams:array<struct<teamId:bigint,team:string,homeAway:string,points:bigint,stats:array<struct<category:string,stat:string>>>>>>"
LINES = "array<struct<id:string,homeTeam:string,awayTeam:string,lines:array<struct<provider:string,spread:string,overUnder:string>>>>"
#: Plays are counted as passing plus rushing attempts of the basic box score.
BASIS = "passing_plus_rushing_attempts"
ADVANCED = "struct<teams:struct<ppa:array<struct<team:string,overall:struct<total:double>>>,successRates:array<struct<team:string,overall:struct<total:double>>>,explosiveness:array<struct<team:string,overall:struct<total:double>>>,havoc:array<struct<team:string,total:double>>,scoringOpportunities:array<struct<team:string,pointsPerOpportunity:double>>>>"


def _records(payloads: DataFrame, schema: str, column: str) -> DataFrame:
    keep = [c for c in payloads.columns if c != column]
    return payloads.select(*keep, F.explode(F.from_json(column, schema)).alias("r")).select(*keep, "r.*")


def schedule_records(payloads: DataFrame, column: str = "payload") -> DataFrame:
    return _records(payloads, SCHEDULE, column)


def read_schedule(payloads: DataFrame, column: str = "payload", source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Games of two first-division teams, and the records that break a rule of the schedule.

    With ``source``, a column of ``payloads`` that both results keep, an id may stand once in each source; else once in all.
    """
    rows = schedule_records(payloads, column)
    own = [source] if source else []
    twice = rows.groupBy(*own, "id").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(twice, [*own, "id"], "left")
    when = F.try_to_timestamp("startDate")
    rule = (
        F.when(F.col("id").isNull() | (F.col("id") < 1), "invalid_id")
        .when(F.col("_n").isNotNull(), "duplicate_id")
        .when(~(F.col("homeClassification").eqNullSafe("fbs") & F.col("awayClassification").eqNullSafe("fbs")), "not_two_fbs_teams")
        .when(F.col("completed").isNull() | F.col("neutralSite").isNull(), "flags_not_boolean")
        .when(F.coalesce("startTimeTBD", F.lit(False)), "kickoff_unconfirmed")
        .when(F.col("startDate").isNull() | ~F.col("startDate").rlike(r"(Z|[+-]\d{2}:\d{2})$"), "kickoff_without_zone")
        .when(when.isNull(), "invalid_kickoff")
        .when(F.col("homeId").isNull() | F.col("awayId").isNull() | (F.least("homeId", "awayId") < 1), "invalid_team")
        .when(F.col("homeId") == F.col("awayId"), "self_play")
        .when(~F.col("completed") & (F.col("homePoints").isNotNull() | F.col("awayPoints").isNotNull()), "unfinished_with_score")
        .when(F.col("completed") & (F.col("homePoints").isNull() | F.col("awayPoints").isNull() | (F.least("homePoints", "awayPoints") < 0)), "invalid_score")
        .when(F.col("season").isNull() | (F.col("season") < 1) | F.col("week").isNull() | (F.col("week") < 0), "invalid_season_or_week")
    )
    rows = rows.withColumn("rule", rule)
    games = rows.where("rule IS NULL").select(
        F.col("id").alias("game_id"), F.col("season").cast("int").alias("season"), F.col("week").cast("int").alias("week"), when.alias("game_date"),
        F.col("homeId").alias("home_team_id"), F.col("awayId").alias("away_team_id"), F.when(F.col("completed"), F.col("homePoints")).alias("home_score"),
        F.when(F.col("completed"), F.col("awayPoints")).alias("away_score"), F.col("neutralSite").alias("neutral_site"), "completed", F.col("seasonType").alias("season_type"), *own,
    )
    return games, rows.where("rule IS NOT NULL").select(F.col("id").alias("game_id"), "rule", *own)


def capture_scope(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(game_id, reason) of schedule records; the reason is null for those in scope."""
    reason = (
        F.when((F.col("homeClassification") == "fcs") | (F.col("awayClassification") == "fcs"), "non_fbs_matchup")
        .when(~F.col("completed") & (F.col("homePoints").isNotNull() | F.col("awayPoints").isNotNull()), "unfinished_with_scores")
        .when(~F.col("completed") & (F.coalesce("startTimeTBD", F.lit(False)) | F.col("startDate").isNull()), "unconfirmed_upcoming_kickoff")
    )
    return schedule_records(payloads, column).select(F.col("id").alias("game_id"), reason.alias("reason"))


def pair(text: Column, part: int) -> Column:
    """A number of a pair text such as ``7-16``; null for other text."""
    return F.regexp_extract(text, r"^(\d+)-(\d+)$", part).try_cast("bigint")


def clock_seconds(text: Column) -> Column:
    """Seconds of ``MM:SS``; null for other text."""
    ok = text.rlike(r"^\d{1,3}:[0-5]\d$")
    return F.when(ok, F.split_part(text, F.lit(":"), F.lit(1)).try_cast("bigint") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).try_cast("bigint"))


def read_boxes(payloads: DataFrame, games: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Team statistics of completed games that have exactly one good box, and (game_id, rule) of the others.

    A box stays one row: its teams are read into an array of numbers, which meets the schedule once, and both teams' rows are taken
    from there. Of games with several boxes, none of which counts, one is kept.
    """
    stat = lambda t, name: F.get(F.filter(t["stats"], lambda s: s["category"] == name), F.lit(0))["stat"]
    whole = lambda t, name: F.when(stat(t, name).rlike(r"^-?\d+$"), stat(t, name).try_cast("bigint"))

    def read(t: Column) -> Column:
        values = {
            "team_id": t["teamId"], "home_away": t["homeAway"], "points": t["points"], "n_stats": F.size(t["stats"]), "n_distinct": F.size(F.array_distinct(F.transform(t["stats"], lambda s: s["category"]))),
            "total_yards": whole(t, "totalYards"), "passing_yards": whole(t, "netPassingYards"), "rushing_yards": whole(t, "rushingYards"), "turnovers": whole(t, "turnovers"),
            "third_down_conversions": pair(stat(t, "thirdDownEff"), 1), "third_down_attempts": pair(stat(t, "thirdDownEff"), 2), "penalties": pair(stat(t, "totalPenaltiesYards"), 1),
            "penalty_yards": pair(stat(t, "totalPenaltiesYards"), 2), "offensive_plays": pair(stat(t, "completionAttempts"), 2) + whole(t, "rushingAttempts"),
            "completions": pair(stat(t, "completionAttempts"), 1), "attempts": pair(stat(t, "completionAttempts"), 2), "time_of_possession_seconds": clock_seconds(stat(t, "possessionTime")),
        }
        return F.struct(*(v.alias(k) for k, v in values.items()))

    boxes = _records(payloads, BOXES, column).select("id", F.transform("teams", read).alias("t"))
    boxes = boxes.groupBy("id").agg(F.count("*").alias("boxes"), F.first("t").alias("t"))
    schedule = games.select(F.col("game_id").alias("id"), F.col("home_team_id").alias("h"), F.col("away_team_id").alias("a"), "home_score", "away_score", F.col("completed").alias("done"))
    needed = ("total_yards", "passing_yards", "rushing_yards", "turnovers", "third_down_attempts", "penalties", "offensive_plays", "time_of_possession_seconds")

    def broken(t: Column) -> Column:
        home = t["home_away"] == "home"
        missing = reduce(lambda x, y: x | y, (t[c].isNull() for c in needed))
        return (
            F.when(t["n_stats"] != t["n_distinct"], "duplicate_category")
            .when(F.coalesce(t["team_id"] != F.when(home, F.col("h")).otherwise(F.col("a")), F.lit(True)) | ~t["home_away"].isin("home", "away"), "teams_disagree_with_schedule")
            .when(F.coalesce(t["points"] != F.when(home, F.col("home_score")).otherwise(F.col("away_score")), F.lit(True)), "role_or_score_mismatch")
            .when(missing, "unreadable_value")
            .when((t["third_down_conversions"] > t["third_down_attempts"]) | (t["completions"] > t["attempts"]), "successes_exceed_attempts")
            .when(t["offensive_plays"] <= 0, "plays_not_positive")
            .when(t["turnovers"] < 0, "negative_turnovers")
            .when(t["total_yards"] != t["passing_yards"] + t["rushing_yards"], "yardage_components_disagree")
        )

    ids = F.size(F.array_distinct(F.filter(F.transform("t", lambda t: t["team_id"]), lambda x: x.isNotNull())))
    verdict = (
        F.when(F.col("done").isNull(), "unknown_game").when(~F.col("done") & F.col("boxes").isNotNull(), "unfinished_game_has_box")
        .when(F.col("done") & F.col("boxes").isNull(), "missing_box").when(F.col("boxes") > 1, "more_than_one_box")
        .when(F.col("boxes").isNotNull() & (F.coalesce(F.size("t") != 2, F.lit(True)) | F.coalesce(ids != 2, F.lit(True))), "not_two_teams")
        .otherwise(F.array_min(F.transform("t", broken)))
    )
    state = schedule.join(boxes, "id", "full").withColumn("verdict", verdict)
    good = state.where("verdict IS NULL AND done")
    both = good.select("id", "home_score", "away_score", F.inline(F.array(*(F.struct(F.get("t", F.lit(i)).alias("own"), F.get("t", F.lit(1 - i)).alias("other")) for i in (0, 1)))))
    is_home = F.col("own.home_away") == "home"
    stats = both.select(
        F.col("id").alias("game_id"), F.col("own.team_id").alias("team_id"), F.col("other.team_id").alias("opponent_id"), is_home.alias("is_home"), F.col("own.points").alias("points"),
        F.when(is_home, F.col("away_score")).otherwise(F.col("home_score")).alias("points_allowed"), "own.total_yards", "own.offensive_plays", "own.passing_yards", "own.rushing_yards",
        "own.turnovers", F.col("other.turnovers").alias("takeaways"), "own.third_down_attempts", "own.third_down_conversions", F.lit(None).cast("bigint").alias("red_zone_attempts"), F.lit(None).cast("bigint").alias("red_zone_touchdowns"),
        "own.penalties", "own.penalty_yards", "own.time_of_possession_seconds", F.lit(BASIS).alias("offensive_plays_basis"),
    )
    return stats, state.where("verdict IS NOT NULL").select(F.col("id").alias("game_id"), F.col("verdict").alias("rule"))


def read_lines(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(game_id, provider, spread, over_under, pos) of all providers' lines; a number may come as text, other text is null."""
    rows = _records(payloads, LINES, column).select(F.col("id").try_cast("bigint").alias("game_id"), "homeTeam", "awayTeam", F.posexplode("lines").alias("pos", "l"))
    number = lambda c: F.trim(c).try_cast("double")
    return rows.select("game_id", F.col("homeTeam").alias("home_name"), F.col("awayTeam").alias("away_name"), F.col("l.provider").alias("provider"), number(F.col("l.spread")).alias("spread"), number(F.col("l.overUnder")).alias("over_under"), "pos")


def read_consensus(payloads: DataFrame, column: str = "payload") -> DataFrame:
    return consensus_lines(read_lines(payloads, column))


def read_advanced(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(game_id, team, success_rate, ppa, explosiveness, havoc, points_per_opportunity) of typed advanced boxes (game_id, payload)."""
    box = payloads.select("game_id", F.from_json(column, ADVANCED)["teams"].alias("t"))
    pick = {
        "success_rate": ("successRates", lambda x: x["overall"]["total"]), "ppa": ("ppa", lambda x: x["overall"]["total"]), "explosiveness": ("explosiveness", lambda x: x["overall"]["total"]),
        "havoc": ("havoc", lambda x: x["total"]), "points_per_opportunity": ("scoringOpportunities", lambda x: x["pointsPerOpportunity"]),
    }

    def rows(metric: str, category: str, value) -> Column:
        return F.transform(F.col(f"t.{category}"), lambda x: F.struct(x["team"].alias("team"), F.lit(metric).alias("metric"), value(x).alias("value")))

    parts = [F.coalesce(rows(m, c, g), F.array().cast("array<struct<team:string,metric:string,value:double>>")) for m, (c, g) in pick.items()]
    long = box.select("game_id", F.explode(F.concat(*parts)).alias("m")).select("game_id", "m.*")
    return long.groupBy("game_id", "team").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in pick))


#: Objects within objects up to which a dynamic box is descended into; deeper ones are set aside.
MAX_DEPTH = 64


CAPITAL = "(?<!^)(?=[A-Z])"


def snake(name: Column) -> Column:
    """A key in snake case: an underscore before each capital but the first character."""
    return F.lower(F.regexp_replace(name, CAPITAL, "_"))


@lru_cache(4096)
def _underscored(key: str) -> str:
    return re.sub(CAPITAL, "_", key)


class _Number(str):
    """A JSON number as it is written."""


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _unique(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key stands twice in an object")
    return found


#: JSON as ``parse_json`` takes it: the keys of an object differ, and NaN is none. The second leaves numbers as they are written.
_PLAIN = json.JSONDecoder(parse_int=float, parse_constant=_no_constant, object_pairs_hook=_unique)
_WRITTEN = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_no_constant, object_pairs_hook=_unique)


def _parsed(text: str | None, decoder: json.JSONDecoder = _PLAIN):
    """(value, no rule) of a JSON text, or (None, the rule); as by ``parse_json``, what follows the value is not looked at."""
    try:
        return decoder.raw_decode(text, len(text) - len(text.lstrip(" \t\r\n")))[0], None
    except (AttributeError, TypeError, ValueError, RecursionError):  # no text, no JSON, or thousands of levels
        return None, "invalid_json"


def _depth(value) -> int:
    """How many objects lie within each other."""
    deepest, todo = 0, [(value, 0)]
    while todo:
        v, above = todo.pop()
        if isinstance(v, dict):
            deepest = max(deepest, above + 1)
            todo += [(x, above + 1) for x in v.values()]
        elif isinstance(v, list):
            todo += [(x, above) for x in v]
    return deepest


def _broken(text: str, box) -> str | None:
    """The rule that a box breaks."""
    teams = box.get("teams") if isinstance(box, dict) else None
    if not isinstance(teams, dict):
        return "no_teams"
    if not all(isinstance(entries, list) for entries in teams.values()):
        return "category_not_a_list"
    for entries in teams.values():
        for e in entries:
            name = e.get("team") if isinstance(e, dict) else None
            if name is None or name == "" or isinstance(name, (dict, list)):
                return "entry_without_team"
    return "too_deep" if text.count("{") > MAX_DEPTH and _depth(box) > MAX_DEPTH else None


def _leaves(name: str, record: dict, top: bool = True) -> Iterator[tuple]:
    """(metric, number, text, flag) of the values of a record and of the objects in it."""
    for key, v in record.items():
        kind = type(v)
        if top and key == "team" or kind is list:
            continue
        metric = f"{name}_{_underscored(key)}"
        if kind is dict:
            yield from _leaves(metric, v, False)
        elif kind is float:
            yield metric, v + 0.0, None, None
        else:
            yield metric, None, *((v, None) if kind is str else (None, v))


#: Rows that a task holds before it passes them on.
LEAVES = 20_000
_FLAT = {"team": pa.string(), "raw_team": pa.string(), "metric": pa.string(), "entry": pa.int32(), "value": pa.float64(), "text": pa.string(), "flag": pa.bool_(), "rule": pa.string()}


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of boxes (game_id, payload) a row a leaf, or one with the rule that the box breaks. A team that is no text is left in ``raw_team`` as JSON."""
    for batch in batches:
        at: list[int] = []
        rows: list[tuple] = []

        def passed_on() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)] or [[] for _ in _FLAT]
            out = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, _FLAT.values()))]
            at.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["game_id", *_FLAT])

        for k, text in enumerate(batch.column(1).to_pylist()):
            box, rule = _parsed(text)
            rule = rule or _broken(text, box)
            if rule:
                at.append(k)
                rows.append((None, None, None, None, None, None, None, rule))
                continue
            # halves of surrogate pairs, which only escapes can bring, are written as question marks
            clean = (lambda t: t and t.encode(errors="replace").decode()) if "\\u" in text else (lambda t: t)
            for category, entries in box["teams"].items():
                name = _underscored(category)
                for entry, e in enumerate(entries):
                    own = (clean(e["team"]), None) if type(e["team"]) is str else (None, json.dumps(e["team"]))
                    if type(e["team"]) is float:
                        own = (None, _parsed(text, _WRITTEN)[0]["teams"][category][entry]["team"])
                    for metric, number, written, flag in _leaves(name, e):
                        at.append(k)
                        rows.append((*own, clean(metric), entry, number, clean(written), flag, None))
                    if len(rows) > LEAVES:
                        yield passed_on()
        yield passed_on()


def flatten_advanced(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Long form (game_id, team, metric, entry, value, text, flag) of dynamic advanced boxes, and (game_id, rule) of the broken ones.

    Categories and nesting may differ from box to box: each is read once, to its own depth. A metric's name joins the keys on its
    path in snake case; its value is a number, text or flag, in the column of its kind (all null for a JSON null). Arrays inside a
    record are passed over. A box that breaks a rule gives no rows at all. A team that a category lists twice has both entries'
    rows; ``entry`` tells their order.
    """
    game = dict(payloads.dtypes)["game_id"]
    flat = payloads.select("game_id", F.col(column).cast("string")).mapInArrow(
        _flattened, f"game_id {game}, team string, raw_team string, metric string, entry int, value double, text string, flag boolean, rule string"
    )
    team = F.coalesce("team", F.try_variant_get(F.try_parse_json("raw_team"), "$", "string"))
    leaves = flat.where("rule IS NULL").select("game_id", team.alias("team"), F.lower("metric").alias("metric"), "entry", "value", "text", "flag")
    return leaves, flat.where("rule IS NOT NULL").select("game_id", "rule")


def pivot_advanced(long: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """A row per game and team with the numbers as columns; of repeated entries the last counts."""
    return long.groupBy("game_id", "team").pivot("metric", metrics).agg(F.max_by("value", "entry"))
