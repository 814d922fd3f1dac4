"""Versioned records: merge of snapshots, conflicts, review decisions, differences and reuse of archived boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GAMES, STATS
from ..sources.store import record_digest

GAME = tuple(GAMES.names)
STAT = tuple(STATS.names)


def own_columns(versions: DataFrame) -> tuple[str, ...]:
    """The columns of a record: all but those that tell its version."""
    return tuple(c for c in versions.columns if c not in ("run_id", "captured_at"))


#: Columns that ``settled_games`` and ``settled_stats`` add to a record.
MARKS = ("_digest", "_kept", "_upgraded")


def settled_games(versions: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Game versions that a merge takes (``_kept``) or finds in conflict, marked. Versions are shuffled once, to their game, and told apart there."""
    columns = columns or own_columns(versions)
    game = Window.partitionBy("game_id")
    rows = versions.where("game_id IS NOT NULL").repartition("game_id").withColumn("_digest", record_digest(sorted(columns)))
    rows = rows.withColumn("_n", F.row_number().over(game.orderBy(F.desc("completed"), "captured_at", "run_id")))
    rows = rows.withColumns({"_final": F.coalesce(F.max("completed").over(game), F.lit(False)), "_first": F.min_by("completed", F.struct("captured_at", "run_id")).over(game)})
    counts = F.when(F.col("completed") | ~F.col("_final"), F.col("_digest"))  # one record has the same digest at either end
    rows = rows.withColumn("_one", F.min(counts).over(game) == F.max(counts).over(game))
    rows = rows.withColumns({"_kept": F.col("_one") & (F.col("_n") == 1), "_upgraded": F.col("_one") & F.col("_final") & ~F.col("_first")})
    return rows.where(F.col("_kept") | (~F.col("_one") & (F.col("completed") | ~F.col("_final")))).drop("_final", "_first", "_one", "_n")


def split_games(settled: DataFrame, columns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, conflicts, upgraded) of what ``settled_games`` gave."""
    columns = columns or tuple(c for c in own_columns(settled) if c not in MARKS)
    return settled.where("_kept").select(*columns), settled.where("NOT _kept").select("game_id", "run_id", F.col("_digest").alias("digest")), settled.where("_kept AND _upgraded").select("game_id")


def merge_games(versions: DataFrame, columns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, conflicts, upgraded) of game versions with run_id and captured_at; extra columns belong to the record.

    Equal records are one. Completed records replace upcoming ones, and later upcoming ones are passed over; more than one
    record among the completed (or, without any, among the upcoming) is a conflict. ``upgraded`` are games whose first version
    was upcoming and that are completed now.
    """
    columns = columns or own_columns(versions)
    return split_games(settled_games(versions, columns), columns)


def settled_stats(versions: DataFrame, columns: tuple[str, ...] = STAT) -> DataFrame:
    """As ``settled_games``, of team statistics: any difference between versions is a conflict."""
    row = Window.partitionBy("game_id", "team_id")
    rows = versions.where("game_id IS NOT NULL AND team_id IS NOT NULL").repartition("game_id", "team_id").withColumn("_digest", record_digest(list(columns)))
    rows = rows.withColumn("_n", F.row_number().over(row.orderBy("run_id"))).withColumn("_one", F.min("_digest").over(row) == F.max("_digest").over(row))
    return rows.withColumn("_kept", F.col("_one") & (F.col("_n") == 1)).where(F.col("_kept") | ~F.col("_one")).select(*columns, "run_id", "_digest", "_kept")


def split_stats(settled: DataFrame, columns: tuple[str, ...] = STAT) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of what ``settled_stats`` gave."""
    return settled.where("_kept").select(*columns), settled.where("NOT _kept").select("game_id", "team_id", "run_id", F.col("_digest").alias("digest"))


def merge_stats(versions: DataFrame, columns: tuple[str, ...] = STAT) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of team statistics: any difference between versions is a conflict."""
    return split_stats(settled_stats(versions, columns), columns)


def review_plan(games: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Candidate versions of each game in conflict: (game_id, run_id, digest of the game and its sorted team rows).

    Completed versions are the candidates if there are any, else all.
    """
    out = games.select("game_id", "run_id", "completed", record_digest(sorted(own_columns(games))).alias("_game"))
    if stats is not None:
        rows = stats.select("game_id", "run_id", F.struct("team_id", record_digest(list(STAT)).alias("d")).alias("r"))
        boxes = rows.groupBy("game_id", "run_id").agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("_box"))  # two rows a game and run
        out = out.join(boxes, ["game_id", "run_id"], "left")
    else:
        out = out.withColumn("_box", F.lit(None).cast("string"))
    game = Window.partitionBy("game_id")
    out = out.withColumn("digest", F.sha2(F.concat_ws("|", "_game", F.coalesce("_box", F.lit(""))), 256)).withColumn("_final", F.max("completed").over(game))
    eligible = out.where("completed OR NOT _final")
    n = F.size(F.collect_set("digest").over(game))
    return eligible.withColumn("_k", n).where("_k > 1").select("game_id", "run_id", "digest")


def review_token(games: DataFrame) -> str:
    """Token of the versions under review: it changes with any of them."""
    from ..sources.store import fingerprint

    r = fingerprint(games).first()
    return f"{r['rows']}-{r['digest']}"


def decision_violations(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """(rule, game_id) of decisions (game_id, run_id) that don't fit the plan: one is needed for each conflict, of a candidate."""
    games = plan.select("game_id").distinct()
    missing = games.join(decisions.select("game_id"), "game_id", "left_anti").select(F.lit("decision_missing").alias("rule"), "game_id")
    extra = decisions.join(games, "game_id", "left_anti").select(F.lit("no_such_conflict").alias("rule"), "game_id")
    twice = decisions.groupBy("game_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("decided_twice").alias("rule"), "game_id")
    unknown = decisions.join(games, "game_id", "left_semi").join(plan, ["game_id", "run_id"], "left_anti").select(F.lit("no_such_candidate").alias("rule"), "game_id")
    return missing.unionByName(extra).unionByName(twice).unionByName(unknown)


def identity_violations(games: DataFrame, plan: DataFrame) -> DataFrame:
    """Conflicts whose candidates differ in season or teams: no decision can settle those."""
    rows = games.join(plan.select("game_id", "run_id"), ["game_id", "run_id"], "left_semi")
    n = F.count_distinct("season", "home_team_id", "away_team_id")
    return rows.groupBy("game_id").agg(n.alias("n")).where("n > 1").select(F.lit("identity_differs").alias("rule"), "game_id")


def apply_decisions(versions: DataFrame, plan: DataFrame, decisions: DataFrame, token: str | None = None) -> DataFrame:
    """Versions without those that decisions ruled out: of a game in conflict only the chosen run's stays.

    Raises if a decision doesn't fit the plan, or if ``token`` isn't that of the versions any more.
    """
    if token is not None and token != review_token(versions):
        raise ValueError("the versions changed since the review")
    bad = decision_violations(plan, decisions).groupBy("rule").count().collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['count']}" for r in bad))
    chosen = decisions.select("game_id", F.col("run_id").alias("_chosen"))
    rows = versions.join(chosen, "game_id", "left")
    return rows.where(F.col("_chosen").isNull() | (F.col("run_id") == F.col("_chosen"))).drop("_chosen")


def version_diff(versions: DataFrame, runs: list[str] | None = None, columns: tuple[str, ...] = GAME) -> DataFrame:
    """(game_id, field, run_id, value) of the fields in which a game's versions differ; with ``runs``, a column a run."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns if c != "game_id"))
    long = versions.select("game_id", "run_id", F.explode(fields).alias("f")).select("game_id", "run_id", "f.*")
    w = Window.partitionBy("game_id", "field")
    known = F.coalesce("value", F.lit("\u0000"))
    out = long.withColumn("_a", F.min(known).over(w)).withColumn("_b", F.max(known).over(w)).where("_a <> _b").select("game_id", "field", "run_id", "value")
    return out.groupBy("game_id", "field").pivot("run_id", runs).agg(F.first("value")) if runs else out


def same_teams(stats: DataFrame, games: DataFrame) -> DataFrame:
    """Per completed game, whether the teams with statistics are the scheduled ones."""
    own = stats.groupBy("game_id").agg(F.array_sort(F.collect_set("team_id")).alias("_t"))
    rows = games.where("completed").join(own, "game_id", "left")
    return rows.select("game_id", F.coalesce(F.col("_t") == F.array_sort(F.array("home_team_id", "away_team_id")), F.lit(False)).alias("same"))


def reusable_boxes(archive: DataFrame, games: DataFrame) -> DataFrame:
    """(game_id, run_id): the newest archived box of each completed game whose points still are those of the schedule.

    ``archive``: run_id, captured_at, game_id, team_id, points.
    """
    boxes = archive.groupBy("game_id", "run_id", "captured_at").agg(F.sort_array(F.collect_list("points")).alias("_p"))
    now = games.where("completed").select("game_id", F.array_sort(F.array("home_score", "away_score")).alias("_q"))
    ok = boxes.join(now, "game_id").where(F.col("_p") == F.col("_q"))
    return ok.groupBy("game_id").agg(F.max_by("run_id", F.struct("captured_at", "run_id")).alias("run_id"))
