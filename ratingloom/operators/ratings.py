"""Opponent-adjusted ratings of many rating units (a league season) in one job.

Offence and defence are solved by fifteen simultaneous rounds of recency-weighted means with a ridge of prior games; then they
are shrunk towards a prior that blends team and conference strength. Two strategies give the same numbers: if the largest unit
is small (its size is counted first), each unit is solved inside one grouped task; else edges are written once in buckets, and
every round brings the rating vectors to where they lie: by broadcast if these are small, else to a block of the unit's teams a task.
What an edge adds in every round alike is summed up per team beforehand; the lineage is cut each round.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import record_text, round_to, safe_divide, tier
from ..sources.store import cut, join_summary, shared_dir

#: Edges of a unit up to which one task solves it (56 bytes each, held about three times over: half a gigabyte at most).
GROUPED_EDGES = 3_000_000


@dataclass(frozen=True)
class Settings:
    home_advantage: float = 2.5
    decay: float = 0.94
    form_decay: float = 0.78
    prior_weight: float = 3.0
    conference_weight: float = 0.15
    rounds: int = 15
    penalty: float = 4.0
    default_std: float = 14.0
    least_std: float = 8.0
    unit: str = "season"


def season_totals(stats: DataFrame, games: DataFrame, unit: str = "season") -> DataFrame:
    """Per unit and team: record, per-play yards and rates, own and allowed (sums over sums, 0 without a denominator), per-game means."""
    rows = stats.join(games.where("completed").select("game_id", unit), "game_id")
    allowed = ("offensive_plays", "total_yards", "third_down_attempts", "third_down_conversions", "red_zone_attempts", "red_zone_touchdowns")
    both = rows.join(allowed_totals(stats, allowed), ["game_id", "team_id"], "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    ratio = lambda a, b: F.coalesce(safe_divide(total(a), total(b)), F.lit(0.0))
    return both.groupBy(unit, "team_id").agg(
        F.count("*").alias("games_played"),
        F.count_if(F.col("points") > F.col("points_allowed")).alias("wins"),
        F.count_if(F.col("points") < F.col("points_allowed")).alias("losses"),
        F.count_if(F.col("points") == F.col("points_allowed")).alias("ties"),
        ratio("total_yards", "offensive_plays").alias("yards_per_play"),
        ratio("opp_total_yards", "opp_offensive_plays").alias("yards_per_play_allowed"),
        ratio("passing_yards", "offensive_plays").alias("passing_yards_per_play"),
        ratio("rushing_yards", "offensive_plays").alias("rushing_yards_per_play"),
        ratio("third_down_conversions", "third_down_attempts").alias("third_down_rate"),
        ratio("opp_third_down_conversions", "opp_third_down_attempts").alias("third_down_rate_allowed"),
        ratio("red_zone_touchdowns", "red_zone_attempts").alias("red_zone_td_rate"),
        ratio("opp_red_zone_touchdowns", "opp_red_zone_attempts").alias("red_zone_td_rate_allowed"),
        F.avg("turnovers").alias("turnovers_pg"),
        F.avg("takeaways").alias("takeaways_pg"),
        F.avg(F.col("takeaways") - F.col("turnovers")).alias("turnover_margin_pg"),
        F.avg("penalties").alias("penalties_pg"),
        F.avg("penalty_yards").alias("penalty_yards_pg"),
        F.avg("time_of_possession_seconds").alias("time_of_possession_sec"),
    )


def edges(stats: DataFrame, games: DataFrame, s: Settings) -> DataFrame:
    """(unit, team, opponent, points, allowed, hfa, full hfa, weight, form weight, league mean) of every team-game that counts."""
    done = games.where("completed").select("game_id", F.col(s.unit).alias("unit"), "week", "neutral_site")
    side = F.when(F.col("neutral_site"), 0.0).when(F.col("is_home"), 1.0).otherwise(-1.0)
    rows = stats.join(done, "game_id")
    units = rows.groupBy("unit").agg(F.max("week").alias("_last"), F.avg("points").alias("league"))
    rows = join_summary(rows, units, "unit").withColumn("age", F.greatest(F.col("_last") - F.col("week"), F.lit(0)))
    return rows.select(
        "unit", "team_id", "opponent_id", F.col("points").cast("double").alias("pts"), F.col("points_allowed").cast("double").alias("allowed"),
        (side * s.home_advantage / 2).alias("hfa"), (side * s.home_advantage).alias("full"),
        F.pow(F.lit(s.decay), "age").alias("w"), F.pow(F.lit(s.form_decay), "age").alias("fw"), "league",
    )


def league_summary(games: DataFrame, stats: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(unit, league_points, margin_std): mean team points, and the margins' deviation with its floor and default."""
    done = games.where("completed")
    margin = F.stddev_samp(F.col("home_score") - F.col("away_score"))
    std = done.groupBy(F.col(s.unit).alias("unit")).agg(F.when(F.count("*") > 1, F.greatest(margin, F.lit(s.least_std))).otherwise(s.default_std).alias("margin_std"))
    points = stats.join(done.select("game_id", F.col(s.unit).alias("unit")), "game_id").groupBy("unit").agg(F.avg("points").alias("league_points"))
    return points.join(std, "unit")


def team_priors(teams: DataFrame, priors: DataFrame | None = None, talent: DataFrame | None = None) -> DataFrame:
    """(team_id, prior): an explicit prior, else a quarter of the talent score's distance from the mean score, else 0."""
    out = teams.select("team_id").distinct()
    given = F.lit(None).cast("double")
    if priors is not None:
        out = out.join(priors.select("team_id", F.col("prior").alias("_given")), "team_id", "left")
        given = F.col("_given")
    scored = F.lit(None).cast("double")
    if talent is not None:
        mean = talent.agg(F.avg("score").alias("_mean"))
        own = talent.crossJoin(F.broadcast(mean)).select("team_id", ((F.col("score") - F.col("_mean")) * 0.25).alias("_talent"))
        out = out.join(own, "team_id", "left")
        scored = F.col("_talent")
    return out.select("team_id", F.coalesce(given, scored, F.lit(0.0)).alias("prior"))


def _terms(e: DataFrame, *keys: str) -> DataFrame:
    """(keys, team, opponent, w, p, q, prior): an edge's weight, and what it adds to its team's offence and defence in every round alike."""
    w, hfa, league = F.col("w"), F.col("hfa"), F.col("league")
    return e.select(*keys, "team_id", "opponent_id", "w", (w * (F.col("pts") - (league + hfa))).alias("p"), (w * ((league - hfa) - F.col("allowed"))).alias("q"), "prior")


def _solve_unit(pdf: pd.DataFrame, s: Settings) -> pd.DataFrame:
    teams = np.unique(pdf["team_id"].to_numpy())
    t = np.searchsorted(teams, pdf["team_id"].to_numpy())
    o = np.searchsorted(teams, pdf["opponent_id"].to_numpy()).clip(max=len(teams) - 1)
    n = len(teams)
    w = pdf["w"].to_numpy()
    known = np.where(teams[o] == pdf["opponent_id"].to_numpy(), w, 0.0)
    weight = np.bincount(t, w, n) + s.penalty
    p, q = (np.bincount(t, pdf[c].to_numpy(), n) for c in ("p", "q"))
    off = np.zeros(n)
    off[t] = pdf["prior"].to_numpy() / 2
    de = off.copy()
    for _ in range(s.rounds):
        new_off = (p + np.bincount(t, known * de[o], n)) / weight
        new_de = (q + np.bincount(t, known * off[o], n)) / weight
        off, de = new_off - new_off.mean(), new_de - new_de.mean()
    return pd.DataFrame({"unit": pdf["unit"].iloc[0], "team_id": teams, "off": off, "de": de})


def _grouped(e: DataFrame, s: Settings) -> DataFrame:
    kind = dict(e.dtypes)
    return _terms(e, "unit").groupBy("unit").applyInPandas(lambda pdf: _solve_unit(pdf, s), f"unit {kind['unit']}, team_id {kind['team_id']}, off double, de double")


#: Rows of rating vectors up to which a round broadcasts them (about 80 bytes each), and buckets of the edges of large units.
VECTOR_ROWS, BUCKETS = 250_000, 200


@contextmanager
def bucketed(e: DataFrame, buckets: int | None = None, by: str = "team_id", keys: list[str] | None = None) -> Iterator[DataFrame]:
    """``e`` written in buckets of (unit, or other ``keys``, and ``by``), as a table while the block runs: sums per team, or joins of opponents, need no exchange."""
    spark = e.sparkSession
    name = f"edges_{uuid.uuid4().hex}"
    e.write.bucketBy(buckets or BUCKETS, *(keys or ["unit"]), by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def is_small(vector: DataFrame) -> bool:
    return vector.limit(VECTOR_ROWS + 1).count() <= VECTOR_ROWS


def beside_opponents(rows: DataFrame, vector: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with what ``vector`` has for their opponents: broadcast if ``is_small``, so that edges stay in place."""
    return rows.join(F.broadcast(vector) if few else vector, [*keys, "opponent_id"], "left")


def _vector(x: DataFrame, keys: list[str]) -> DataFrame:
    return x.select(*keys, F.col("team_id").alias("opponent_id"), F.col("off").alias("o_off"), F.col("de").alias("o_de"))


def round_sums(e: DataFrame, x: DataFrame, s: Settings, keys: list[str], few: bool) -> DataFrame:
    """One round before it is centred: every team's weighted means over its edges, given all teams' values."""
    rows = beside_opponents(e, _vector(x, keys), keys, few)
    d, f = F.coalesce("o_de", F.lit(0.0)), F.coalesce("o_off", F.lit(0.0))
    total = F.sum("w") + s.penalty
    return rows.groupBy(*keys, "team_id").agg(
        (F.sum(F.col("w") * (F.col("pts") - (F.col("league") + F.col("hfa")) + d)) / total).alias("off"),
        (F.sum(F.col("w") * ((F.col("league") - F.col("hfa")) - F.col("allowed") + f)) / total).alias("de"),
    )


def round_moves(e: DataFrame, fixed: DataFrame, x: DataFrame, keys: list[str]) -> DataFrame:
    """The same with the ``fixed`` sums of each team at hand: of an edge only its weight is read, and only sums for teams move."""
    rows = beside_opponents(e.select(*keys, "team_id", "opponent_id", "w"), _vector(x, keys), keys, False)
    moved = rows.groupBy(*keys, "team_id").agg(F.sum(F.col("w") * F.coalesce("o_de", F.lit(0.0))).alias("d"), F.sum(F.col("w") * F.coalesce("o_off", F.lit(0.0))).alias("f"))
    return moved.join(fixed, [*keys, "team_id"]).select(*keys, "team_id", ((F.col("p") + F.col("d")) / F.col("total")).alias("off"), ((F.col("q") + F.col("f")) / F.col("total")).alias("de"))


def by_rounds(e: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    """(keys, team, off, de) after the last round over ``e``, edges that lie where they were written: a round moves rating vectors, not edges."""
    if not is_small(e.select(*keys, "team_id").distinct()):
        size = e.groupBy(*keys).agg(F.count("*").alias("n"), F.approx_count_distinct("team_id").alias("teams")).agg(F.max("n"), F.max("teams")).first()
        if size[1] <= VECTOR_TEAMS:
            return by_blocks(_terms(e, *keys), s, keys, -(-size[0] // BLOCK_EDGES))
    sums = ((F.sum("w") + s.penalty).alias("total"), F.sum("p").alias("p"), F.sum("q").alias("q"), (F.first("prior") / 2).alias("prior"))
    fixed = cut(_terms(e, *keys).groupBy(*keys, "team_id").agg(*sums))
    few = is_small(fixed)  # a round's vector has the same rows
    x = fixed.select(*keys, "team_id", F.col("prior").alias("off"), F.col("prior").alias("de"))
    for _ in range(s.rounds):
        step = cut(round_sums(e, x, s, keys, True) if few else round_moves(e, fixed, x, keys))
        means = step.groupBy(*keys).agg(F.avg("off").alias("_off"), F.avg("de").alias("_de"))
        x = cut(join_summary(step, means, keys).select(*keys, "team_id", (F.col("off") - F.col("_off")).alias("off"), (F.col("de") - F.col("_de")).alias("de")))
    return x


#: Edges of a block of a unit's teams, which a task holds, and teams of a unit up to which it also holds all their ratings (24 bytes each).
BLOCK_EDGES, VECTOR_TEAMS = 1_500_000, 4_000_000


def by_blocks(terms: DataFrame, s: Settings, keys: list[str], blocks: int) -> DataFrame:
    """(keys, team, off, de) after the last round. A unit's teams are dealt to ``blocks``, and the edges of a block's teams are written where
    its task finds them in every round. The ratings of a block are one row of arrays, which is sent to every block of the unit: a round
    moves three numbers a team and block, and no sum for a team leaves its task."""
    kinds, by = dict(terms.dtypes), [*keys, "block"]
    arrays = ("off", "de", "total", "p", "q")
    kind = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "block int", f"ids array<{kinds['team_id']}>", *(f"{c} array<double>" for c in arrays)])
    columns = [*by, "ids", *arrays]

    def row(of: pd.DataFrame, *values) -> pd.DataFrame:
        return pd.DataFrame([[*of[by].iloc[0], *values]], columns=columns)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        teams, t = np.unique(pdf["team_id"].to_numpy(), return_inverse=True)
        w, p, q = (np.bincount(t, pdf[c].to_numpy(), len(teams)) for c in ("w", "p", "q"))
        prior = np.zeros(len(teams))
        prior[t] = pdf["prior"].to_numpy() / 2
        return row(pdf, teams, prior, prior, w + s.penalty, p, q)

    def step(centred: bool):
        def one(e: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if e.empty:  # a block without teams
                return pd.DataFrame(columns=columns)
            ids, off, de = (np.concatenate(x[c].tolist()) for c in ("ids", "off", "de"))
            off, de = (off - off.mean(), de - de.mean()) if centred else (off, de)
            order = np.argsort(ids, kind="stable")
            ids, off, de = ids[order], off[order], de[order]
            rival = e["opponent_id"].to_numpy()
            o = np.searchsorted(ids, rival).clip(max=len(ids) - 1)
            known = np.where(ids[o] == rival, e["w"].to_numpy(), 0.0)
            mine = x[x["source"] == x["block"]].iloc[0]
            t, n = np.searchsorted(mine["ids"], e["team_id"].to_numpy()), len(mine["ids"])
            new_off, new_de = ((mine[c] + np.bincount(t, known * v[o], n)) / mine["total"] for c, v in (("p", de), ("q", off)))
            return row(e, mine["ids"], new_off, new_de, mine["total"], mine["p"], mine["q"])

        return one

    dealt = terms.withColumn("block", F.pmod(F.xxhash64("team_id"), F.lit(blocks)).cast("int"))
    with bucketed(dealt.repartition(BUCKETS, *by), by="block", keys=keys) as kept:
        x = cut(kept.groupBy(*by).applyInPandas(first, kind))
        edges_ = kept.select(*by, "team_id", "opponent_id", "w")
        for n in range(s.rounds):
            own = [F.when(F.col("source") == F.col("block"), F.col(c)).alias(c) for c in ("total", "p", "q")]
            sent = x.withColumnRenamed("block", "source").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            sent = sent.select(*by, "source", "ids", "off", "de", *own)
            x = cut(edges_.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(step(n > 0), kind))
    team = F.explode(F.arrays_zip("ids", "off", "de")).alias("v")
    each = x.select(*keys, team).select(*keys, F.col("v.ids").alias("team_id"), "v.off", "v.de")
    if not s.rounds:
        return each
    means = each.groupBy(*keys).agg(F.avg("off").alias("_off"), F.avg("de").alias("_de"))
    return join_summary(each, means, keys).select(*keys, "team_id", (F.col("off") - F.col("_off")).alias("off"), (F.col("de") - F.col("_de")).alias("de"))


def _by_rounds(e: DataFrame, s: Settings) -> DataFrame:
    if not is_small(e.select("unit", "team_id").distinct()):
        return by_rounds(e, s, ["unit"])
    needed = ("unit", "team_id", "opponent_id", "w", "hfa", "league", "pts", "allowed", "prior")
    with bucketed(e.select(*needed)) as kept:
        return by_rounds(kept, s, ["unit"])


def raw_ratings(e: DataFrame, s: Settings, strategy: str = "auto") -> DataFrame:
    """(unit, team_id, off, de) after the last round."""
    if strategy == "auto":
        largest = e.groupBy("unit").count().agg(F.max("count")).first()[0] or 0
        strategy = "grouped" if largest <= GROUPED_EDGES else "rounds"
    return _grouped(e, s) if strategy == "grouped" else _by_rounds(e, s)


def _fit(games: DataFrame, stats: DataFrame, teams: DataFrame, priors: DataFrame | None, talent: DataFrame | None, s: Settings, strategy: str, cutoff: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(games and statistics that count, edges, ratings): the last two written."""
    if cutoff is not None:
        games = games.where(F.col("game_date") < F.lit(cutoff).cast("timestamp"))
    stats = stats.join(games.where("completed").select("game_id"), "game_id", "left_semi")
    e = edges(stats, games, s)
    if priors is None and talent is None:
        e = e.withColumn("prior", F.lit(0.0))
    else:
        e = e.join(team_priors(stats.select("team_id"), priors, talent), "team_id")
    e = cut(e)  # read by the solver, the counts and the schedule strengths
    solved = raw_ratings(e, s, strategy)
    counts = e.groupBy("unit", "team_id").agg(F.count("*").alias("n"), F.first("prior").alias("prior"))
    info = teams.select("team_id", F.col("name").alias("team_name"), F.coalesce("conference", F.lit("FBS")).alias("conference"))
    base = solved.join(counts, ["unit", "team_id"]).join(info, "team_id", "left").withColumn("conference", F.coalesce("conference", F.lit("FBS")))
    base = cut(base)
    per_conf = base.groupBy("unit", "conference").agg(F.avg(F.col("off") + F.col("de")).alias("conf_mean"))
    base = join_summary(base.join(per_conf, ["unit", "conference"]), per_conf.groupBy("unit").agg(F.count("*").alias("confs")), "unit")
    blend = F.when((F.col("confs") > 1) & F.lit(s.conference_weight > 0), (1 - s.conference_weight) * F.col("prior") + s.conference_weight * F.col("conf_mean")).otherwise(F.col("prior"))
    shrunk = lambda c: (F.col("n") * F.col(c) + s.prior_weight * F.col("blend") / 2) / (F.col("n") + s.prior_weight)
    final = cut(
        base.withColumn("blend", blend)
        .withColumns({"offensive_rating": shrunk("off"), "defensive_rating": shrunk("de")})
        .select("unit", "team_id", "team_name", "conference", F.col("prior").alias("prior_rating"), "offensive_rating", "defensive_rating", (F.col("offensive_rating") + F.col("defensive_rating")).alias("power_rating"))
    )
    return games, stats, e, final


def fit_power(games: DataFrame, stats: DataFrame, teams: DataFrame, priors: DataFrame | None = None, talent: DataFrame | None = None, s: Settings = Settings(), strategy: str = "auto", cutoff: str | None = None) -> DataFrame:
    """The ratings of ``fit_ratings`` alone, without the rest of a profile: what projections need."""
    return _fit(games, stats, teams, priors, talent, s, strategy, cutoff)[3]


def fit_ratings(games: DataFrame, stats: DataFrame, teams: DataFrame, advanced: DataFrame | None = None, priors: DataFrame | None = None,
                talent: DataFrame | None = None, s: Settings = Settings(), strategy: str = "auto", cutoff: str | None = None) -> DataFrame:
    """Rating profiles, a row per unit and team. ``teams`` has team_id, name, conference; a missing conference is 'FBS'.

    ``cutoff`` leaves out games from that time on (by default all completed games count).
    """
    games, stats, e, final = _fit(games, stats, teams, priors, talent, s, strategy, cutoff)
    other = final.select("unit", F.col("team_id").alias("opponent_id"), F.col("power_rating").alias("o_power"))
    schedule = e.join(other, ["unit", "opponent_id"], "left").withColumn("o_power", F.coalesce("o_power", F.lit(0.0)))
    form = F.try_divide(F.sum(F.col("fw") * (F.col("pts") - F.col("allowed") - F.col("full") + F.col("o_power"))), F.sum("fw"))
    strength = schedule.groupBy("unit", "team_id").agg(F.avg("o_power").alias("strength_of_schedule"), form.alias("recent_form_rating"))
    totals = season_totals(stats, games, s.unit).withColumnRenamed(s.unit, "unit")
    out = final.join(strength, ["unit", "team_id"]).join(totals, ["unit", "team_id"])
    out = with_advanced(out, advanced)
    ranked = Window.partitionBy("unit").orderBy(F.desc("power_rating"), "team_id")
    return out.withColumns({"rank": F.row_number().over(ranked), "tier": tier("power_rating")})


ADVANCED = ("success_rate", "success_rate_allowed", "ppa_per_play", "ppa_per_play_allowed", "explosiveness", "havoc_rate", "points_per_opportunity")


def with_advanced(profiles: DataFrame, advanced: DataFrame | None) -> DataFrame:
    """``profiles`` with the advanced metrics of their teams, 0 where there are none.

    ``advanced`` has a row a team, and ``team`` is its id (a number or text) or its name; an id goes before a name.
    """
    if advanced is None:
        return profiles.withColumns({c: F.lit(0.0) for c in ADVANCED})
    own = advanced.select(F.col("team").cast("string").alias("_key"), F.struct(*(c for c in ADVANCED if c in advanced.columns)).alias("_adv"))
    out = profiles.join(own.select("_key", F.col("_adv").alias("_by_id")), F.col("team_id").cast("string") == F.col("_key"), "left").drop("_key")
    out = out.join(own.select("_key", F.col("_adv").alias("_by_name")), F.col("team_name") == F.col("_key"), "left").drop("_key")
    found = F.coalesce("_by_id", "_by_name")
    return out.withColumns({c: F.coalesce(found[c], F.lit(0.0)) if c in advanced.columns else F.lit(0.0) for c in ADVANCED}).drop("_by_id", "_by_name")


def allowed_totals(stats: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(game_id, team_id, and each column as the opponent made it, ``opp_``) of every team-game."""
    return stats.select("game_id", F.col("opponent_id").alias("team_id"), *(F.col(c).alias(f"opp_{c}") for c in columns))


def advanced_season_metrics(rows: DataFrame) -> DataFrame:
    """Per team: means of the advanced metrics, own and (from games with exactly two rows) the opponent's; 0 if none."""
    pairs = rows.groupBy("game_id").agg(F.count("*").alias("n")).where("n = 2").select("game_id")
    other = rows.join(pairs, "game_id", "left_semi").select("game_id", F.col("team").alias("other"), *(F.col(c).alias(f"opp_{c}") for c in ("success_rate", "ppa")))
    joined = rows.join(other, (rows["game_id"] == other["game_id"]) & (rows["team"] != other["other"]), "left").drop(other["game_id"])
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return joined.groupBy("team").agg(
        mean("success_rate").alias("success_rate"), mean("opp_success_rate").alias("success_rate_allowed"), mean("ppa").alias("ppa_per_play"),
        mean("opp_ppa").alias("ppa_per_play_allowed"), mean("explosiveness").alias("explosiveness"), mean("havoc").alias("havoc_rate"),
        mean("points_per_opportunity").alias("points_per_opportunity"),
    )


def conference_table(ratings: DataFrame) -> DataFrame:
    """Per unit and conference: teams, mean and median rating, mean offence and defence, best team, and the conference's rank."""
    known = ratings.where(F.col("conference").isNotNull() & (F.col("conference") != "Unknown"))
    best = F.struct(F.col("power_rating"), (-F.col("team_id")).alias("k"))
    out = known.groupBy("unit", "conference").agg(
        F.count("*").alias("teams"), F.avg("power_rating").alias("mean_rating"), F.median("power_rating").alias("median_rating"),
        F.avg("offensive_rating").alias("mean_offense"), F.avg("defensive_rating").alias("mean_defense"),
        F.max_by("team_name", best).alias("top_team"), F.max("power_rating").alias("top_rating"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("mean_rating"), "conference")))


def filter_rankings(ratings: DataFrame, unit=None, conference: str | None = None, tiers: list[str] | None = None, name: str | None = None) -> DataFrame:
    out = ratings
    if unit is not None:
        out = out.where(F.col("unit") == unit)
    if conference is not None:
        out = out.where(F.lower("conference") == conference.lower())
    if tiers:
        out = out.where(F.col("tier").isin(tiers))
    if name:
        out = out.where(F.contains(F.lower("team_name"), F.lit(name.lower())))
    return out


def top_rankings(ratings: DataFrame, unit, n: int = 25) -> DataFrame:
    return ratings.where(F.col("unit") == unit).orderBy("rank").limit(n)


def leaders(ratings: DataFrame) -> DataFrame:
    """Per unit: best overall, offence and defence, and hardest schedule; ties go to the smaller id."""
    by = lambda c: F.max_by("team_id", F.struct(F.col(c), (-F.col("team_id")).alias("k")))
    return ratings.groupBy("unit").agg(
        by("power_rating").alias("best_overall"), by("offensive_rating").alias("best_offense"),
        by("defensive_rating").alias("best_defense"), by("strength_of_schedule").alias("hardest_schedule"),
    )


def export_profile(ratings: DataFrame) -> DataFrame:
    """The profile as published: rounded fields, the record as text and possession in minutes."""
    two = ("power_rating", "offensive_rating", "defensive_rating", "strength_of_schedule", "recent_form_rating", "yards_per_play", "yards_per_play_allowed", "passing_yards_per_play", "rushing_yards_per_play", "turnover_margin_pg")
    three = ("third_down_rate", "third_down_rate_allowed", "red_zone_td_rate", "red_zone_td_rate_allowed", "success_rate", "success_rate_allowed", "havoc_rate")
    one = ("penalties_pg", "penalty_yards_pg")
    return ratings.select(
        "unit", "rank", "team_id", F.coalesce("team_name", F.col("team_id").cast("string")).alias("team"), "conference", "tier", record_text("wins", "losses", "ties").alias("record"),
        *(round_to(c, d).alias(c) for names, d in ((two, 2), (three, 3), (one, 1)) for c in names), round_to(F.col("time_of_possession_sec") / 60, 1).alias("possession_minutes"),
    )
