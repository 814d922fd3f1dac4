"""League tables derived from a star schema of orders: an order with lines of two or more suppliers is a game between them.

The definitions are SQL that Spark and DuckDB both read, so the same text feeds the engine and prefixes its oracle queries.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .store import shared_dir

TABLES = ("lineitem", "orders", "supplier", "nation", "region")
CUTOFF = "2001-06-01"

#: Name to SQL; a definition may use the tables and the definitions before it.
DEFINITIONS = {
    "sides": """SELECT l_orderkey AS game_id, l_suppkey AS team_id, CAST(SUM(l_quantity) AS BIGINT) AS points,
  CAST(SUM(FLOOR(l_extendedprice / 500)) AS BIGINT) AS passing_yards, CAST(SUM(FLOOR(l_quantity * 4)) AS BIGINT) AS rushing_yards,
  CAST(SUM(FLOOR(l_tax * 100 + 0.5)) AS BIGINT) % 4 AS turnovers FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "pairs": """SELECT game_id, CASE WHEN game_id % 2 = 0 THEN MIN(team_id) ELSE MAX(team_id) END AS home_team_id,
  CASE WHEN game_id % 2 = 0 THEN MAX(team_id) ELSE MIN(team_id) END AS away_team_id FROM sides GROUP BY game_id HAVING MIN(team_id) < MAX(team_id)""",
    "fixtures": """SELECT game_id, season, CASE WHEN w > 48 THEN w - 48 ELSE w END AS week, CASE WHEN w > 48 THEN 'postseason' ELSE 'regular' END AS season_type, game_date, home_team_id, away_team_id, neutral_site,
  game_date < TIMESTAMP '2001-06-01 00:00:00' AS completed FROM (SELECT p.game_id, CAST(YEAR(o.o_orderdate) AS INT) AS season, CAST(FLOOR((DAYOFYEAR(o.o_orderdate) - 1) / 7) + 1 AS INT) AS w,
  o.o_orderdate AS game_date, p.home_team_id, p.away_team_id, o.o_orderpriority = '1-URGENT' AS neutral_site FROM pairs p JOIN orders o ON o.o_orderkey = p.game_id) d""",
    "games": """SELECT f.game_id, f.season, f.week, f.game_date, f.home_team_id, f.away_team_id, CASE WHEN f.completed THEN h.points END AS home_score,
  CASE WHEN f.completed THEN a.points END AS away_score, f.neutral_site, f.completed, f.season_type
  FROM fixtures f JOIN sides h ON h.game_id = f.game_id AND h.team_id = f.home_team_id JOIN sides a ON a.game_id = f.game_id AND a.team_id = f.away_team_id""",
    "team_game_stats": """SELECT g.game_id, s.team_id, o.team_id AS opponent_id, s.team_id = g.home_team_id AS is_home, s.points, o.points AS points_allowed,
  s.passing_yards + s.rushing_yards AS total_yards, 50 + s.rushing_yards % 30 AS offensive_plays, s.passing_yards, s.rushing_yards, s.turnovers, o.turnovers AS takeaways,
  8 + s.points % 9 AS third_down_attempts, s.passing_yards % 8 AS third_down_conversions, s.points % 6 AS red_zone_attempts,
  LEAST(s.points % 6, s.passing_yards % 4) AS red_zone_touchdowns, s.rushing_yards % 11 AS penalties, 8 * (s.rushing_yards % 11) + s.passing_yards % 5 AS penalty_yards,
  1200 + s.passing_yards % 1200 AS time_of_possession_seconds
  FROM games g JOIN sides s ON s.game_id = g.game_id AND (s.team_id = g.home_team_id OR s.team_id = g.away_team_id)
  JOIN sides o ON o.game_id = g.game_id AND (o.team_id = g.home_team_id OR o.team_id = g.away_team_id) AND o.team_id <> s.team_id WHERE g.completed""",
    "teams": """SELECT s_suppkey AS team_id, s_name AS name, CASE WHEN s_nationkey % 7 = 3 THEN CAST(NULL AS STRING) ELSE r_name END AS conference
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "line_items": """SELECT l_orderkey AS game_id, CASE WHEN l_linenumber = 1 THEN 'consensus' WHEN l_linenumber = 2 THEN 'DraftKings' WHEN l_linenumber = 3 THEN 'Bovada' WHEN l_linenumber = 4 THEN 'ESPN Bet'
  WHEN l_linenumber = 5 THEN 'FanDuel' WHEN l_linenumber = 6 THEN 'Caesars' ELSE 'other' END AS provider,
  CASE WHEN l_linestatus = 'O' THEN CAST(NULL AS DOUBLE) ELSE FLOOR(l_discount * 100 + 0.5) - 5 END AS spread,
  CASE WHEN l_returnflag = 'R' THEN CAST(NULL AS DOUBLE) ELSE 40 + 2 * FLOOR(l_tax * 100 + 0.5) END AS over_under,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos FROM lineitem""",
    "advanced": """SELECT game_id, team_id AS team, CASE WHEN third_down_attempts = 0 THEN NULL ELSE CAST(third_down_conversions AS DOUBLE) / third_down_attempts END AS success_rate,
  CAST(points AS DOUBLE) / offensive_plays AS ppa, CAST(passing_yards AS DOUBLE) / (1 + total_yards) AS explosiveness, CAST(takeaways AS DOUBLE) / 12 AS havoc,
  CASE WHEN red_zone_attempts = 0 THEN NULL ELSE CAST(points AS DOUBLE) / red_zone_attempts END AS points_per_opportunity
  FROM team_game_stats WHERE NOT (game_id % 53 = 0 AND is_home)""",
    "snapshots": """SELECT 'run-a' AS run_id, TIMESTAMP '2001-07-01 00:00:00' AS captured_at, game_id, season, week, game_date, home_team_id, away_team_id,
  CASE WHEN game_id % 5 = 0 THEN NULL ELSE home_score END AS home_score, CASE WHEN game_id % 5 = 0 THEN NULL ELSE away_score END AS away_score, neutral_site, completed AND game_id % 5 <> 0 AS completed, season_type FROM games
  UNION ALL SELECT 'run-b', TIMESTAMP '2001-07-02 00:00:00', game_id, season, week, game_date, home_team_id, away_team_id, home_score, away_score, neutral_site, completed, season_type FROM games
  UNION ALL SELECT 'run-c', TIMESTAMP '2001-07-03 00:00:00', game_id, season, week, game_date, home_team_id, away_team_id, CASE WHEN game_id % 97 = 0 THEN home_score + 1 ELSE home_score END, away_score, neutral_site, completed, season_type FROM games""",
    "forecasts": """SELECT r.source_run, g.game_id, CASE WHEN g.game_id % 89 = 0 THEN g.away_team_id ELSE g.home_team_id END AS home_team_id,
  CASE WHEN g.game_id % 89 = 0 THEN g.home_team_id ELSE g.away_team_id END AS away_team_id, g.season, g.week, g.game_date AS saved_kickoff,
  CASE WHEN r.k = 1 THEN g.game_date - INTERVAL '3' DAY WHEN r.k = 2 THEN g.game_date - INTERVAL '1' DAY ELSE g.game_date + INTERVAL '1' DAY END AS created,
  CASE WHEN r.k = 1 THEN g.game_date - INTERVAL '4' DAY ELSE g.game_date - INTERVAL '2' DAY END AS as_of,
  CAST(20 + g.home_team_id % 13 + r.k AS DOUBLE) AS home_expected_points, CAST(21 + g.away_team_id % 11 AS DOUBLE) AS away_expected_points,
  CAST(g.home_team_id % 13 + r.k - 1 - g.away_team_id % 11 AS DOUBLE) AS projected_spread_home, CAST(41 + g.home_team_id % 13 + r.k + g.away_team_id % 11 AS DOUBLE) AS projected_total,
  CAST(5 + (g.home_team_id * 7 + g.away_team_id * 3 + r.k) % 90 AS DOUBLE) / 100 AS home_win_probability, g.game_id % 4 = 0 AS low_history, 'points' AS model
  FROM games g JOIN (SELECT 'run-1' AS source_run, 1 AS k UNION ALL SELECT 'run-2', 2 UNION ALL SELECT 'run-3', 3) r ON g.game_id % 3 <> r.k - 1""",
}


#: Tables that most others are built from: written once a session and folder.
SHARED = ("sides", "games", "team_game_stats")
_WRITTEN: dict[tuple[str, str, str], str] = {}


def needed(text: str, known: tuple[str, ...] = ()) -> list[str]:
    """Definitions that a SQL text uses, in order, without the ``known`` ones and what only they use."""
    found: set[str] = set()

    def walk(sql: str) -> None:
        for name in DEFINITIONS:
            if name not in found and name not in known and re.search(rf"\b{name}\b", sql):
                found.add(name)
                walk(DEFINITIONS[name])

    walk(text)
    return [n for n in DEFINITIONS if n in found]


def ctes(text: str, duckdb: bool = False, known: tuple[str, ...] = ()) -> list[str]:
    how = "AS MATERIALIZED" if duckdb else "AS"
    return [f"{n} {how} ({DEFINITIONS[n].replace(' AS STRING)', ' AS VARCHAR)') if duckdb else DEFINITIONS[n]})" for n in needed(text, known)]


_SCHEMAS: dict[tuple[str, str], object] = {}


def table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; its schema is inferred once a session."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        table(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the parquet tables of ``sf_dir``; the shared ones among its sources are written first."""
    views(spark, sf_dir)
    known: tuple[str, ...] = ()
    for shared in (n for n in needed(name) if n in SHARED):
        key = (spark.sparkContext.applicationId, sf_dir, shared)
        if key not in _WRITTEN:
            path = f"{shared_dir(spark)}/{shared}-{uuid.uuid4().hex}"
            _select(spark, shared, known).write.parquet(path)
            _WRITTEN[key] = path
        table(spark, _WRITTEN[key]).createOrReplaceTempView(shared)
        known = (*known, shared)
    return _select(spark, name, known)


def _select(spark: SparkSession, name: str, known: tuple[str, ...]) -> DataFrame:
    if name in known:
        return spark.table(name)
    return spark.sql("WITH " + ", ".join(ctes(name, known=known)) + f" SELECT * FROM {name}")
