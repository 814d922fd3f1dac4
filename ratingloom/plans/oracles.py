"""SQL of the registered queries for a second engine: chains of common table expressions over the derived league tables."""

from __future__ import annotations

import re

from ..functions import ERF_A, ERF_P
from ..operators.market import PROVIDERS
from ..operators.project import TAPE
from ..schema import ROLLING, WINDOWS
from ..sources.adapters import DEFINITIONS, ctes, needed

ROUNDS = 15


def phi(z: str) -> str:
    t = f"(1.0 / (1.0 + {ERF_P} * (abs({z}) / sqrt(2.0))))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})) * {t})"
    erf = f"(1.0 - {poly} * exp(-(({z}) * ({z})) / 2.0))"
    return f"(CASE WHEN ({z}) >= 0 THEN 0.5 * (1.0 + {erf}) ELSE 0.5 * (1.0 - {erf}) END)"


def r1(x: str, digits: int = 1) -> str:
    s = f"1{'0' * digits}.0"
    return f"(floor(CAST({x} AS DOUBLE) * {s} + CAST(0.5 AS DOUBLE)) / {s})"


def clip(x: str, low=None, high=None) -> str:
    inner = x if low is None else f"greatest({x}, {low})"
    inner = inner if high is None else f"least({inner}, {high})"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {inner} END)"


def mean_of(a: str, b: str) -> str:
    return f"((coalesce({a}, 0) + coalesce({b}, 0)) / NULLIF(CAST(({a}) IS NOT NULL AS INT) + CAST(({b}) IS NOT NULL AS INT), 0))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


FRAMES = {"l3": "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING", "l5": "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING", "season": "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"}
RATES = {
    "yards_per_play": div("total_yards", "offensive_plays"), "passing_yards_per_play": div("passing_yards", "offensive_plays"), "rushing_yards_per_play": div("rushing_yards", "offensive_plays"),
    "third_down_rate": div("third_down_conversions", "third_down_attempts"), "red_zone_td_rate": div("red_zone_touchdowns", "red_zone_attempts"),
}
FEATURES = [f"{m}_{w}" for m in ROLLING for w in WINDOWS]


def sums(a: str, b: str) -> str:
    return f"coalesce({div(f'SUM(coalesce({a}, 0))', f'SUM(coalesce({b}, 0))')}, 0.0)"


EXTRA: dict[str, str] = {
    "rates": "SELECT *, " + ", ".join(f"{x} AS {n}" for n, x in RATES.items()) + " FROM team_game_stats",
    "feats": "SELECT r.*, g.season, g.week, g.game_date, "
    + ", ".join(f"AVG(CAST(r.{m} AS DOUBLE)) OVER (PARTITION BY r.team_id, g.season ORDER BY g.game_date, r.game_id {f}) AS {m}_{n}" for m in ROLLING for n, f in FRAMES.items())
    + ", ROW_NUMBER() OVER (PARTITION BY r.team_id, g.season ORDER BY g.game_date, r.game_id) - 1 AS prior_games FROM rates r JOIN games g ON g.game_id = r.game_id",
    "matchups": "SELECT g.*, CASE WHEN g.neutral_site THEN 0 ELSE 1 END AS home_field_indicator, coalesce(h.prior_games, 0) AS home_prior_games, coalesce(a.prior_games, 0) AS away_prior_games, "
    + ", ".join(f"{s}.{f} AS {n}_{f}" for s, n in (("h", "home"), ("a", "away")) for f in FEATURES)
    + " FROM games g LEFT JOIN feats h ON h.game_id = g.game_id AND h.team_id = g.home_team_id LEFT JOIN feats a ON a.game_id = g.game_id AND a.team_id = g.away_team_id",
    "totals": f"""SELECT g.season AS unit, s.team_id, COUNT(*) AS games_played, SUM(CASE WHEN s.points > s.points_allowed THEN 1 ELSE 0 END) AS wins, SUM(CASE WHEN s.points < s.points_allowed THEN 1 ELSE 0 END) AS losses,
  SUM(CASE WHEN s.points = s.points_allowed THEN 1 ELSE 0 END) AS ties, {sums("s.total_yards", "s.offensive_plays")} AS yards_per_play, {sums("o.total_yards", "o.offensive_plays")} AS yards_per_play_allowed,
  {sums("s.passing_yards", "s.offensive_plays")} AS passing_yards_per_play, {sums("s.rushing_yards", "s.offensive_plays")} AS rushing_yards_per_play, {sums("s.third_down_conversions", "s.third_down_attempts")} AS third_down_rate,
  {sums("o.third_down_conversions", "o.third_down_attempts")} AS third_down_rate_allowed, {sums("s.red_zone_touchdowns", "s.red_zone_attempts")} AS red_zone_td_rate, {sums("o.red_zone_touchdowns", "o.red_zone_attempts")} AS red_zone_td_rate_allowed,
  AVG(s.turnovers) AS turnovers_pg, AVG(s.takeaways) AS takeaways_pg, AVG(s.takeaways - s.turnovers) AS turnover_margin_pg, AVG(s.penalties) AS penalties_pg, AVG(s.penalty_yards) AS penalty_yards_pg,
  AVG(s.time_of_possession_seconds) AS time_of_possession_sec FROM team_game_stats s JOIN games g ON g.game_id = s.game_id LEFT JOIN team_game_stats o ON o.game_id = s.game_id AND o.opponent_id = s.team_id GROUP BY g.season, s.team_id""",
    "adv": """SELECT a.team, coalesce(AVG(a.success_rate), 0.0) AS success_rate, coalesce(AVG(o.success_rate), 0.0) AS success_rate_allowed, coalesce(AVG(a.ppa), 0.0) AS ppa_per_play, coalesce(AVG(o.ppa), 0.0) AS ppa_per_play_allowed,
  coalesce(AVG(a.explosiveness), 0.0) AS explosiveness, coalesce(AVG(a.havoc), 0.0) AS havoc_rate, coalesce(AVG(a.points_per_opportunity), 0.0) AS points_per_opportunity
  FROM advanced a LEFT JOIN (SELECT game_id FROM advanced GROUP BY game_id HAVING COUNT(*) = 2) p ON p.game_id = a.game_id LEFT JOIN advanced o ON o.game_id = p.game_id AND o.team <> a.team GROUP BY a.team""",
    "league": """SELECT p.unit, p.league_points, s.margin_std FROM (SELECT g.season AS unit, AVG(s.points) AS league_points FROM team_game_stats s JOIN games g ON g.game_id = s.game_id GROUP BY g.season) p
  JOIN (SELECT season AS unit, CASE WHEN COUNT(*) > 1 THEN greatest(stddev_samp(home_score - away_score), 8.0) ELSE 14.0 END AS margin_std FROM games WHERE completed GROUP BY season) s ON s.unit = p.unit""",
    "e": """SELECT *, AVG(pts) OVER (PARTITION BY unit) AS league, pow(CAST(0.94 AS DOUBLE), age) AS w, pow(CAST(0.78 AS DOUBLE), age) AS fw FROM (SELECT g.season AS unit, s.team_id, s.opponent_id, CAST(s.points AS DOUBLE) AS pts, CAST(s.points_allowed AS DOUBLE) AS allowed,
  CASE WHEN g.neutral_site THEN 0.0 WHEN s.is_home THEN 1.25 ELSE -1.25 END AS hfa, CASE WHEN g.neutral_site THEN 0.0 WHEN s.is_home THEN 2.5 ELSE -2.5 END AS full_hfa, MAX(g.week) OVER (PARTITION BY g.season) - g.week AS age
  FROM team_game_stats s JOIN games g ON g.game_id = s.game_id) t""",
    "x0": "SELECT DISTINCT unit, team_id, CAST(0 AS DOUBLE) AS o, CAST(0 AS DOUBLE) AS d FROM e",
    **{
        f"x{k + 1}": f"""SELECT unit, team_id, o - AVG(o) OVER (PARTITION BY unit) AS o, d - AVG(d) OVER (PARTITION BY unit) AS d FROM (SELECT e.unit, e.team_id, SUM(w * (pts - (league + hfa) + coalesce(x.d, 0))) / (SUM(w) + 4) AS o,
  SUM(w * ((league - hfa) - allowed + coalesce(x.o, 0))) / (SUM(w) + 4) AS d FROM e LEFT JOIN x{k} x ON x.unit = e.unit AND x.team_id = e.opponent_id GROUP BY e.unit, e.team_id) t"""
        for k in range(ROUNDS)
    },
    "based": f"""SELECT x.unit, x.team_id, t.name AS team_name, coalesce(t.conference, 'FBS') AS conference, x.o, x.d, n.n, AVG(x.o + x.d) OVER (PARTITION BY x.unit, coalesce(t.conference, 'FBS')) AS cm,
  c.confs FROM x{ROUNDS} x JOIN (SELECT unit, team_id, COUNT(*) AS n FROM e GROUP BY unit, team_id) n ON n.unit = x.unit AND n.team_id = x.team_id LEFT JOIN teams t ON t.team_id = x.team_id
  JOIN (SELECT y.unit, COUNT(DISTINCT coalesce(u.conference, 'FBS')) AS confs FROM x{ROUNDS} y LEFT JOIN teams u ON u.team_id = y.team_id GROUP BY y.unit) c ON c.unit = x.unit""",
    "finals": """SELECT *, offensive_rating + defensive_rating AS power_rating FROM (SELECT unit, team_id, team_name, conference, CAST(0 AS DOUBLE) AS prior_rating, (n * o + 1.5 * b) / (n + 3.0) AS offensive_rating, (n * d + 1.5 * b) / (n + 3.0) AS defensive_rating
  FROM (SELECT *, CASE WHEN confs > 1 THEN CAST(0.15 AS DOUBLE) * cm ELSE 0 END AS b FROM based) t) u""",
    "sos": """SELECT e.unit, e.team_id, AVG(coalesce(f.power_rating, 0)) AS strength_of_schedule, SUM(e.fw * (e.pts - e.allowed - e.full_hfa + coalesce(f.power_rating, 0))) / SUM(e.fw) AS recent_form_rating
  FROM e LEFT JOIN finals f ON f.unit = e.unit AND f.team_id = e.opponent_id GROUP BY e.unit, e.team_id""",
    "rated": """SELECT f.*, s.strength_of_schedule, s.recent_form_rating, t.games_played, t.wins, t.losses, t.ties, t.yards_per_play, t.yards_per_play_allowed, t.passing_yards_per_play, t.rushing_yards_per_play, t.third_down_rate, t.third_down_rate_allowed,
  t.red_zone_td_rate, t.red_zone_td_rate_allowed, t.turnover_margin_pg, t.penalty_yards_pg, coalesce(a.success_rate, 0) AS success_rate, coalesce(a.success_rate_allowed, 0) AS success_rate_allowed, coalesce(a.ppa_per_play, 0) AS ppa_per_play,
  coalesce(a.explosiveness, 0) AS explosiveness, coalesce(a.havoc_rate, 0) AS havoc_rate, ROW_NUMBER() OVER (PARTITION BY f.unit ORDER BY f.power_rating DESC, f.team_id) AS rank,
  CASE WHEN power_rating >= 14 THEN 'Tier 1: Elite' WHEN power_rating >= 7 THEN 'Tier 2: Contender' WHEN power_rating >= 1 THEN 'Tier 3: Above Average' WHEN power_rating >= -5 THEN 'Tier 4: Average' WHEN power_rating >= -12 THEN 'Tier 5: Below Average' ELSE 'Tier 6: Rebuilding' END AS tier
  FROM finals f JOIN sos s ON s.unit = f.unit AND s.team_id = f.team_id JOIN totals t ON t.unit = f.unit AND t.team_id = f.team_id LEFT JOIN adv a ON a.team = f.team_id""",
    "slate": "SELECT game_id, season AS unit, home_team_id, away_team_id, neutral_site, game_date FROM games WHERE NOT completed",
}

#: What a projection keeps of both profiles.
NUMBERS = ("rank", "power_rating", "offensive_rating", "defensive_rating", "strength_of_schedule", "recent_form_rating", "wins", "yards_per_play", "yards_per_play_allowed", "passing_yards_per_play", "rushing_yards_per_play",
           "third_down_rate", "third_down_rate_allowed", "red_zone_td_rate", "red_zone_td_rate_allowed", "turnover_margin_pg", "penalty_yards_pg", "success_rate", "success_rate_allowed", "ppa_per_play", "explosiveness", "havoc_rate")


def projection(source: str) -> str:
    """SQL of projected fixtures of ``source`` (game_id, unit, home_team_id, away_team_id, neutral_site)."""
    sides = ", ".join(f"{s}.team_name AS {p}_team_name, " + ", ".join(f"coalesce({s}.{c}, 0) AS {p}_{c}" for c in NUMBERS) for s, p in (("h", "a"), ("v", "b")))
    base = f"SELECT s.*, l.league_points, l.margin_std, {sides} FROM {source} s JOIN league l ON l.unit = s.unit LEFT JOIN rated h ON h.unit = s.unit AND h.team_id = s.home_team_id LEFT JOIN rated v ON v.unit = s.unit AND v.team_id = s.away_team_id"
    points = lambda own, other, sign: f"greatest({r1(f'league_points + {own}_offensive_rating - {other}_defensive_rating {sign} (CASE WHEN neutral_site THEN 0.0 ELSE 1.25 END)')}, 3.0)"
    first = f"SELECT *, {points('a', 'b', '+')} AS home_expected_points, {points('b', 'a', '-')} AS away_expected_points FROM ({base}) t"
    second = f"SELECT *, {r1('home_expected_points - away_expected_points')} AS projected_spread_home, {r1('home_expected_points + away_expected_points')} AS projected_total FROM ({first}) t"
    third = f"SELECT *, {clip(phi('projected_spread_home / margin_std'), 0.01, 0.99)} AS home_win_probability FROM ({second}) t"
    bands = ", ".join(f"greatest({s}_expected_points - margin_std / sqrt(2.0), 0.0) AS {s}_score_low, {s}_expected_points + margin_std / sqrt(2.0) AS {s}_score_high" for s in ("home", "away"))
    conf = "CASE WHEN abs(home_win_probability - 0.5) * 2 >= 0.35 THEN 'High' WHEN abs(home_win_probability - 0.5) * 2 >= 0.15 THEN 'Medium' ELSE 'Low' END AS confidence_tier"
    favored = "CASE WHEN abs(projected_spread_home) < 0.2 THEN 'Even / Pick''em' WHEN projected_spread_home > 0 THEN a_team_name ELSE b_team_name END AS favored"
    return f"SELECT *, {bands}, {conf}, {favored} FROM ({third}) t"


def edges_sql() -> str:
    parts = []

    def add(name: str, side: str, when: str, own: str, other: str) -> None:
        parts.append(f"SELECT game_id, '{name}' AS edge, '{side}' AS side, CAST({own} AS DOUBLE) AS own, CAST({other} AS DOUBLE) AS other FROM p WHERE {when}")

    for s, o in ("ab", "ba"):
        add("overall_rating", s, f"{s}_power_rating > {o}_power_rating + 5", f"{s}_power_rating", f"{o}_power_rating")
        add("offensive_efficiency", s, f"{s}_yards_per_play - {o}_yards_per_play_allowed > CAST(0.6 AS DOUBLE)", f"{s}_yards_per_play", f"{o}_yards_per_play_allowed")
        add("third_down", s, f"{s}_third_down_rate > {o}_third_down_rate_allowed + CAST(0.08 AS DOUBLE)", f"{s}_third_down_rate", f"{o}_third_down_rate_allowed")
        add("turnover_margin", s, f"{s}_turnover_margin_pg - {o}_turnover_margin_pg >= CAST(0.7 AS DOUBLE)", f"{s}_turnover_margin_pg", f"{o}_turnover_margin_pg")
    known = "a_success_rate > 0 AND b_success_rate_allowed > 0"
    better = lambda s, o: f"{s}_success_rate > {o}_success_rate_allowed + CAST(0.04 AS DOUBLE)"
    add("success_rate", "a", f"{known} AND {better('a', 'b')}", "a_success_rate", "b_success_rate_allowed")
    add("success_rate", "b", f"{known} AND {better('b', 'a')} AND NOT ({better('a', 'b')})", "b_success_rate", "a_success_rate_allowed")
    for s, o in ("ab", "ba"):
        add("havoc", s, f"{s}_havoc_rate >= CAST(0.15 AS DOUBLE) AND {s}_havoc_rate > {o}_havoc_rate + CAST(0.03 AS DOUBLE)", f"{s}_havoc_rate", f"{o}_havoc_rate")
    return " UNION ALL ".join(parts)


def tape_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT game_id, '{m}' AS metric, CAST(a_{m} AS DOUBLE) AS a, CAST(b_{m} AS DOUBLE) AS b, CASE WHEN a_{m} {'<' if less else '>'} b_{m} THEN 'a' ELSE 'b' END AS better_side FROM p" for m, less in TAPE
    )


EXTRA |= {
    "p": projection("slate"),
    "lines": f"""SELECT game_id, provider, spread AS market_spread, over_under AS market_total FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY CASE {' '.join(f"WHEN lower(provider) = '{p.lower()}' THEN {i}" for i, p in enumerate(PROVIDERS))} ELSE {len(PROVIDERS)} END, pos) AS k
  FROM line_items WHERE spread IS NOT NULL OR over_under IS NOT NULL) t WHERE k = 1""",
    "hist": """SELECT u.game_id, s.side, COUNT(d.p) AS n, AVG(d.p) AS scored, AVG(d.q) AS allowed FROM slate u CROSS JOIN (SELECT 'home' AS side UNION ALL SELECT 'away') s
  LEFT JOIN (SELECT season, game_date, home_team_id AS team_id, CAST(home_score AS DOUBLE) AS p, CAST(away_score AS DOUBLE) AS q FROM games WHERE completed UNION ALL SELECT season, game_date, away_team_id, away_score, home_score FROM games WHERE completed) d
  ON d.team_id = CASE WHEN s.side = 'home' THEN u.home_team_id ELSE u.away_team_id END AND d.season = u.unit AND d.game_date < u.game_date GROUP BY u.game_id, s.side""",
    "lm": "SELECT AVG(home_score) AS league_home, AVG(away_score) AS league_away, greatest(stddev_samp(home_score - away_score), 1.0) AS scale FROM games WHERE completed",
    "rolling": f"""SELECT *, home_expected_points - away_expected_points AS projected_spread_home, home_expected_points + away_expected_points AS projected_total, {phi("(home_expected_points - away_expected_points) / scale")} AS home_win_probability
  FROM (SELECT u.*, h.n AS home_games_played, a.n AS away_games_played, lm.scale, coalesce({mean_of("h.scored", "a.allowed")}, lm.league_home) AS home_expected_points, coalesce({mean_of("a.scored", "h.allowed")}, lm.league_away) AS away_expected_points
  FROM slate u JOIN hist h ON h.game_id = u.game_id AND h.side = 'home' JOIN hist a ON a.game_id = u.game_id AND a.side = 'away' CROSS JOIN lm) t""",
    "ratedup": "SELECT r.game_id, r.home_games_played, r.away_games_played, "
    + ", ".join(f"CASE WHEN r.home_games_played > 0 OR r.away_games_played > 0 THEN p.{c} ELSE r.{c} END AS {c}" for c in ("home_expected_points", "away_expected_points", "projected_spread_home", "projected_total", "home_win_probability"))
    + ", CASE WHEN r.home_games_played > 0 OR r.away_games_played > 0 THEN p.confidence_tier ELSE 'Low' END AS confidence_tier, CASE WHEN r.home_games_played > 0 OR r.away_games_played > 0 THEN 'ratings' ELSE 'rolling' END AS model FROM rolling r JOIN p ON p.game_id = r.game_id",
    "edged": f"""SELECT *, CASE WHEN s >= 3.5 OR t >= 4.0 THEN 'Strong Value' WHEN s >= 2.0 OR t >= 2.5 THEN 'Moderate Value' ELSE 'Fair / Aligned' END AS value_tier FROM (SELECT *, coalesce(abs(spread_edge), 0) AS s, coalesce(abs(total_edge), 0) AS t
  FROM (SELECT *, {r1("market_spread - model_home_spread")} AS spread_edge, {r1("model_total - market_total")} AS total_edge FROM (SELECT f.source_run, f.game_id, f.home_team_id, f.away_team_id, l.market_spread, l.market_total, {r1("f.away_expected_points - f.home_expected_points")} AS model_home_spread,
  {r1("f.home_expected_points + f.away_expected_points")} AS model_total FROM forecasts f LEFT JOIN lines l ON l.game_id = f.game_id) a) b) c""",
    "graded": """SELECT d.*, CASE WHEN market_spread IS NOT NULL AND abs(spread_edge) >= 0.5 THEN CASE WHEN abs(cover) < CAST(0.1 AS DOUBLE) THEN 'push' WHEN (cover > 0) = (spread_edge > 0) THEN 'win' ELSE 'loss' END END AS ats,
  CASE WHEN market_total IS NOT NULL AND abs(total_edge) >= 1.0 THEN CASE WHEN abs(ov) < CAST(0.1 AS DOUBLE) THEN 'push' WHEN (ov > 0) = (total_edge > 0) THEN 'win' ELSE 'loss' END END AS ou
  FROM (SELECT f.*, g.season, g.home_score - g.away_score + market_spread AS cover, g.home_score + g.away_score - market_total AS ov FROM edged f JOIN games g ON g.game_id = f.game_id WHERE g.completed) d""",
    "periods": """SELECT m.*, o.period, o.ord FROM matchups m JOIN (SELECT season, week, season_type, period, ROW_NUMBER() OVER (ORDER BY first, period) AS ord FROM (SELECT season, week, season_type, concat(CAST(season AS VARCHAR), ' ', season_type, ' week ', CAST(week AS VARCHAR)) AS period, MIN(game_date) AS first
  FROM games WHERE completed GROUP BY season, week, season_type) t) o ON o.season = m.season AND o.week = m.week AND o.season_type = m.season_type WHERE m.completed""",
    "train": """SELECT t.ord, COUNT(*) AS train_games, AVG(b.home_score) AS train_home, AVG(b.away_score) AS train_away, greatest(stddev_samp(b.home_score - b.away_score), 1.0) AS scale,
  greatest(least(AVG(CASE WHEN b.home_score > b.away_score THEN 1.0 ELSE 0.0 END), 0.999), 0.001) AS home_rate, coalesce(AVG(CASE WHEN NOT b.neutral_site THEN b.home_score - b.away_score END), 0.0) AS home_edge
  FROM (SELECT DISTINCT ord FROM periods) t JOIN periods b ON b.ord < t.ord GROUP BY t.ord HAVING COUNT(*) >= 20""",
    "target": "SELECT p.*, t.train_games, t.train_home, t.train_away, t.scale, t.home_rate, t.home_edge, (t.train_home + t.train_away) / 2 AS lg FROM periods p JOIN train t ON t.ord = p.ord WHERE p.ord > 2",
}


def _shrunk(k: float, term: bool) -> tuple[str, str]:
    mean = lambda s, w: f"coalesce((coalesce({s}_{w}_season, lg) * {s}_prior_games + lg * {k}) / NULLIF({s}_prior_games + {k}, 0), lg)"
    shift = "(CASE WHEN neutral_site THEN 0.0 ELSE home_edge / 2 END)" if term else "0.0"
    return f"(({mean('home', 'points')} + {mean('away', 'points_allowed')}) / 2 + {shift})", f"(({mean('away', 'points')} + {mean('home', 'points_allowed')}) / 2 - {shift})"


MODELS = {
    "train_mean": ("train_home", "train_away", "home_rate"),
    "rolling_average": (f"coalesce({mean_of('home_points_season', 'away_points_allowed_season')}, train_home)", f"coalesce({mean_of('away_points_season', 'home_points_allowed_season')}, train_away)", None),
    "shrunk_k2": (*_shrunk(2.0, False), None), "shrunk_k5": (*_shrunk(5.0, False), None), "shrunk_k5_home": (*_shrunk(5.0, True), None),
}
EXTRA["predicted"] = " UNION ALL ".join(
    f"SELECT game_id, period, ord, home_score, away_score, '{n}' AS model, hp AS home_points, ap AS away_points, {prob or phi('(hp - ap) / scale')} AS home_win_probability FROM (SELECT *, {h} AS hp, {a} AS ap FROM target) t" for n, (h, a, prob) in MODELS.items()
)
METRICS = """COUNT(*) AS games, (AVG(abs(home_points - home_score)) + AVG(abs(away_points - away_score))) / 2 AS score_mae, sqrt((AVG(pow(home_points - home_score, 2)) + AVG(pow(away_points - away_score, 2))) / 2) AS score_rmse,
  AVG(abs(home_points - away_points - (home_score - away_score))) AS spread_mae, AVG(abs(home_points + away_points - home_score - away_score)) AS total_mae,
  AVG(pow(greatest(least(home_win_probability, 0.999), 0.001) - CASE WHEN home_score > away_score THEN 1 ELSE 0 END, 2)) AS brier_score, AVG(CASE WHEN (home_points > away_points) = (home_score > away_score) THEN 1.0 ELSE 0.0 END) AS winner_accuracy"""
EXTRA |= {
    "overall": f"SELECT model, {METRICS} FROM predicted GROUP BY model",
    "finals_in": "SELECT game_id, home_team_id, away_team_id, CASE WHEN game_id % 83 = 0 THEN NULL ELSE game_date END AS kickoff, completed, home_score, away_score FROM games",
    "cands": """SELECT f.*, r.kickoff, CASE WHEN f.home_team_id <> r.home_team_id OR f.away_team_id <> r.away_team_id THEN 'team_identity_mismatch' WHEN r.kickoff IS NULL THEN 'unconfirmed_kickoff'
  WHEN greatest(f.created, f.as_of) >= least(r.kickoff, f.saved_kickoff) THEN 'not_created_and_asof_before_both_kickoffs' END AS reason FROM forecasts f JOIN finals_in r ON r.game_id = f.game_id""",
    "latest": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY created DESC, source_run DESC) AS k FROM cands WHERE reason IS NULL) t WHERE k = 1",
    "report": """SELECT *, CASE WHEN brier IS NOT NULL AND predicted_winner <> 'no_pick' THEN predicted_winner = actual_winner END AS winner_correct FROM (SELECT *, CASE WHEN sc THEN am END AS actual_margin_home, CASE WHEN sc THEN hs + vs END AS actual_total,
  CASE WHEN projected_spread_home > 0 THEN 'home' WHEN projected_spread_home < 0 THEN 'away' WHEN projected_spread_home IS NOT NULL THEN 'no_pick' END AS predicted_winner, CASE WHEN sc THEN CASE WHEN am > 0 THEN 'home' WHEN am < 0 THEN 'away' ELSE 'tie' END END AS actual_winner,
  CASE WHEN sc THEN abs(home_expected_points - hs) END AS home_absolute_error, CASE WHEN sc THEN abs(away_expected_points - vs) END AS away_absolute_error, CASE WHEN sc THEN abs(projected_spread_home - am) END AS margin_absolute_error,
  CASE WHEN sc THEN abs(projected_total - hs - vs) END AS total_absolute_error, CASE WHEN sc AND am <> 0 THEN pow(home_win_probability - CASE WHEN am > 0 THEN 1 ELSE 0 END, 2) END AS brier
  FROM (SELECT r.game_id, r.home_team_id, r.away_team_id, r.completed AND r.kickoff IS NOT NULL AND l.source_run IS NOT NULL AS sc, CASE WHEN l.source_run IS NOT NULL AND r.completed AND r.kickoff IS NOT NULL THEN 'scored' WHEN r.kickoff IS NULL THEN 'unconfirmed_kickoff' WHEN l.source_run IS NULL THEN 'no_eligible_prediction' ELSE 'result_pending' END AS status,
  CASE WHEN r.completed THEN r.home_score END AS hs, CASE WHEN r.completed THEN r.away_score END AS vs, r.home_score - r.away_score AS am, l.home_expected_points, l.away_expected_points, l.projected_spread_home, l.projected_total, l.home_win_probability, l.low_history, l.model, l.source_run
  FROM finals_in r LEFT JOIN latest l ON l.game_id = r.game_id) a) b""",
    "week_games": "SELECT * FROM games WHERE season = 2000 AND week = 20 AND completed",
    "week_first": """SELECT * FROM (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY f.game_id ORDER BY f.source_run DESC) AS k FROM forecasts f JOIN week_games g ON g.game_id = f.game_id JOIN (SELECT source_run FROM (SELECT source_run, coalesce(MAX(CASE WHEN hits >= n * 0.7 THEN 1 ELSE 0 END) OVER (ORDER BY source_run DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM (SELECT f.source_run, COUNT(*) AS hits, (SELECT COUNT(*) FROM week_games) AS n FROM forecasts f JOIN week_games g ON g.game_id = f.game_id GROUP BY f.source_run) a) b WHERE done = 0) u ON u.source_run = f.source_run) t WHERE k = 1""",
    "weekly": """SELECT COUNT(*) AS games_in_scope, COUNT(f.game_id) AS scored, AVG(CASE WHEN f.game_id IS NOT NULL THEN CASE WHEN (f.projected_spread_home > 0) = (g.home_score > g.away_score) AND g.home_score <> g.away_score THEN 1.0 ELSE 0.0 END END) AS winner_accuracy,
  AVG(abs(f.projected_spread_home - (g.home_score - g.away_score))) AS margin_mae, AVG(abs(f.projected_total - (g.home_score + g.away_score))) AS total_mae, AVG(pow(f.home_win_probability - CASE WHEN g.home_score > g.away_score THEN 1 ELSE 0 END, 2)) AS brier_score,
  AVG(g.home_score - g.away_score - f.projected_spread_home) AS margin_bias FROM week_games g LEFT JOIN week_first f ON f.game_id = g.game_id""",
    "vstate": """SELECT game_id, CASE WHEN MAX(CASE WHEN completed THEN 1 ELSE 0 END) = 1 THEN COUNT(DISTINCT CASE WHEN completed THEN rec END) ELSE COUNT(DISTINCT rec) END AS records, MAX(CASE WHEN completed THEN 1 ELSE 0 END) = 1 AS fin
  FROM (SELECT *, concat_ws('|', season, week, game_date, home_team_id, away_team_id, coalesce(home_score, -1), coalesce(away_score, -1), neutral_site, completed) AS rec FROM snapshots) t GROUP BY game_id""",
}


SMALL = ("home_points_season", "away_points_season", "home_points_allowed_season", "away_points_allowed_season", "home_yards_per_play_season", "away_yards_per_play_season", "home_field_indicator")


def ridge(name: str, sets: str, train: str, on: str, target: str, alpha: float, indicators: bool, scaled: bool) -> dict[str, str]:
    """Definitions of ridge forecasts by normal equations and elimination: ``sets`` (ord) are the training sets, ``train`` the games,
    ``on`` what puts a game p into a set t, and ``target`` (with ord) the games to predict. The last is ``<name>_out``."""
    x = [f"CAST(p.{f} AS DOUBLE)" for f in SMALL]
    z = [f"coalesce({c}, t.md{i}, 0.0)" for i, c in enumerate(x)] + ([f"(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)" for c in x] if indicators else [])
    d, k = len(z), range(len(z))
    pairs = [(i, j) for i in k for j in k if i <= j]
    out = {f"{name}_md": f"SELECT t.ord, COUNT(*) AS n, {', '.join(f'median({c}) AS md{i}' for i, c in enumerate(x))} FROM ({sets}) t JOIN ({train}) p ON {on} GROUP BY t.ord HAVING COUNT(*) >= 20"}
    sums = [f"SUM({z[i]} * {z[j]}) AS g{i}_{j}" for i, j in pairs] + [f"SUM({z[i]}) AS s{i}, SUM({z[i]} * p.home_score) AS h{i}, SUM({z[i]} * p.away_score) AS a{i}" for i in k]
    out[f"{name}_sums"] = f"SELECT t.ord, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(p.home_score) AS DOUBLE) AS sh, CAST(SUM(p.away_score) AS DOUBLE) AS sa, {', '.join(sums)} FROM {name}_md t JOIN ({train}) p ON {on} GROUP BY t.ord"
    scale = lambda i: f"nullif(sqrt(greatest((g{i}_{i} - s{i} * s{i} / n) / n, 0)), 0)" if scaled else "1.0"
    cells = [f"({i}, {j}, coalesce((g{min(i, j)}_{max(i, j)} - s{i} * s{j} / n) / {scale(i)} / {scale(j)}, 0){f' + {alpha}' if i == j else ''})" for i in k for j in k]
    cells += [f"({i}, {d + c}, coalesce(({y}{i} - s{i} * s{y} / n) / {scale(i)}, 0))" for i in k for c, y in enumerate("ha")]
    out[f"{name}_m0"] = " UNION ALL ".join(f"SELECT ord, {r} AS r, {c} AS c, CAST({v} AS DOUBLE) AS v FROM {name}_sums" for r, c, v in (cell[1:-1].split(", ", 2) for cell in cells))
    for step in k:
        m = f"{name}_m{step}"
        out[f"{name}_m{step + 1}"] = f"""SELECT a.ord, a.r, a.c, CASE WHEN a.r = {step} THEN a.v / p.v ELSE a.v - f.v * q.v / p.v END AS v FROM {m} a JOIN {m} p ON p.ord = a.ord AND p.r = {step} AND p.c = {step}
  JOIN {m} q ON q.ord = a.ord AND q.r = {step} AND q.c = a.c JOIN {m} f ON f.ord = a.ord AND f.r = a.r AND f.c = {step}"""
    weights = ", ".join(f"MAX(CASE WHEN m.r = {i} AND m.c = {d + c} THEN m.v END) / coalesce(MAX({scale(i)}), 1.0) AS w{y}{i}" for i in k for c, y in enumerate("ha"))
    out[f"{name}_w"] = f"SELECT u.*, t.* EXCLUDE (ord, n) FROM (SELECT s.ord, MAX(s.n) AS n, {', '.join(f'MAX(s.s{i} / s.n) AS mean{i}' for i in k)}, MAX(sh / s.n) AS mh, MAX(sa / s.n) AS ma, {weights} FROM {name}_sums s JOIN {name}_m{d} m ON m.ord = s.ord GROUP BY s.ord) u JOIN {name}_md t ON t.ord = u.ord"
    value = lambda y: f"t.m{y} + " + " + ".join(f"t.w{y}{i} * ({z[i]} - t.mean{i})" for i in k)
    out[f"{name}_std"] = f"SELECT t.ord, greatest(stddev_samp((p.home_score - p.away_score) - (({value('h')}) - ({value('a')}))), 1.0) AS std FROM {name}_w t JOIN ({train}) p ON {on} GROUP BY t.ord"
    points = f"SELECT p.*, s.std, {clip('(' + value('h') + ')', 0.0, 70.0)} AS hp, {clip('(' + value('a') + ')', 0.0, 70.0)} AS ap FROM ({target}) p JOIN {name}_w t ON t.ord = p.ord JOIN {name}_std s ON s.ord = p.ord"
    out[f"{name}_out"] = f"SELECT *, {phi('(hp - ap) / std')} AS prob FROM ({points}) r"
    return out


def as_of_ratings(prefix: str, dates: str, unit: str) -> dict[str, str]:
    """Definitions of ratings at many dates: the chain of rounds with (unit, date) as the unit. ``dates`` is SQL of (unit, as_of),
    ``unit`` the unit of a game g. The last is ``<prefix>rated``."""
    out = {
        f"{prefix}e": f"""SELECT *, AVG(pts) OVER (PARTITION BY unit) AS league, pow(CAST(0.94 AS DOUBLE), age) AS w, pow(CAST(0.78 AS DOUBLE), age) AS fw FROM (SELECT concat(d.unit, '@', d.as_of) AS unit, d.unit AS of_unit, d.as_of, s.team_id, s.opponent_id,
  CAST(s.points AS DOUBLE) AS pts, CAST(s.points_allowed AS DOUBLE) AS allowed, CASE WHEN g.neutral_site THEN 0.0 WHEN s.is_home THEN 1.25 ELSE -1.25 END AS hfa, CASE WHEN g.neutral_site THEN 0.0 WHEN s.is_home THEN 2.5 ELSE -2.5 END AS full_hfa,
  MAX(g.week) OVER (PARTITION BY d.unit, d.as_of) - g.week AS age FROM team_game_stats s JOIN games g ON g.game_id = s.game_id JOIN ({dates}) d ON d.unit = {unit} AND g.game_date < d.as_of WHERE g.completed) t"""
    }
    for name in ("x0", *(f"x{k + 1}" for k in range(ROUNDS)), "based", "finals", "sos"):
        text = re.sub(r"\b(FROM|JOIN) (x\d+|based|finals|sos)\b", rf"\1 {prefix}\2", EXTRA[name])
        out[prefix + name] = re.sub(r"\b(FROM|JOIN) e\b", rf"\1 {prefix}e AS e", text)
    out[f"{prefix}rated"] = f"""SELECT k.of_unit, k.as_of, f.*, s.strength_of_schedule, s.recent_form_rating, k.games, k.wins, ROW_NUMBER() OVER (PARTITION BY f.unit ORDER BY round(f.power_rating, 9) DESC, f.team_id) AS rank
  FROM {prefix}finals f JOIN {prefix}sos s ON s.unit = f.unit AND s.team_id = f.team_id
  JOIN (SELECT unit, of_unit, as_of, team_id, COUNT(*) AS games, SUM(CASE WHEN pts > allowed THEN 1 ELSE 0 END) AS wins FROM {prefix}e GROUP BY ALL) k ON k.unit = f.unit AND k.team_id = f.team_id"""
    return out


WEEK_STARTS = "SELECT DISTINCT w.season AS unit, w.as_of FROM (SELECT season, season_type, week, MIN(game_date) AS as_of FROM games GROUP BY season, season_type, week) w JOIN (SELECT season, MIN(game_date) AS first FROM games WHERE completed GROUP BY season) f ON f.season = w.season AND w.as_of > f.first"
#: Leagues of the queries over several leagues, and three dates for each season of a league.
LEAGUE = "concat('L', CAST(g.game_id % 3 AS VARCHAR), ' ', CAST(g.season AS VARCHAR))"
LEAGUE_DATES = f"SELECT DISTINCT {LEAGUE} AS unit, CAST(concat(CAST(g.season AS VARCHAR), m.at) AS TIMESTAMP) AS as_of FROM games g CROSS JOIN (SELECT '-03-01 00:00:00' AS at UNION ALL SELECT '-07-15 00:00:00' UNION ALL SELECT '-12-20 00:00:00') m"
EXTRA |= as_of_ratings("weekly_", WEEK_STARTS, "g.season") | as_of_ratings("leagues_", LEAGUE_DATES, LEAGUE)

def whole_ridge(name: str, train: str, target: str, alpha: float, indicators: bool, scaled: bool) -> dict[str, str]:
    """Definitions of one ridge forecast with all features: values in long form, the normal equations by recursion over pivots. The last is ``<name>_out``."""
    names = [f"{s}_{f}" for s in ("home", "away") for f in FEATURES] + ["home_field_indicator"]
    size = len(names)
    values = "[" + ", ".join(f"CAST({n} AS DOUBLE)" for n in names) + "]"
    long = lambda source: f"SELECT game_id, unnest({values}) AS x, unnest(range(1, {size + 1})) AS i FROM ({source}) s"
    filled = lambda z: f"SELECT z.game_id, z.i, coalesce(z.x, m.md, 0.0) AS v FROM {z} z JOIN {name}_md m ON m.i = z.i" + (f" UNION ALL SELECT game_id, i + {size}, CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END FROM {z}" if indicators else "")
    y = f"SELECT game_id, CAST(home_score AS DOUBLE) AS h, CAST(away_score AS DOUBLE) AS a FROM ({train}) s"
    out = {
        f"{name}_z": long(train), f"{name}_md": f"SELECT i, median(x) AS md FROM {name}_z GROUP BY i", f"{name}_v": filled(f"{name}_z"),
        f"{name}_mean": f"SELECT i, AVG(v) AS mean, {'stddev_pop(v)' if scaled else '1.0'} AS scale FROM {name}_v GROUP BY i HAVING stddev_pop(v) > 0",
        f"{name}_y": y, f"{name}_my": f"SELECT AVG(h) AS mh, AVG(a) AS ma FROM {name}_y",
        f"{name}_c": f"SELECT v.game_id, v.i, (v.v - m.mean) / m.scale AS v FROM {name}_v v JOIN {name}_mean m ON m.i = v.i",
        f"{name}_g": f"SELECT a.i AS r, b.i AS c, SUM(a.v * b.v) + CASE WHEN a.i = b.i THEN {alpha} ELSE 0.0 END AS v FROM {name}_c a JOIN {name}_c b ON b.game_id = a.game_id AND b.i >= a.i GROUP BY a.i, b.i",
        f"{name}_m": f"""SELECT r, c, v FROM {name}_g UNION ALL SELECT c, r, v FROM {name}_g WHERE r <> c UNION ALL SELECT c.i, 1001, SUM(c.v * (y.h - m.mh)) FROM {name}_c c JOIN {name}_y y ON y.game_id = c.game_id CROSS JOIN {name}_my m GROUP BY c.i
  UNION ALL SELECT c.i, 1002, SUM(c.v * (y.a - m.ma)) FROM {name}_c c JOIN {name}_y y ON y.game_id = c.game_id CROSS JOIN {name}_my m GROUP BY c.i""",
        f"{name}_s": f"""WITH RECURSIVE step AS (SELECT CAST(0 AS BIGINT) AS k, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, v FROM {name}_m UNION ALL SELECT k + 1, r, c, CASE WHEN r = k + 1 THEN v / p ELSE v - f * q / p END
  FROM (SELECT *, coalesce(MAX(CASE WHEN r = k + 1 AND c = k + 1 THEN v END) OVER (), 1.0) AS p, coalesce(MAX(CASE WHEN c = k + 1 THEN v END) OVER (PARTITION BY r), 0.0) AS f, coalesce(MAX(CASE WHEN r = k + 1 THEN v END) OVER (PARTITION BY c), 0.0) AS q FROM step WHERE k < {2 * size}) t)
  SELECT r AS i, MAX(CASE WHEN c = 1001 THEN v END) AS wh, MAX(CASE WHEN c = 1002 THEN v END) AS wa FROM step WHERE k = {2 * size} GROUP BY r""",
    }
    points = lambda v: f"SELECT v.game_id, MAX(m.mh) + SUM(s.wh * (v.v - e.mean) / e.scale) AS h, MAX(m.ma) + SUM(s.wa * (v.v - e.mean) / e.scale) AS a FROM {v} v JOIN {name}_mean e ON e.i = v.i JOIN {name}_s s ON s.i = v.i CROSS JOIN {name}_my m GROUP BY v.game_id"
    out |= {
        f"{name}_std": f"SELECT greatest(stddev_samp((y.h - y.a) - (f.h - f.a)), 1.0) AS std FROM ({points(name + '_v')}) f JOIN {name}_y y ON y.game_id = f.game_id",
        f"{name}_tz": long(target), f"{name}_tv": filled(f"{name}_tz"),
        f"{name}_out": f"SELECT *, {phi('(hp - ap) / std')} AS prob FROM (SELECT f.game_id, {clip('f.h', 0.0, 70.0)} AS hp, {clip('f.a', 0.0, 70.0)} AS ap, s.std FROM ({points(name + '_tv')}) f CROSS JOIN {name}_std s) r",
    }
    return out


_WALK = ("SELECT DISTINCT ord FROM periods WHERE ord > 2", "SELECT * FROM periods", "p.ord < t.ord", "SELECT * FROM target", 10.0, False, True)
_ONCE = ("SELECT 0 AS ord", "SELECT * FROM matchups WHERE completed AND season < 2001", "true", "SELECT *, 0 AS ord FROM matchups")
EXTRA |= whole_ridge("plain_all", _ONCE[1], "SELECT * FROM matchups", 12.0, True, False) | whole_ridge("scaled_all", _ONCE[1], "SELECT * FROM matchups", 10.0, False, True)
EXTRA |= ridge("walked", *_WALK) | ridge("plain_small", *_ONCE, 12.0, True, False) | ridge("scaled_small", *_ONCE, 10.0, False, True)


def _extra_needed(sql: str) -> list[str]:
    found: set[str] = set()

    def walk(text: str) -> None:
        for n in EXTRA:
            if n not in found and re.search(rf"(FROM|JOIN) {n}\b", text):
                found.add(n)
                walk(EXTRA[n])

    walk(sql)
    return [n for n in EXTRA if n in found]


def sql(body: str, spec: str) -> str:
    """A query with all that it builds on, its columns shaped by ``spec``."""
    extra = _extra_needed(body)
    everything = " ".join([body, *(EXTRA[n] for n in extra)])
    parts = ctes(everything, duckdb=True) + [f"{n} AS MATERIALIZED ({EXTRA[n]})" for n in _ordered(extra)]
    inner = body.replace(" AS STRING)", " AS VARCHAR)")
    columns = ", ".join(_column(c) for c in spec.split())
    head = f"WITH {', '.join(parts)} " if parts else ""
    return f"{head}SELECT {columns} FROM ({inner}) q"


def _ordered(names: list[str]) -> list[str]:
    """Definitions in an order in which each comes after those it uses."""
    out: list[str] = []

    def put(n: str) -> None:
        for m in _extra_needed(EXTRA[n]):
            if m != n and m not in out:
                put(m)
        if n not in out:
            out.append(n)

    for n in names:
        put(n)
    return out


def _column(c: str) -> str:
    if c.endswith("#"):
        return f"CAST({c[:-1]} AS BIGINT) AS {c[:-1]}"
    if c[-1] in "~^":
        return f"round(CAST({c[:-1]} AS DOUBLE), {6 if c[-1] == '~' else 3}) + 0.0 AS {c[:-1]}"
    return c


__all__ = ["DEFINITIONS", "needed", "sql"]
