"""Column functions: rates, clips, rounding and the normal distribution function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the polynomial approximation 7.1.26 of erf in Abramowitz and Stegun (error below 1.5e-7); the engine has no erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null (``least`` and ``greatest`` would drop it)."""
    c = col(x)
    inner = c
    inner = F.greatest(inner, F.lit(low)) if low is not None else inner
    inner = F.least(inner, F.lit(high)) if high is not None else inner
    return F.when(c.isNotNull(), inner)


def round_to(x: str | Column, digits: int = 1) -> Column:
    """Half-up rounding that SQL engines share: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + F.lit(0.5)) / scale


def normal_cdf(z: str | Column) -> Column:
    """Standard normal distribution function."""
    x = F.abs(col(z)) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERF_P * x)
    poly = reduce(lambda acc, a: (acc + a) * t, reversed(ERF_A), F.lit(0.0))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(col(z) >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def mean_of(*columns: str | Column) -> Column:
    """Mean of those that aren't null; null if all are."""
    cs = [col(c).cast("double") for c in columns]
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cs))
    return F.try_divide(reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cs)), n)


def rate_metrics() -> dict[str, Column]:
    """The five rates of a team's game."""
    return {
        "yards_per_play": safe_divide("total_yards", "offensive_plays"),
        "passing_yards_per_play": safe_divide("passing_yards", "offensive_plays"),
        "rushing_yards_per_play": safe_divide("rushing_yards", "offensive_plays"),
        "third_down_rate": safe_divide("third_down_conversions", "third_down_attempts"),
        "red_zone_td_rate": safe_divide("red_zone_touchdowns", "red_zone_attempts"),
    }


def pick_label(spread: str | Column, home: str | Column, away: str | Column) -> Column:
    """Favoured side, or pick'em within 0.2 points."""
    s = col(spread)
    return F.when(F.abs(s) < 0.2, "Even / Pick'em").when(s > 0, col(home)).otherwise(col(away))


def tier(rating: str | Column) -> Column:
    r = col(rating)
    return (
        F.when(r >= 14, "Tier 1: Elite").when(r >= 7, "Tier 2: Contender").when(r >= 1, "Tier 3: Above Average")
        .when(r >= -5, "Tier 4: Average").when(r >= -12, "Tier 5: Below Average").otherwise("Tier 6: Rebuilding")
    )


def confidence(probability: str | Column) -> Column:
    """Of rating projections: distance of the win probability from one half, doubled."""
    d = F.abs(col(probability) - 0.5) * 2
    return F.when(d >= 0.35, "High").when(d >= 0.15, "Medium").otherwise("Low")


def model_confidence(probability: str | Column) -> Column:
    """Of score models: right-closed cuts at .16 and .34."""
    d = F.abs(col(probability) - 0.5) * 2
    return F.when(d <= 0.16, "Low").when(d <= 0.34, "Medium").otherwise("High")


def record_text(wins: str, losses: str, ties: str) -> Column:
    """W-L, or W-L-T if there are ties."""
    base = F.concat_ws("-", F.col(wins).cast("string"), F.col(losses).cast("string"))
    return F.when(F.col(ties) > 0, F.concat_ws("-", base, F.col(ties).cast("string"))).otherwise(base)


def period_label(columns: list[str], season: str = "season", week: str = "week") -> Column:
    """Season, season type (regular, where a table of these columns has none) and week."""
    kind = F.coalesce("season_type", F.lit("regular")) if "season_type" in columns else F.lit("regular")
    return F.concat_ws(" ", F.col(season).cast("string"), kind, F.lit("week"), F.col(week).cast("string"))


def kickoff_text(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm 'UTC'")


def parse_kickoff(text: str | Column) -> Column:
    """The inverse of ``kickoff_text``; null for other text."""
    return F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd HH:mm 'UTC'"))


def zoned_timestamp(text: str | Column) -> Column:
    """Timestamp of an ISO text with a time zone; null without one."""
    t = col(text)
    return F.when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))


def neutralise(text: str | Column) -> Column:
    """Text that a spreadsheet would take for a formula, quoted."""
    t = col(text)
    return F.when(t.rlike(r"^[=+@-]"), F.concat(F.lit("'"), t)).otherwise(t)


def snake_case(text: str) -> str:
    """camelCase to snake_case."""
    import re

    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text).lower()


#: Digits with which forecasts are shown: points and edges one, probabilities three.
SHOWN = {"home_win_probability": 3} | {
    c: 1
    for c in (
        "home_expected_points", "away_expected_points", "projected_spread_home", "projected_total", "home_score_low", "home_score_high",
        "away_score_low", "away_score_high", "market_spread", "market_total", "spread_edge", "total_edge",
    )
}


def presented(df):
    """A forecast table with its numbers rounded for display; other columns stay."""
    return df.withColumns({c: round_to(c, d) for c, d in SHOWN.items() if c in df.columns})
