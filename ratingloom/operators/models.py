"""Score models by expanding windows: baselines, shrunk expectations and ridge regressions, and their registry.

A period (season, type, week) is predicted from all earlier periods. Baselines and shrunk means need only running sums per period,
so one job covers all periods. So does a ridge: the sums of products of values and of missing marks are additive, and imputation by
a median, scaling and the normal equations need no more than these (``ExpandingRidge``). ``fit_ridge`` is one fit by Spark ML.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, mean_of, model_confidence, normal_cdf, period_label, round_to
from ..sources.store import cut, join_summary
from .features import model_features
from .scans import expanding_medians, running_totals

MIN_TRAINING = 20


#: Whose periods a game's period is counted among: the league, or nothing where all games are of one.
LEAGUE = "_league"


def with_periods(matchups: DataFrame, league: str | None = None) -> DataFrame:
    """Completed matchups with ``period`` (label of season, type and week) and ``ord``, the period's place by earliest kickoff, ties by
    label, among those of its league where a column names leagues."""
    key = F.coalesce(F.col(league).cast("string"), F.lit("")) if league else F.lit("")
    done = matchups.where("completed").withColumns({"period": period_label(matchups.columns), LEAGUE: key})
    first = done.groupBy(LEAGUE, "period").agg(F.min("game_date").alias("_first"))
    order = first.withColumn("ord", F.row_number().over(Window.partitionBy(LEAGUE).orderBy("_first", "period")))  # a row a period: small by nature
    return join_summary(done, order.drop("_first"), [LEAGUE, "period"])


def training_summary(periods: DataFrame) -> DataFrame:
    """Per period, over all earlier ones of its league: games, mean scores, home margin of non-neutral games, margin deviation and home win share.

    The range join of each period with its predecessors is a running sum over per-period sums.
    """
    m = F.col("home_score") - F.col("away_score")
    open_ = ~F.col("neutral_site")
    per = periods.groupBy(LEAGUE, "ord").agg(
        F.first("period").alias("period"), F.count("*").alias("n"), F.sum("home_score").alias("h"), F.sum("away_score").alias("a"), F.sum(m).alias("m"), F.sum(m * m).alias("mm"),
        F.count_if(m > 0).alias("w"), F.coalesce(F.sum(F.when(open_, m)), F.lit(0)).alias("om"), F.count_if(open_).alias("on"),
    )
    before = Window.partitionBy(LEAGUE).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    run = per.select(LEAGUE, "ord", "period", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "h", "a", "m", "mm", "w", "om", "on")))
    n = F.col("n").cast("double")
    var = F.try_divide(F.col("mm") - F.col("m") * F.col("m") / n, n - 1)
    return run.where(F.col("n") > 1).select(
        LEAGUE, "ord", "period", F.col("n").alias("train_games"), (F.col("h") / n).alias("train_home"), (F.col("a") / n).alias("train_away"),
        F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(1.0)).alias("scale"), clip(F.col("w") / n, 0.001, 0.999).alias("home_rate"),
        F.coalesce(F.try_divide(F.col("om").cast("double"), F.col("on").cast("double")), F.lit(0.0)).alias("home_edge"),
    )


def eligible(periods: DataFrame, summary: DataFrame, min_periods: int = 2, min_games: int = MIN_TRAINING) -> DataFrame:
    """Target games with the summary of their training set, without the first periods and those with too few training games."""
    return join_summary(periods, summary.drop("period"), [LEAGUE, "ord"]).where((F.col("ord") > min_periods) & (F.col("train_games") >= min_games))


def skipped_periods(periods: DataFrame, summary: DataFrame, min_periods: int = 2, min_games: int = MIN_TRAINING) -> DataFrame:
    rows = periods.select(LEAGUE, "period", "ord").distinct().join(summary.select(LEAGUE, "ord", "train_games"), [LEAGUE, "ord"], "left")
    reason = F.when(F.col("ord") <= min_periods, "fewer than the minimum earlier periods").when(F.coalesce("train_games", F.lit(0)) < min_games, f"fewer than {min_games} training games")
    return rows.select("period", reason.alias("reason")).where("reason IS NOT NULL")


Expectation = Callable[[], tuple[Column, Column, Column]]


def train_mean() -> tuple[Column, Column, Column]:
    return F.col("train_home"), F.col("train_away"), F.col("home_rate")


def _with_probability(home: Column, away: Column) -> tuple[Column, Column, Column]:
    return home, away, normal_cdf((home - away) / F.col("scale"))


def rolling_average() -> tuple[Column, Column, Column]:
    """Mean of the own scoring and the opponent's allowed points of the season so far, else the training mean."""
    home = F.coalesce(mean_of("home_points_season", "away_points_allowed_season"), F.col("train_home"))
    away = F.coalesce(mean_of("away_points_season", "home_points_allowed_season"), F.col("train_away"))
    return _with_probability(home, away)


def shrunk(k: float, home_term: bool = False) -> Expectation:
    """Season means shrunk by ``k`` games towards the training mean of all teams; optionally half the home margin to either side."""

    def expect() -> tuple[Column, Column, Column]:
        league = (F.col("train_home") + F.col("train_away")) / 2

        def mean(side: str, what: str) -> Column:
            n = F.col(f"{side}_prior_games").cast("double")
            own = F.coalesce(f"{side}_{what}_season", league)
            return F.coalesce(F.try_divide(own * n + league * k, n + k), league)

        home = (mean("home", "points") + mean("away", "points_allowed")) / 2
        away = (mean("away", "points") + mean("home", "points_allowed")) / 2
        if home_term:
            shift = F.when(F.col("neutral_site"), 0.0).otherwise(F.col("home_edge") / 2)
            home, away = home + shift, away - shift
        return _with_probability(home, away)

    return expect


@dataclass(frozen=True)
class Gathered:
    """What ridges of every period are solved from: ``rows`` (league, ord, sums, medians) over the games before each, of features ``names``."""

    names: list[str]
    rows: DataFrame


#: Periods whose sums a task holds before it passes them on (125 kilobytes each for sixty features).
HELD = 512


def gather(periods: DataFrame, names: list[str]) -> Gathered:
    """Games are summed up where they lie, a row a task and period; a period's sums are running totals over blocks of periods, and its medians
    come by selection (``scans``), so that no task sees all periods or all values of a feature."""
    size = len(names)
    rows = periods.where("home_score IS NOT NULL AND away_score IS NOT NULL").select(LEAGUE, F.col("ord").cast("int").alias("ord"), F.array(*(F.col(n).cast("double") for n in names)).alias("x"), F.col("home_score").cast("double").alias("h"), F.col("away_score").cast("double").alias("a"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def passed_on() -> Iterator[pd.DataFrame]:
            for (league, day), sums in held.items():
                yield pd.DataFrame({LEAGUE: [league], "ord": [day], "sums": [sums.tobytes()]})
            held.clear()

        for pdf in batches:
            for key, own in pdf.groupby([LEAGUE, "ord"]):
                x = np.array(own["x"].tolist(), float).reshape(len(own), size)
                gone = np.isnan(x)
                v = np.column_stack([np.where(gone, 0.0, x), gone, np.ones(len(x)), own["h"], own["a"]])
                held[key] = held[key] + v.T @ v if key in held else v.T @ v
            if len(held) > HELD:
                yield from passed_on()
        yield from passed_on()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][[LEAGUE, "ord"]].assign(sums=[sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()])

    kind = f"{LEAGUE} string, ord int, sums binary"
    per = cut(rows.mapInPandas(summed, kind).groupBy(LEAGUE, "ord").applyInPandas(added, kind))
    before = running_totals(per, [LEAGUE], "ord", "sums")
    each = rows.select(LEAGUE, "ord", F.posexplode("x").alias("feature", "value"))
    asks = per.select(LEAGUE, "ord", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("feature"))
    medians = expanding_medians(each, asks, [LEAGUE, "feature"])
    medians = medians.groupBy(LEAGUE, "ord").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("of"))
    of = medians.select(LEAGUE, "ord", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.element_at("of", k)).alias("medians"))
    return Gathered(list(names), cut(before.join(of, [LEAGUE, "ord"], "left")))


@dataclass(frozen=True)
class ExpandingRidge:
    """Two ridge regressions (home and away score) of every period on all games before it.

    Missing values are the exact median of the training games, marked by indicators if asked for; the intercept is free. A feature
    without any value, or of one value, has no weight. The features are read as columns of the matchups; None: all that a model may use.
    """

    features: tuple[str, ...] | None = None
    alpha: float = 12.0
    indicators: bool = True
    scaled: bool = False

    def fit(self, periods: DataFrame, min_games: int = MIN_TRAINING, gathered: Gathered | None = None) -> DataFrame:
        """(league, ord, medians, home, away, marks_home, marks_away, first_home, first_away, margin_std): a row a period with enough
        games before it. ``gathered`` has the sums and medians if they are at hand, of these features or more."""
        names = list(self.features or model_features(periods))
        gathered = gathered or gather(periods, names)
        at, whole = [gathered.names.index(n) for n in names], len(gathered.names)
        of = [*at, *(whole + i for i in at), 2 * whole, 2 * whole + 1, 2 * whole + 2]

        def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for league, day, sums, medians in zip(pdf[LEAGUE], pdf["ord"], pdf["sums"], pdf["medians"]):
                    middle = np.array([np.nan] * whole if medians is None else medians, float)
                    rows.append((league, day, *self._solve(np.frombuffer(sums).reshape(2 * whole + 3, -1)[np.ix_(of, of)], middle[at], min_games)))
                yield pd.DataFrame([r for r in rows if r[2] is not None], columns=[LEAGUE, "ord", *FITTED])

        kinds = ", ".join(f"{n} {k}" for n, k in FITTED.items())
        return gathered.rows.mapInPandas(solved, f"{LEAGUE} string, ord int, {kinds}")

    def _solve(self, g: np.ndarray, medians: np.ndarray, min_games: int) -> tuple:
        """The fit from sums of products of (value or 0, missing, 1, home score, away score)."""
        size, one = len(medians), 2 * len(medians)
        n = g[one, one]
        if n < min_games:
            return (None,) * len(FITTED)
        m = np.where(np.isnan(medians), 0.0, medians)
        to = np.vstack([np.column_stack([np.eye(size), np.diag(m)]), np.column_stack([np.zeros((size, size)), np.eye(size)])])
        to = to if self.indicators else to[:size]
        total, scores = to @ g[:one, one], g[one, one + 1 :]
        c = to @ g[:one, :one] @ to.T - np.outer(total, total) / n
        cy = to @ g[:one, one + 1 :] - np.outer(total, scores) / n
        var = np.diag(c) / n
        used = var > 1e-12 * np.maximum(1.0, (total / n) ** 2)
        scale = np.where(used & self.scaled, np.sqrt(np.maximum(var, 0)), 1.0)
        inner = (c / np.outer(scale, scale))[np.ix_(used, used)] + self.alpha * np.eye(used.sum())
        w = np.zeros((len(c), 2))
        w[used] = np.linalg.solve(inner, (cy / scale[:, None])[used]) / scale[used, None]
        first = (scores - total @ w) / n
        d, dy = w[:, 0] - w[:, 1], cy[:, 0] - cy[:, 1]
        margin = g[one + 1 :, one + 1 :]
        squares = margin[0, 0] - 2 * margin[0, 1] + margin[1, 1] - (scores[0] - scores[1]) ** 2 / n - 2 * d @ dy + d @ c @ d
        marks = w[size:] if self.indicators else np.zeros((size, 2))
        return m.tolist(), w[:size, 0].tolist(), w[:size, 1].tolist(), marks[:, 0].tolist(), marks[:, 1].tolist(), float(first[0]), float(first[1]), max(1.0, float(np.sqrt(max(squares, 0.0) / max(n - 1, 1))))

    def __call__(self, periods: DataFrame, target: DataFrame, gathered: Gathered | None = None) -> DataFrame:
        """``target`` with ``home_points``, ``away_points`` (0 to 70) and ``home_win_probability`` of the fits before its periods."""
        names = list(self.features or model_features(periods))
        fits = self.fit(periods, gathered=gathered)

        def terms(side: str) -> Column:
            """What a feature adds: its value times ``w``, or ``m`` where it has none."""
            parts = F.arrays_zip("medians", F.col(side).alias("w"), F.col(f"marks_{side}").alias("q"))
            return F.transform(parts, lambda v: F.struct(v["w"].alias("w"), (v["medians"] * v["w"] + v["q"]).alias("m"))).alias(f"_{side}")

        def points(side: str) -> Column:
            parts = F.zip_with("_x", f"_{side}", lambda x, of: F.coalesce(x * of["w"], of["m"]))
            return (F.col(f"first_{side}") + F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)).alias(f"{side}_points")

        fits = fits.select(LEAGUE, "ord", "first_home", "first_away", "margin_std", terms("home"), terms("away"))
        rows = join_summary(target.withColumn("_x", F.array(*(F.col(n).cast("double") for n in names))), fits, [LEAGUE, "ord"], FEW_FITS)
        keep = [c for c in target.columns if c not in ("home_points", "away_points", "home_win_probability", "margin_std")]
        # exploded, so that what reads the points doesn't work them out again for each use
        rows = rows.select(*keep, "margin_std", F.explode(F.array(F.struct(points("home"), points("away")))).alias("_of")).select(*keep, "margin_std", "_of.*")
        rows = rows.withColumns({c: clip(c, 0.0, 70.0) for c in ("home_points", "away_points")})
        return rows.withColumn("home_win_probability", normal_cdf((F.col("home_points") - F.col("away_points")) / F.col("margin_std"))).drop("margin_std")


#: Fits (some kilobytes each) up to which they are broadcast.
FEW_FITS = 500
#: Columns of a fit.
FITTED = {"medians": "array<double>", "home": "array<double>", "away": "array<double>", "marks_home": "array<double>", "marks_away": "array<double>", "first_home": "double", "first_away": "double", "margin_std": "double"}

SMALL = ("home_points_season", "away_points_season", "home_points_allowed_season", "away_points_allowed_season", "home_yards_per_play_season", "away_yards_per_play_season", "home_field_indicator")

#: Metrics whose features the column models read.
COLUMN_METRICS = ("points", "points_allowed")

#: Registry of models: a name to a function without arguments that gives home, away and probability columns over the summary of the
#: training games, or to a trained model, a function of (all periods, target games) that gives the target with its predictions.
Trained = Callable[[DataFrame, DataFrame], DataFrame]
COLUMN_MODELS: dict[str, Expectation] = {
    "train_mean": train_mean, "rolling_average": rolling_average, "shrunk_k2": shrunk(2.0), "shrunk_k5": shrunk(5.0), "shrunk_k5_home": shrunk(5.0, True),
}
TRAINED_MODELS: dict[str, Trained] = {
    "ridge": ExpandingRidge(), "ridge_scaled_all": ExpandingRidge(alpha=10.0, indicators=False, scaled=True), "ridge_scaled_small": ExpandingRidge(SMALL, 10.0, False, True),
}


class Registry:
    """Models by name. Registering returns a new registry, so that callers don't change each other's."""

    def __init__(self, columns: dict[str, Expectation] | None = None, trained: dict[str, Trained] | None = None):
        self.columns, self.trained = dict(COLUMN_MODELS if columns is None else columns), dict(TRAINED_MODELS if trained is None else trained)

    def names(self) -> list[str]:
        return [*self.columns, *self.trained]

    def registered(self, name: str, model: Expectation | Trained, trained: bool = False) -> Registry:
        if name in self.names():
            raise ValueError(f"model {name} is registered already")
        return Registry(self.columns | ({} if trained else {name: model}), self.trained | ({name: model} if trained else {}))


def predict(target: DataFrame, names: list[str] | None = None, periods: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """Long form (game, scores, model, home_points, away_points, home_win_probability) of the models; trained ones need ``periods``."""
    registry = registry or Registry()
    names = names or [n for n in registry.names() if n in registry.columns or periods is not None]
    keep = [c for c in ("game_id", "period", "ord", "season", "week", "home_score", "away_score") if c in target.columns]
    result = [*keep, "model", "home_points", "away_points", "home_win_probability"]
    parts = []
    rows = []
    ridges = [m for m in (registry.trained.get(n) for n in names if n not in registry.columns) if isinstance(m, ExpandingRidge)]
    gathered = None
    if len(ridges) > 1 and periods is not None:  # sums and medians are found once for all of them
        gathered = gather(periods, list(dict.fromkeys(f for m in ridges for f in m.features or model_features(periods))))
    for name in names:
        if name in registry.columns:
            home, away, p = registry.columns[name]()
            rows.append(F.struct(F.lit(name).alias("model"), home.cast("double").alias("home_points"), away.cast("double").alias("away_points"), p.cast("double").alias("home_win_probability")))
        elif periods is None:
            raise ValueError(f"model {name} is trained: it needs all periods")
        else:
            model = registry.trained[name]
            own = model(periods, target, gathered) if isinstance(model, ExpandingRidge) else model(periods, target)
            parts.append(own.withColumn("model", F.lit(name)).select(*result))
    if rows:
        # made before they are exploded: there an expression that many terms share is worked out once
        parts.insert(0, target.select(*keep, F.array(*rows).alias("_of")).select(*keep, F.explode("_of").alias("m")).select(*keep, "m.*"))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Ridge:
    features: list[str]
    medians: dict[str, float]
    indicators: list[str]
    models: dict[str, object]
    margin_std: float
    scales: dict[str, tuple[float, float]] | None = None


def _value(c: str) -> Column:
    """A feature's value, null where it has none (null or NaN)."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _prepared(df: DataFrame, features: list[str], medians: dict[str, float], indicators: list[str], scales=None) -> DataFrame:
    filled = {f: F.coalesce(_value(f), F.lit(medians[f])) for f in features} | {f"{f}_missing": _value(f).isNull().cast("double") for f in indicators}
    if scales:
        filled = {f: (c - scales[f][0]) / scales[f][1] for f, c in filled.items() if f in scales}
    return df.withColumn("_features", array_to_vector(F.array(*filled.values())))


#: Error of the ranks between which a median is looked for, as a share of the rows; up to its inverse a sketch has every value.
RANK_ERROR = 1e-4


def summaries(rows: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """Per column: values, least, greatest, and two values between which, by a sketch of ranks, the median lies. All in one pass."""
    share = F.array(F.lit(0.5 - 2 * RANK_ERROR), F.lit(0.5 + 2 * RANK_ERROR))
    made = rows.agg(*(F.struct(F.count(x), F.min(x), F.max(x), F.percentile_approx(x, share, F.lit(int(1 / RANK_ERROR)))).alias(f"_{i}") for i, x in enumerate(map(_value, columns)))).first()
    return {c: tuple(made[i]) for i, c in enumerate(columns)}


def exact_medians(rows: DataFrame, columns: list[str], known: dict[str, tuple] | None = None) -> dict[str, float]:
    """Exact medians, of the columns that have a value. ``summaries`` (``known``, if at hand) bound each; of the rows only the values between
    its bounds are looked at, and how many lie below. Where the middle isn't there after all, it is found by selection."""
    known = known or summaries(rows, columns)
    named = [c for c in columns if known[c][0]]
    if not named:
        return {}
    x = {c: _value(c) for c in named}
    each = F.array(*(F.struct(F.lit(i).alias("feature"), F.when(x[c] < known[c][3][0], F.lit(float("-inf"))).when(x[c] <= known[c][3][1], x[c]).alias("value")) for i, c in enumerate(named)))
    counts = rows.select(F.explode(F.filter(each, lambda v: v["value"].isNotNull())).alias("v")).groupBy("v.feature", "v.value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature").orderBy("value"))  # of a feature some values about its middle
    middle = F.element_at(F.create_map(*(F.lit(v) for i, c in enumerate(named) for v in (i, (known[c][0] - 1) // 2))), F.col("feature"))
    upper = F.element_at(F.create_map(*(F.lit(v) for i, c in enumerate(named) for v in (i, known[c][0] // 2))), F.col("feature"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    found = {named[r["feature"]]: (r["a"], r["b"]) for r in counts.withColumn("upto", upto).groupBy("feature").agg(at(middle).alias("a"), at(upper).alias("b")).collect()}
    out = {c: (a + b) / 2 for c, (a, b) in found.items() if a is not None and b is not None and a > float("-inf")}
    left = [c for c in named if c not in out]
    if left:
        each = rows.select(F.lit(0).alias("ord"), F.posexplode(F.array(*(F.col(c).cast("double") for c in left))).alias("feature", "value"))
        asks = rows.sparkSession.range(len(left)).select(F.col("id").cast("int").alias("feature"), F.lit(1).alias("ord"))
        out |= {left[r["feature"]]: r["median"] for r in expanding_medians(each, asks, ["feature"]).collect()}
    return out


def fit_ridge(train: DataFrame, features: list[str], alpha: float = 12.0, indicators: bool = True, scaled: bool = False) -> Ridge:
    """Two ridge regressions (home and away score) with exact median imputation and, if asked for, missing indicators or scaling.

    The penalty ``alpha`` on the sum of squared errors is Spark's ``alpha * stddev_pop(y) / n``; the intercept is free.
    """
    train = train.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    stats = train.agg(F.count("*").alias("n"), F.stddev_pop("home_score").alias("home_score"), F.stddev_pop("away_score").alias("away_score")).first()
    n = stats["n"]
    if n < MIN_TRAINING:
        raise ValueError(f"{n} training games; {MIN_TRAINING} are needed")
    known = summaries(train, features)
    medians = exact_medians(train, features, known)
    features = [f for f in features if known[f][0]]
    marks = [f for f in features if known[f][0] < n] if indicators else []
    scales = None
    if scaled:
        filled = {f: F.coalesce(_value(f), F.lit(medians[f])) for f in features}
        m = train.agg(*(F.avg(c).alias(f"a_{f}") for f, c in filled.items()), *(F.stddev_pop(c).alias(f"s_{f}") for f, c in filled.items())).first()
        scales = {f: (m[f"a_{f}"], m[f"s_{f}"]) for f in features if m[f"s_{f}"]}
        features = [f for f in features if f in scales]
    else:  # a constant column carries no weight, and the normal solver wants none
        features = [f for f in features if known[f][1] < known[f][2]]
        marks = [f for f in marks if f in features]
    scores = ("home_score", "away_score")
    ready = _prepared(train, features, medians, marks, scales).select("_features", *(F.col(t).cast("double").alias(t) for t in scores)).cache()
    models = {}
    for target in scores:
        lr = LinearRegression(featuresCol="_features", labelCol=target, predictionCol=f"_p_{target}", solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * stats[target] / n)
        models[target] = lr.fit(ready)
    both = models["away_score"].transform(models["home_score"].transform(ready))
    residual = (F.col("home_score") - F.col("away_score")) - (F.col("_p_home_score") - F.col("_p_away_score"))
    std = max(both.agg(F.stddev_samp(residual)).first()[0] or 0.0, 1.0)
    ready.unpersist()
    return Ridge(features, medians, marks, models, std, scales)


def predict_ridge(target: DataFrame, model: Ridge) -> DataFrame:
    """Expected points (0 to 70), spread, total, probability, bands and confidence tier of each matchup."""
    df = _prepared(target, model.features, model.medians, model.indicators, model.scales)
    for m in model.models.values():
        df = m.transform(df)
    band = model.margin_std / 2**0.5
    df = df.withColumns({"home_expected_points": clip("_p_home_score", 0.0, 70.0), "away_expected_points": clip("_p_away_score", 0.0, 70.0)})
    df = df.withColumns({"projected_spread_home": F.col("home_expected_points") - F.col("away_expected_points"), "projected_total": F.col("home_expected_points") + F.col("away_expected_points")})
    df = df.withColumn("home_win_probability", normal_cdf(F.col("projected_spread_home") / model.margin_std))
    out = df.withColumns(
        {f"{s}_score_low": round_to(clip(F.col(f"{s}_expected_points") - band, 0.0)) for s in ("home", "away")}
        | {f"{s}_score_high": round_to(F.col(f"{s}_expected_points") + band) for s in ("home", "away")}
        | {"confidence_tier": model_confidence("home_win_probability")}
    )
    return out.select(*[c for c in out.columns if not c.startswith("_")])
