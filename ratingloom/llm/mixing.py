"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell of (source, language, topic) in Spark. Values that the targets don't name share the cell value
``other``, so there are at most the product of the targets' sizes plus one cells, and the totals may go to the driver whatever
the size of the corpus. There the cell weights are raked to the target marginals in turn. A document is drawn with the
probability of its cell, its fitted over its present share relative to the largest such ratio, by comparing it with a uniform
number from the MD5 of its id. So the sample's token shares are the fitted ones in expectation, and the same documents are drawn
again in any later run.

Edge cases: null source, language or text count as ``other``, ``other`` and empty; cells without tokens draw with probability
1; targets of values that don't occur are shared out among those that do; ``other`` keeps its present share; rows that repeat an
id are drawn alike, and a null id is drawn like the id "null".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
#: Targets of the registered query and of the pipeline: shares of tokens.
SOURCES = {f"src{i}": 0.05 for i in range(20)}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TOPICS = {"prose": 0.9, "table": 0.04, "notice": 0.04, "dialogue": 0.02}
ROUNDS = 20
SEED = "mix-1"


@dataclass(frozen=True)
class Marginal:
    column: str
    target: dict[str, float]


MARGINALS = (Marginal("source", SOURCES), Marginal("lang", LANGUAGES), Marginal("topic", TOPICS))


def topic(text: Column) -> Column:
    """A plain topic by form, for tables that have none: rows of cells, legal notices, questions, all other prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("icensed under")) | F.contains(text, F.lit("ights reserved")), "notice")
        .when(F.contains(text, F.lit("?")), "dialogue")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_cells(docs: DataFrame, marginals: tuple[Marginal, ...] = MARGINALS, prefix: str = "_m_") -> DataFrame:
    """``docs`` with each marginal's value, those without a target as ``other``."""
    return docs.withColumns({prefix + m.column: F.when(F.col(m.column).isin(list(m.target)), F.col(m.column)).otherwise(OTHER) for m in marginals})


def rake(mass: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Masses fitted to the targets of each axis in turn; an axis value without mass is left out and its target shared out."""
    fitted = mass / mass.sum()
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            now = fitted.sum(axis=tuple(k for k in range(fitted.ndim) if k != axis))
            want = np.where(now > 0, target, 0.0)
            factor = np.divide(want / want.sum() if want.sum() else want, now, out=np.zeros_like(now), where=now > 0)
            fitted = fitted * factor.reshape([-1 if k == axis else 1 for k in range(fitted.ndim)])
    return fitted


def rates(totals: list[tuple], marginals: tuple[Marginal, ...] = MARGINALS, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Drawing probability of each cell from (value, ..., tokens) rows; the expected token shares are the fitted ones."""
    levels = [[*m.target, OTHER] for m in marginals]
    mass = np.zeros([len(x) for x in levels])
    for *cell, tokens in totals:
        mass[tuple(x.index(v) for x, v in zip(levels, cell))] += tokens
    if not mass.sum():
        return {tuple(cell): 1.0 for *cell, _ in totals}
    targets = []
    for axis, m in enumerate(marginals):
        other = mass.take(-1, axis=axis).sum() / mass.sum()
        named = np.array(list(m.target.values()), float)
        present = mass.sum(axis=tuple(k for k in range(mass.ndim) if k != axis))[:-1] > 0
        named = np.where(present, named, 0.0)
        targets.append(np.append(named / named.sum() * (1 - other) if named.sum() else named, other))
    weight = np.divide(rake(mass, targets, rounds), mass / mass.sum(), out=np.zeros_like(mass), where=mass > 0)
    rate = np.where(mass > 0, weight / weight.max(), 1.0)
    return {tuple(cell): float(rate[tuple(x.index(v) for x, v in zip(levels, cell))]) for *cell, _ in totals}


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _drawn(docs: DataFrame, tokens: str, id_col: str, marginals: tuple[Marginal, ...], rounds: int, seed: str) -> DataFrame:
    """The drawn rows of ``docs`` with ``_rate``."""
    cells = with_cells(docs, marginals)
    keys = ["_m_" + m.column for m in marginals]
    totals = [tuple(r) for r in cells.groupBy(*keys).agg(F.sum(F.coalesce(F.col(tokens), F.lit(0))).alias("_total")).collect()]
    schema = ", ".join(f"{k} string" for k in keys) + ", _rate double"
    table = docs.sparkSession.createDataFrame([(*cell, r) for cell, r in rates(totals, marginals, rounds).items()], schema)
    return cells.join(F.broadcast(table), keys).where(uniform(F.col(id_col), seed) < F.col("_rate")).select(*docs.columns, "_rate")


def draw(docs: DataFrame, tokens: str, id_col: str = "doc_id", marginals: tuple[Marginal, ...] = MARGINALS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with ``rate``; ``tokens`` names its column of token counts."""
    out = _drawn(docs, tokens, id_col, marginals, rounds, seed)
    return out.select(*(c for c in docs.columns if c != "rate"), F.col("_rate").alias("rate"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marginals: tuple[Marginal, ...] = MARGINALS) -> DataFrame:
    """The drawn rows of ``docs``, its columns only; the topic is taken from the text where ``docs`` has none."""
    own = [F.col(m.column) if m.column in docs.columns else topic(F.coalesce(F.col(text_col), F.lit(""))).alias(m.column) for m in marginals]
    ready = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), n_tokens(F.col(text_col)).alias("_tokens"), *own)
    return _drawn(ready, "_tokens", "_id", marginals, ROUNDS, SEED).select("_row.*")


def mixture_sql(source: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the drawn documents, with the raking spelled out as one table a step."""
    named = lambda values: ", ".join(f"'{v}'" for v in values)
    with_ = [
        f"""d AS MATERIALIZED (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'icensed under') OR contains(coalesce(text, ''), 'ights reserved') THEN 'notice'
       WHEN contains(coalesce(text, ''), '?') THEN 'dialogue' ELSE 'prose' END AS topic FROM {source})""",
        "c AS MATERIALIZED (SELECT *, " + ", ".join(f"CASE WHEN {m.column} IN ({named(m.target)}) THEN {m.column} ELSE '{OTHER}' END AS m_{m.column}" for m in MARGINALS) + " FROM d)",
        "f0 AS MATERIALIZED (SELECT m_source, m_lang, m_topic, CAST(SUM(n_tokens) AS DOUBLE) / (SELECT SUM(n_tokens) FROM c) AS w FROM c GROUP BY ALL)",
    ]
    for m in MARGINALS:
        values = ", ".join(f"('{v}', CAST({t!r} AS DOUBLE))" for v, t in m.target.items())
        with_.append(
            f"""t_{m.column} AS MATERIALIZED (WITH now AS (SELECT m_{m.column} AS v, SUM(w) AS w FROM f0 GROUP BY ALL), named AS (SELECT n.v, n.t FROM (VALUES {values}) AS n(v, t) JOIN now ON now.v = n.v AND now.w > 0)
  SELECT v, t / (SELECT SUM(t) FROM named) * (1 - coalesce((SELECT w FROM now WHERE v = '{OTHER}'), 0)) AS t FROM named UNION ALL SELECT v, w FROM now WHERE v = '{OTHER}')"""
        )
    k = 0
    for _ in range(rounds):
        for m in MARGINALS:
            with_.append(f"f{k + 1} AS MATERIALIZED (SELECT m_source, m_lang, m_topic, w * t / SUM(w) OVER (PARTITION BY m_{m.column}) AS w FROM f{k} JOIN t_{m.column} ON v = m_{m.column})")
            k += 1
    with_.append(f"r AS (SELECT a.m_source, a.m_lang, a.m_topic, a.w / b.w AS g FROM f{k} a JOIN f0 b ON a.m_source = b.m_source AND a.m_lang = b.m_lang AND a.m_topic = b.m_topic WHERE b.w > 0)")
    return f"""WITH {", ".join(with_)}
SELECT c.doc_id, c.source, c.lang, c.topic, CAST(c.n_tokens AS BIGINT) AS n_tokens, round(g / (SELECT MAX(g) FROM r), 4) AS rate
FROM c JOIN r ON c.m_source = r.m_source AND c.m_lang = r.m_lang AND c.m_topic = r.m_topic
WHERE CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(c.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < g / (SELECT MAX(g) FROM r)"""
