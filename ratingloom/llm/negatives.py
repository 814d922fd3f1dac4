"""Hard-negative mining by segment summaries.

A vector is split into segments, and of each segment only its mean and its deviation (root of the summed squares about the mean)
are kept. By Cauchy-Schwarz the inner product over a segment of n components lies within n * mean * mean' plus or minus
deviation * deviation', so the summaries of two vectors bound their score. Levels of 1, 4 and 16 segments refine the bounds, and
only pairs that a level can't settle go to the next; what is left is scored exactly. Nothing is approximate: a pair is dropped
only if its bounds show that it can't be among the first rows asked for.

Anchors are a stated query set and are held against all rows in blocks: rows are dealt to ``BLOCKS`` blocks (more if a block
would hold more than ``BLOCK_ROWS``) by a hash of the whole row, anchors to blocks of ``ANCHOR_ROWS``, and a task takes one pair
of blocks. It returns the few best of each anchor in its block of rows, and windows per anchor choose among those. The first
pass finds the positives, whose scores give the second its bands.

Scores are integers: components are floor(scale * x), added up in double precision where no sum can pass 2^53, else in 64-bit
integers, else as Python integers (a score beyond 64 bits raises).

Edge cases: rows with a null id, label or vector, or a null or non-finite component (or one that isn't finite when scaled), take
no part; rows that repeat id, label and vector count once, and no row with the anchor's id is its positive or negative; vectors
of unlike length are compared as if the shorter went on with zeros; an anchor without a positive has no rows; other columns are
left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
LEVELS = (1, 4, 16)
BLOCKS, BLOCK_ROWS, ANCHOR_ROWS = 64, 65_536, 32_768
#: Anchors, and pairs, that a task holds at once.
STEP, PAIRS = 64, 200_000


def usable(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, vec) of the rows that take part, each once."""
    vec = F.col(vector_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.cast("array<double>").alias("vec")).distinct()


def components_of(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return np.floor(SCALE * out)


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment: the mean times the root of its length, and the deviation; inner products of either bound those of the segments."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.maximum(np.diff(edges), 1)
    at = np.repeat(np.arange(segments), np.diff(edges))
    one = np.zeros((x.shape[1], segments))
    one[np.arange(x.shape[1]), at] = 1
    total = x @ one
    off = x - (total / size)[:, at]
    return total / np.sqrt(size), np.sqrt((off * off) @ one)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, pair by pair."""
    if not len(a):
        return np.zeros(0, np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if most < 2**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)], dtype=object).astype(np.int64)


class Block:
    """The rows of a block with the summaries of all levels."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.levels = [summaries(x, n) for n in LEVELS if n <= max(x.shape[1], 1)]
        self.norm = np.sqrt((x * x).sum(axis=1))


def bounds(a: Block, i: np.ndarray, b: Block, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of rows i of ``a`` with rows j of ``b``, wide enough for rounding."""
    (am, ad), (bm, bd) = a.levels[level], b.levels[level]
    middle, reach = np.einsum("ij,ij->i", am[i], bm[j]), np.einsum("ij,ij->i", ad[i], bd[j])
    reach += 1e-9 * a.norm[i] * b.norm[j] + 1e-6
    return middle - reach, middle + reach


def _kth(group: np.ndarray, value: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The k-th largest value of each group, minus infinity where it has fewer."""
    out = np.full(groups, -np.inf)
    order = np.lexsort((-value, group))
    g = group[order]
    nth = np.arange(len(g)) - np.searchsorted(g, g)
    at = nth == k - 1
    out[g[at]] = value[order][at]
    return out


def search(a: Block, b: Block, fits: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of all pairs that may be among the first k of some band of a's row. ``fits`` says which pairs are
    asked for; ``low`` and ``high`` are a row's bands, one in each column (minus and plus infinity: all scores)."""
    i, j = np.nonzero(fits)
    for level in range(len(a.levels)):
        if not len(i):
            break
        lo, hi = (np.concatenate(x) for x in zip(*(bounds(a, i[s : s + PAIRS], b, j[s : s + PAIRS], level) for s in range(0, len(i), PAIRS))))
        needed = np.zeros(len(i), bool)
        for c in range(low.shape[1]):
            sure = (lo >= low[i, c]) & (hi <= high[i, c])
            least = np.maximum(_kth(i[sure], lo[sure], len(low), k), low[:, c])
            needed |= (hi >= least[i]) & (lo <= high[i, c])
        i, j = i[needed], j[needed]
    score = np.concatenate([exact(a.x[i[s : s + PAIRS]], b.x[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)])
    return i, j, score


def first_of(i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which of these pairs are among the first k of some band of their row: higher scores first, then smaller ids."""
    order = np.lexsort((ids[j], -score, i))
    chosen = np.zeros(len(i), bool)
    for c in range(low.shape[1]):
        row = i[order]
        within = order[(score[order] >= low[row, c]) & (score[order] <= high[row, c])]
        row = i[within]
        chosen[within[np.arange(len(row)) - np.searchsorted(row, row) < k]] = True
    return chosen


def _tile(anchors: pd.DataFrame, rows: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    """The best rows of a block for each anchor of a block; ``low`` and ``high`` list an anchor's bands."""
    columns = ["anchor", "id", "score"]
    if anchors.empty or rows.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    width = max(anchors["vec"].map(len).max(), rows["vec"].map(len).max())
    b = Block(components_of(rows["vec"], width))
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    out = []
    for s in range(0, len(anchors), STEP):
        part = anchors.iloc[s : s + STEP]
        most = part["low"].map(len).max()
        low = np.array([[*x, *[np.inf] * (most - len(x))] for x in part["low"]], float).reshape(len(part), most)
        high = np.array([[*x, *[-np.inf] * (most - len(x))] for x in part["high"]], float).reshape(len(part), most)
        alike = part["label"].to_numpy()[:, None] == labels
        fits = (alike if same else ~alike) & (part["id"].to_numpy()[:, None] != ids)
        i, j, score = search(Block(components_of(part["vec"], width)), b, fits, low, high, k)
        keep = first_of(i, j, score, ids, low, high, k)
        out.append(pd.DataFrame({"anchor": part["key"].to_numpy()[i[keep]], "id": ids[j[keep]], "score": score[keep]}))
    return pd.concat(out)


def _search_all(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, same: bool, k: int) -> DataFrame:
    """(anchor, id, score): what each block of rows has to offer to each anchor."""
    row_blocks, anchor_blocks = max(BLOCKS, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_anchors // ANCHOR_ROWS))
    # both sides' keys are of one type: a cogroup casts none, and an int and a long of one value hash to different partitions
    block = lambda n: F.pmod(F.xxhash64("id", "label", "vec"), F.lit(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    near = rows.select("*", block(row_blocks).alias("rb"), all_blocks(anchor_blocks).alias("ab"))
    far = anchors.select("*", block(anchor_blocks).alias("ab"), all_blocks(row_blocks).alias("rb"))
    return far.groupBy("rb", "ab").cogroup(near.groupBy("rb", "ab")).applyInPandas(lambda a, b: _tile(a, b, same, k), "anchor long, id long, score long")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of ``rows`` (id, label, vec): for each row of which ``anchor`` is true and each of its first ``positives`` rows of
    the same label, the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` percent of the positive's."""
    rows = cut(rows)
    chosen = cut(rows.where(anchor).withColumn("key", F.xxhash64("id", "label", "vec")))
    n_rows, n_anchors = rows.count(), chosen.count()
    everything = F.array(F.lit(float("-inf"))).alias("low"), F.array(F.lit(float("inf"))).alias("high")
    found = _search_all(chosen.select("*", *everything), rows, n_anchors, n_rows, True, positives)
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    pos = cut(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives))
    # whole numbers: the band's ends are rounded inwards, and a negative positive has an empty band
    p = F.col("score")
    bands = pos.groupBy(F.col("anchor").alias("key")).agg(F.collect_list(F.struct(F.ceil(p * low / 100).cast("double").alias("low"), F.floor(p * high / 100).cast("double").alias("high"))).alias("b"))
    asked = chosen.join(bands, "key").select(*chosen.columns, F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    neg = _search_all(asked, rows, n_anchors, n_rows, False, negatives).select("anchor", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    with_id = pos.join(chosen.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    pairs = with_id.select("anchor", "anchor_id", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(neg, "anchor")
    pairs = pairs.where((F.col("positive_score") * low <= F.col("negative_score") * 100) & (F.col("negative_score") * 100 <= F.col("positive_score") * high))
    order = Window.partitionBy("anchor", "nth").orderBy(F.col("negative_score").desc(), "negative_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mining_sql(source: str = "embeddings") -> str:
    """DuckDB SQL of the registered query."""
    return f"""WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM {source} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
a AS (SELECT id AS anchor_id, label, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM v WHERE id % 100 = 0),
b AS (SELECT id, label, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM v),
s AS MATERIALIZED (SELECT anchor_id, id, a.label = b.label AS same, CAST(SUM(a.x * b.x) AS BIGINT) AS score FROM a JOIN b USING (k) WHERE anchor_id <> id GROUP BY ALL),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""
