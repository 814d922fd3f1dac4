"""Running totals and order statistics over expanding sets, without a task that sees a whole column.

Running totals are a two-level scan: the rows of a block are added up, totals of blocks are added up in order, and each block
goes on from the total before it. Medians of expanding sets are found by selection: a group's values are cut into buckets of
nearly equal size, counts of a bucket per period tell in which bucket the middle of each period's set lies, and only that bucket
is looked into, after being cut again if it is still large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

#: Periods of a block of running totals.
BLOCK = 32
#: Rows (distinct value and period) of a bucket that one task sorts, and buckets into which a larger one is cut.
BUCKET_ROWS, BUCKETS = 20_000, 64


def running_totals(sums: DataFrame, keys: list[str], order: str, value: str, block: int | None = None) -> DataFrame:
    """(keys, order, value): for each row the sum of ``value`` over all rows of its keys that come before it in ``order`` (a whole
    number from 1, each once). ``value`` is binary, the bytes of equally long arrays of doubles; the first row's is all zeros."""
    kinds = dict(sums.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    rows = sums.select(*keys, order, value, F.floor((F.col(order) - 1) / (block or BLOCK)).cast("int").alias("_block"))
    add = lambda parts: sum(np.frombuffer(v) for v in parts).tobytes()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][[*keys, "_block"]].assign(**{value: [add(pdf[value])]})

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        total, out = np.zeros(len(pdf[value].iloc[0]) // 8), []
        for v in pdf[value]:
            out.append(total.tobytes())
            total = total + np.frombuffer(v)
        return pdf.assign(_base=out)[[*keys, "_block", "_base"]]

    def within(pdf: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        total, out = np.frombuffer(base["_base"].iloc[0]), []
        for v in pdf[value]:
            out.append(total.tobytes())
            total = total + np.frombuffer(v)
        return pdf.assign(**{value: out})[[*keys, order, value]]

    totals = rows.groupBy(*keys, "_block").applyInPandas(whole, f"{head}, _block int, {value} binary")
    bases = totals.groupBy(*keys).applyInPandas(before, f"{head}, _block int, _base binary")
    return rows.groupBy(*keys, "_block").cogroup(bases.groupBy(*keys, "_block")).applyInPandas(within, f"{head}, {order} {kinds[order]}, {value} binary")


def _seek(values: pd.DataFrame, asks: pd.DataFrame) -> list[tuple]:
    """(ord, which, index of the row of ``values``, rank left within it) for each ask that has an answer. ``values`` has value, ord
    and n in order of value (or bucket); a rank that isn't given is that of the lower or upper middle."""
    at, n = values["ord"].to_numpy(), values["n"].to_numpy()
    out = []
    for (day,), group in asks.groupby(["ord"]):
        count = np.cumsum(np.where(at < day, n, 0))
        if not count[-1]:
            continue
        for which, rank in zip(group["which"], group["rank"]):
            k = (int(count[-1]) - 1 + which) // 2 if rank < 0 else rank
            i = int(np.searchsorted(count, k, "right"))
            out.append((day, which, i, k - (int(count[i - 1]) if i else 0)))
    return out


def _place(cuts: str, value: str, most: int) -> Column:
    """How many of up to ``most`` ascending ``cuts`` are less than ``value``: a binary search, a step a level."""
    place = F.lit(0)
    for bit in reversed(range(most.bit_length())):
        place = place + F.when(F.get(cuts, place + F.lit((1 << bit) - 1)) < F.col(value), F.lit(1 << bit)).otherwise(F.lit(0))
    return place


def expanding_medians(values: DataFrame, asks: DataFrame, keys: list[str], bucket_rows: int | None = None) -> DataFrame:
    """(keys, ord, median) for each of ``asks`` (keys, ord): the exact median of ``values`` (keys, ord, value) with a smaller ord, as
    numpy gives it. Nulls and NaN aren't values; an ask without a value before it has no row."""
    limit = bucket_rows or BUCKET_ROWS
    kinds = dict(values.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    by = [*keys, "path"]
    left = cut(values.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*keys, "value", F.col("ord").cast("int").alias("ord")).agg(F.count("*").alias("n")).withColumn("path", F.lit("")))
    wanted = asks.select(*keys, F.col("ord").cast("int").alias("ord"), F.explode(F.array(F.lit(0), F.lit(1))).alias("which")).withColumns({"path": F.lit(""), "rank": F.lit(-1).cast("long")})

    def answer(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "ord", "which", "value"]
        if pdf.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        pdf = pdf.sort_values("value", kind="stable")
        found = _seek(pdf, asked)
        value = pdf["value"].to_numpy()
        out = pd.DataFrame({"ord": [f[0] for f in found], "which": [f[1] for f in found], "value": [value[f[2]] for f in found]})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[columns]

    def locate(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "ord", "which", "rank"]
        if pdf.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        pdf = pdf.sort_values("bucket", kind="stable")
        found = _seek(pdf, asked)
        bucket = pdf["bucket"].to_numpy()
        path = pdf["path"].iloc[0]
        # ranks within the bucket: the rows of a bucket are its counts of each period, so go back to where it starts
        rows = []
        at, n = pdf["ord"].to_numpy(), pdf["n"].to_numpy()
        for day, which, i, rest in found:
            start = np.searchsorted(bucket, bucket[i])
            rows.append((f"{path}.{bucket[i]}", day, which, rest + int(n[start:i][at[start:i] < day].sum())))
        out = pd.DataFrame(rows, columns=["path", "ord", "which", "rank"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[columns]

    answers = []
    while True:
        size = cut(left.groupBy(*by).agg(F.count("*").alias("_rows"), F.min("value").alias("_low"), F.max("value").alias("_high")))
        large = size.where((F.col("_rows") > limit) & (F.col("_low") < F.col("_high")))
        small = left.join(size.where((F.col("_rows") <= limit) | (F.col("_low") >= F.col("_high"))).select(*by), by, "left_semi")
        answers.append(cut(small.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(answer, f"{head}, ord int, which int, value double")))
        if large.isEmpty():
            break
        rows = left.join(large.select(*by), by, "left_semi")
        share = F.array(*(F.lit(k / BUCKETS) for k in range(1, BUCKETS)))
        # cuts below the largest value, so that no bucket takes all
        bounds = rows.join(large, by).groupBy(*by).agg(F.percentile_approx("value", share, F.lit(10_000)).alias("_cuts"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
        bounds = bounds.select(*by, F.array_sort(F.array_distinct(F.concat(F.array("_low"), F.filter("_cuts", lambda x: x < F.col("_high"))))).alias("_cuts"))
        dealt = cut(rows.join(F.broadcast(bounds) if bounds.limit(10_001).count() <= 10_000 else bounds, by).withColumn("bucket", _place("_cuts", "value", BUCKETS)).drop("_cuts"))
        counts = dealt.groupBy(*by, "bucket", "ord").agg(F.sum("n").alias("n"))
        wanted = cut(counts.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(locate, f"{head}, path string, ord int, which int, rank long"))
        inside = dealt.withColumn("path", F.concat_ws(".", "path", F.col("bucket").cast("string"))).drop("bucket")
        left = cut(inside.join(wanted.select(*by).distinct(), by, "left_semi"))
    both = answers[0]
    for more in answers[1:]:
        both = both.unionByName(more)
    middle = both.groupBy(*keys, "ord").agg(F.max(F.when(F.col("which") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("value"))).alias("b"))
    return middle.select(*keys, "ord", ((F.col("a") + F.col("b")) / 2).alias("median"))
