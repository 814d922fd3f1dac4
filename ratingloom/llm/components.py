"""Connected components of an undirected graph given as edges: label propagation with pointer jumping on Spark.

Every round a node takes the smallest label among itself and its neighbours, then the label of its label; the rounds end when
no label changes. Lineage is cut by writing each round's labels to the shared folder. The rows of hubs, and of labels that many
nodes share, are salted in the joins, so that no task gets all nodes of a large component. Self-loops and repeated edges are
harmless; an empty edge table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_unique


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node that has an edge; the label is the smallest node of its component."""
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("peer"))
    both = cut(pairs.unionByName(pairs.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).distinct())
    hubs = hot_keys(both, "peer")
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("label")))
    for _ in range(max_rounds):
        others = labels.select(F.col("node").alias("peer"), F.col("label").alias("other"))
        near = join_unique(both, others, "peer", hubs).groupBy("node").agg(F.min("other").alias("other"))
        stepped = cut(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label")))
        # pointer jumping: the label is itself a node, and its own label is no larger
        heads = stepped.select(F.col("node").alias("label"), F.col("label").alias("head")).where("label <> head")
        jumped = join_unique(stepped, heads, "label", hot_keys(stepped, "label"), "left")
        new = cut(jumped.select("node", "old", F.least("label", F.coalesce("head", "label")).alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
