"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberbasin.llm.common import stored

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of an edge list (a, b).

    Each round a node takes the smallest label among its neighbours, which is combined before the shuffle,
    and then its label's label, so a chain halves. Rounds are written to the shared folder. No edges give no rows.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(ROUNDS):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "node")
        )
        own = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        parents = own.select(F.col("node").alias("label"), F.col("label").alias("up"))
        fresh = stored(own.join(parents, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        done = fresh.filter("label <> was").isEmpty()
        labels = fresh.select("node", "label")
        if done:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"no end after {ROUNDS} rounds")
