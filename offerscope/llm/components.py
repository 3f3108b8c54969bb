"""Connected components by least labels and pointer jumping, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of each node with an edge (u, v), the least node it can reach.

    Each round takes the least label among the neighbours, then the label of that label, so
    the number of rounds grows with the logarithm of a component's depth. No edge or label
    passes through the driver; rounds are tables in the shared folder. Joins are plain ones,
    so a node with very many edges is split by the engine's skew handling.
    """
    edges = edges.select("u", "v").filter("u <> v")
    both = written(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("l")).select("u", F.least("u", "l").alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("near"))
        step = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("far"))
        after = written(step.join(jump, "l", "left").select("u", "old", F.least("l", F.coalesce("far", "l")).alias("l")), "labels")
        labels = after.select("u", "l")
        if not after.filter("l <> old").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
