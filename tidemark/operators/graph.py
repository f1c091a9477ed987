"""Connected components of an edge list, the Spark way: joins and minimums until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, release


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges(a, b)`` and ``nodes(id)`` -> ``(id, component)``, the smallest id of each component.

    Each round takes the smallest label among neighbours and then follows labels to their own
    label, so long chains shrink geometrically; rounds go on until nothing changes.  The minimum combines map-side, so a hub with
    very many edges does not land in one task.  Labels are checkpointed every round, and a round's table goes when
    the next is written; only one number per round reaches the driver.  Nodes without edges leave the rounds at once.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = cut_lineage(both)
    table = cut_lineage(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    labels = table
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("_c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_c").alias("_near"))
        step = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("_near", "component")).alias("_n"), F.col("component").alias("_old"))
        hop = labels.select(F.col("id").alias("_n"), F.col("component").alias("_hop"))
        step = cut_lineage(step.join(hop, "_n").select("id", F.least("_n", "_hop").alias("component"), "_old"))
        changed = step.filter("component <> _old").limit(1).count()
        release(table)
        table, labels = step, step.select("id", "component")
        if not changed:
            release(both)
            return nodes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
