"""Connected components of an edge table by minimum-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Each round takes the least label among a node's neighbours and then follows the
    label's own label, so chains shorten by doubling. Labels live in shared scratch
    tables; hubs are safe since minima are pre-aggregated before each shuffle. Null
    ends and self-loops are ignored. An empty edge table gives an empty result.
    """
    kept = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = scratch.save(
        kept.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        .union(kept.select(F.col(b).alias("src"), F.col(a).alias("dst")))
        .distinct(),
        "cc-edges",
    )
    labels = scratch.save(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "cc-labels")
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "src"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        spread = labels.join(heard, "node").select("node", F.least("component", "heard").alias("near"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        moved = spread.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("component"), "was")
        result = scratch.save(moved, "cc-labels")
        labels = result.select("node", "component")
        if result.where(F.col("component") != F.col("was")).isEmpty():
            scratch.drop("cc-edges")
            return labels
