"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b): comp is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so labels
    travel twice as far each time. Nothing is collected but the number of changes; every round is checkpointed.
    """
    both = checkpointed(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .filter("src != dst")
        .distinct()
    )
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        pulled = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = pulled.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        moved = checkpointed(pulled.join(jump, "comp").select("node", F.col("over").alias("comp"), (F.col("over") != F.col("was")).alias("changed")))
        labels = moved.select("node", "comp")
        if not moved.filter("changed").head(1):
            return labels
