"""Connected components by DataFrame rounds; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (smallest node reached) of every node of ``edges``.

    Each round takes the least label among a node's neighbours and then jumps
    to that label's own label, so long chains shorten quickly. The aggregates
    combine before the shuffle, so a node with very many edges is no hot task.
    """
    both = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        nearer = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "m").alias("near"), F.col("component").alias("before"))
        # The label of the label as it stood before this round: an older one can only be larger.
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("further"))
        labels = cut(nearer.join(jump, "near").select("node", F.least("near", "further").alias("component"), (F.least("near", "further") != F.col("before")).alias("moved")))
        settled = labels.filter("moved").isEmpty()
        labels = labels.select("node", "component")
        if settled:
            return labels
