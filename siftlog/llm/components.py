"""Connected components of an edge table, by least-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for each end of the edges (a long, b long): label is the least id that edges reach.

    Each round takes the least label among neighbours, then the label of the label; rounds grow as the logarithm
    of the longest path of stars. Every round is written to the shared folder, so a lost executor costs one round.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).distinct()
    both = saved(both, "component-edges")
    labels = saved(both.groupBy("v").agg(F.least(F.first("v"), F.min("u")).alias("label")), "component-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        now = saved(least.join(jump, "label").select("v", F.least("label", "next").alias("label"), (F.least("label", "next") < F.col("old")).alias("moved")), "component-labels")
        labels = now.select("v", "label")
        if not now.where("moved").limit(1).count():
            return labels
