"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): nodes have one label exactly if a path joins them.

    Labels are the smallest node reached. Each round takes the smallest label among the neighbours, then the label of
    that label, so long chains shrink by more than half; rounds end when nothing changes. Every step is an aggregation
    or a join by node, and the rounds' tables are written to the scratch folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(lower.join(jump, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")), "labels")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
