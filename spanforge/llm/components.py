"""Connected components by joins: smallest labels of neighbours, then labels of labels, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanforge.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); the label is the smallest node of its component.

    Every round is written to the shared folder, so its lineage is short and lost executors cost one round at most. A node of many
    edges is aggregated before the shuffle, and joins on a label that many nodes have are split by Spark.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        hooked = cut(labels.join(near, "node").select("node", F.col("label").alias("_was"), F.least("label", "_near").alias("label")), "hooked")
        upper = hooked.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        found = cut(hooked.join(upper, "label").select("node", "_was", F.col("_up").alias("label")), "labels")
        labels = found.select("node", "label")
        if found.where("label <> _was").isEmpty():
            return labels
