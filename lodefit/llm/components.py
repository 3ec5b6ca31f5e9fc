"""Connected components of an edge table, by the smallest node that can be reached.

Each round takes the smallest label among a node's neighbours, then the label of
that label, so chains shorten by halves. Nothing is collected but a count and the
hot nodes, whose edges are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefit.functions.shared import written
from lodefit.functions.skew import hot_keys, split_join


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), undirected, nulls and loops allowed -> node, label for every node of an edge.

    label is the smallest node of the component. No edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumnRenamed("a", "node"))
    hubs = hot_keys(both, "node")
    labels = written(both.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = split_join(both, labels, "node", ["b"], hot=hubs).select(F.col("b").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        least = written(near.unionByName(labels.withColumn("old", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")))
        to = least.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = written(split_join(least, to, "label", ["node"]).select("node", F.least("label", "far").alias("label"), "old"))
        labels = jumped.select("node", "label")
        if not jumped.where("label <> old").limit(1).count():
            return labels
