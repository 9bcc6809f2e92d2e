"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.runtime import cut, discard


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` of every node that a link (``a``, ``b``) names.

    Nodes have one label exactly if links join them, directly or through others.
    In a round every node takes the smallest label around it as its own, and the
    links are drawn anew between these labels; links inside a label go. Ids should
    be hashes: then a round leaves a fixed share of the nodes at most, whatever
    the shape, and rounds grow with the logarithm of the nodes.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct(), "links")
    read = [edges]
    labels = (
        links.select(F.col("a").alias("node"))
        .unionByName(links.select(F.col("b").alias("node")))
        .distinct()
        .withColumn("label", F.col("node"))
    )
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(
            both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")),
            "least",
        )
        labels = labels.join(least.withColumnRenamed("node", "label"), "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")
        )
        ends = [least.select(F.col("node").alias(e), F.col("to").alias(f"{e}_to")) for e in "ab"]
        drawn = edges.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
        edges = cut(
            drawn.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "links"
        )
        read += [least, edges]
    found = cut(labels, "labels")
    discard(*read)
    return found
