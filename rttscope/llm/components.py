"""Connected components of a link table by label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope.session import materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``: ``root`` is the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours (partial minima before the
    shuffle) and then follows the label's own label, so chains shorten by halves.  Every round is
    written, which cuts lineage.
    """
    pair = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialise(pair.union(pair.select(F.col("v"), F.col("u"))).distinct(), "links")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        lower = materialise(lower, "labels")
        jump = lower.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        labels = materialise(lower.join(jump, "mid").select("node", "was", F.least("mid", "far").alias("root")), "labels")
        if labels.where("root <> was").isEmpty():
            return labels.select("node", "root")
