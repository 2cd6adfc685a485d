"""Connected components of a link table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link; the label is the least node of its component.

    A step takes the least label among a node's neighbours and then the label of
    that label, so long chains shorten by half. Two steps make a round, and the
    rounds end when the second one changes nothing. Labels stay in tables; the
    driver only learns whether a label changed.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
    edges = saved(both.distinct())

    def step(labels: DataFrame) -> DataFrame:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = new.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        return new.join(over, new["label"] == over["__n"]).select("node", "old", F.least("label", "__l").alias("label"))

    labels = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    while True:
        labels = saved(step(step(labels).select("node", "label")))
        done = labels.where("old <> label").isEmpty()
        labels = labels.select("node", "label")
        if done:
            return labels
