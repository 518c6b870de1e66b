"""Connected components of an edge table by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node of the component.

    Each round every node takes the least label among its neighbours and then its label's label, so
    chains halve. Rounds end when no label changes. State is checkpointed each round; no edge or label
    goes to the driver.
    """
    both = checkpointed(edges.where("a != b").select("a", "b").unionAll(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("further"))
        new = checkpointed(near.join(jump, "near", "left").select("node", F.coalesce(F.least("near", "further"), "near").alias("label"), F.col("label").alias("old")))
        if new.where("label != old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
