"""Reachability, garbage collection and ancestry over edge tables.

Frontiers advance one distributed join a level and are checkpointed in the folder of spark.checkpoint.dir, so plans stay
short and no node set reaches the driver.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that spark.checkpoint.dir names; a folder of our own only where it is unset and the master is local."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="brindle-graph-"))
    return df.checkpoint()


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes reachable from roots (node) along edges (src, dst), roots included, with the least depth.

    Edges are written once, dealt by their source; each level writes its own nodes alone, and the levels are joined at the end.
    """
    edges = cut(edges.select("src", "dst").distinct().repartition("src"))
    levels = [cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))]
    while True:
        step = levels[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        for level in levels:
            step = step.join(level.select("node"), "node", "left_anti")
        step = cut(step.withColumn("depth", F.lit(len(levels))))
        if step.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(step)


def closure_or_missing(roots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """reachable() with whether each node is there; a closure is complete if none is missing."""
    there = nodes.select("node").distinct().withColumn("_there", F.lit(True))
    return reachable(roots, edges).join(there, "node", "left").select("node", "depth", F.coalesce("_there", F.lit(False)).alias("there"))


def unreachable(nodes: DataFrame, pins: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no pin reaches."""
    return nodes.join(reachable(pins, edges).select("node"), "node", "left_anti")


def ancestry(parents: DataFrame, most_depth: int) -> DataFrame:
    """How the walk up from each node ends; parents has node and parent.

    state is depth once more than most_depth nodes are met, root where no parent follows, cycle where a node (at) is met again; steps counts the nodes
    met. Every node that walks into a cycle is reported.
    """
    up = cut(parents.select(F.col("node").alias("_node"), F.col("parent").alias("next")).where("next is not null").repartition("_node"))
    walk = cut(parents.select(F.col("node").alias("start"), F.col("parent").alias("at"), F.array("node").alias("seen")))
    done: list[DataFrame] = []
    while True:
        state = F.when(F.size("seen") > most_depth, "depth").when(F.col("at").isNull(), "root").when(F.array_contains("seen", F.col("at")), "cycle")
        walk = walk.withColumn("state", state)
        done.append(walk.where("state is not null").select(F.col("start").alias("node"), "state", F.size("seen").alias("steps"), "at"))
        on = walk.where("state is null").join(up, F.col("at") == F.col("_node"), "left")
        walk = cut(on.select("start", F.col("next").alias("at"), F.concat("seen", F.array("at")).alias("seen")))
        if walk.isEmpty():
            return reduce(DataFrame.unionByName, done)
