"""Connected components of a graph whose edges are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import remove, saved, scratch_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: the smallest node it is connected with.

    Rounds of three steps on a table of one label per node: a node's label moves to the smallest label among its
    neighbours, the node that the old label names is hooked below the new one, and labels are followed one step
    further. Every step is an equi-join and a ``min`` that combines before its shuffle; joins on labels, which get
    hot, read written tables on both sides, so that adaptive execution can split a hot label. Each round is written
    to the shared scratch space, and the rounds end when no label changes: a few for compact groups, about the
    logarithm of the length for chains. No edges give no rows; loops and repeated edges change nothing.
    """
    spark = edges.sparkSession
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .where("a <> b").distinct(), "edges")
    path = scratch_dir(spark, "labels")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("label")), "labels", path)
    while True:
        offered = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                   .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer")))
        step_path = scratch_dir(spark, "labels")
        step = saved(labels.join(offered, "node").select(
            "node", "label", F.least("label", "offer").alias("lower")), "labels", step_path)
        hooked = (step.where("lower < label").groupBy(F.col("label").alias("node"))
                  .agg(F.min("lower").alias("hook")))
        hooked_path = scratch_dir(spark, "labels")
        moved = saved(step.join(hooked, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("lower", F.coalesce("hook", "lower")).alias("near")),
            "labels", hooked_path)
        new_path = scratch_dir(spark, "labels")
        jumped = saved(moved.join(moved.select(F.col("node").alias("near"), F.col("near").alias("far")), "near")
                       .select("node", "old", F.col("far").alias("label")), "labels", new_path)
        changed = jumped.where("label <> old").limit(1).count()
        for done in (path, step_path, hooked_path):
            remove(spark, done)
        labels, path = jumped.select("node", "label"), new_path
        if not changed:
            return labels.select("node", F.col("label").alias("root"))
