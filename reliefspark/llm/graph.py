"""Connected components of a large table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.shared import forget, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all ends of ``links``: the smallest id that can be reached.

    Every round gives each node the smallest label among itself, its neighbours
    and the node that its label names (so labels also jump along chains), and the
    smallest label that a node's neighbours have also to the node that its own
    label names (so whole trees are hooked to others), until nothing changes.
    Labels are cut from their lineage through the shared folder. A node that very
    many links or labels touch is summed up before the shuffle.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.where("x <> y").union(both.where("x <> y").select("y", "x")).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    held = labels
    while True:  # labels only fall, so it ends
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("beyond"))
        low = labels.join(near, "x")
        hooks = low.groupBy(F.col("label").alias("x")).agg(F.min("near").alias("hook"))
        new = low.join(jump, "label").join(hooks, "x", "left").select("x", F.least("near", "label", "beyond", "hook").alias("new"), "label")
        new = written(new, "labels")
        moved = not new.where("new <> label").isEmpty()
        forget(held)
        labels, held = new.select("x", F.col("new").alias("label")), new
        if not moved:
            forget(both)
            return labels.select(F.col("x").alias("id"), F.col("label").alias("component"))
