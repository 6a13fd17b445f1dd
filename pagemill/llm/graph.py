"""Connected components of a link table, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node that can be reached.

    Each round takes the least label among a node's neighbours and then the label of that label, so chains shrink by
    half; rounds are written and read again. A hub's links are one row each, so a join may split them.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.save(both, f"{name}_links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{name}_0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = scratch.save(step, f"{name}_step{turn}")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = scratch.save(step.join(up, "label").select("node", "old", F.least("label", "higher").alias("label")), f"{name}_{turn}")
        scratch.drop(f"{name}_step{turn}")
        scratch.drop(f"{name}_{turn - 1}")
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels
