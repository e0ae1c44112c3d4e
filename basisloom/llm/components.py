"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in ``links`` (a long, b long); component: the smallest id reachable.

    A round gives each id the least label of its neighbours and then the label of
    its label.  Labels of a hub are a partial aggregation; the join of a hub's
    links is one that Spark may split.  Each round is a written table.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    both = scratch.write(both.where("id != other").distinct(), "links")
    least = both.groupBy("id").agg(F.min("other").alias("m"))
    labels = scratch.write(least.select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.join(labels.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left")
        jumped = scratch.write(jump.select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "labels")
        changed = not jumped.where("label != old").isEmpty()
        scratch.drop(labels)
        labels = jumped.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
