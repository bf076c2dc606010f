"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.sources.scratch import written


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from every id that (a, b) links name.

    Every round takes the least label among neighbours and then the label of that label,
    so chains halve; rounds end when nothing changes. Each round is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "label")
        least = near.union(labels).groupBy("id").agg(F.min("label").alias("least"))
        target = labels.select(F.col("id").alias("least"), F.col("label").alias("_jump"))
        jumped = least.join(target, "least").select("id", F.least("least", "_jump").alias("label"))
        old = labels.select("id", F.col("label").alias("_old"))
        # One written table holds the new labels and whether they changed.
        new = written(jumped.join(old, "id").select("id", "label", (F.col("label") != F.col("_old")).alias("moved")), "labels")
        labels = new.select("id", "label")
        if new.where("moved").isEmpty():
            return labels
