"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of `edges` (a, b: long): label is the smallest vertex of its component.

    Labels spread to neighbours and jump to the label of their label, so rounds grow with the logarithm of a component's
    width. Each round is written to the shared folder; only the number of changed rows reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = labels.join(near, "v").join(far, "label").select("v", F.col("label").alias("old"), F.least("label", "near", "far").alias("label"))
        step = materialise(step, "labels")
        if step.where("label <> old").isEmpty():
            return step.select("v", "label")
        labels = step.select("v", "label")
