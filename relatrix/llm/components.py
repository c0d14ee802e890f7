"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is the smallest node of the component. Nodes without an edge are not listed.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so the number
    of rounds is logarithmic for the stars and chains met here. A round is one written table whose predecessor is
    deleted; the driver sees one sum a round, taken while the table is written.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        seen = Observation()
        new = step.join(up, "label").select("node", "old", F.least("label", "up").alias("label"))
        new = stored(new.observe(seen, F.sum((F.col("label") != F.col("old")).cast("long")).alias("n")).select("node", "label"))
        discard(labels)
        labels = new
        if not seen.get["n"]:
            discard(both)
            return labels
