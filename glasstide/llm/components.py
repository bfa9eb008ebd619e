"""Connected components by least-label spreading and pointer jumping, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b): label is the least node of its component. No edges: no rows.

    A round takes the least label of all neighbours, then the label's own label; rounds end when nothing changes.
    Labels are kept in the shared checkpoint folder after each round, so a lost executor costs one round at most.
    """
    both = cut(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("told"))
        spread = labels.join(told, labels["node"] == told["a"]).select("node", F.col("label").alias("old"), F.least("label", "told").alias("label"))
        target = labels.select(F.col("node").alias("at"), F.col("label").alias("jumped"))
        new = cut(spread.join(target, spread["label"] == target["at"], "left").select("node", "old", F.least("label", F.coalesce("jumped", "label")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
