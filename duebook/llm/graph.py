"""Connected components over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` for every end of an edge ``a, b``: the least id of its component.

    Each step takes the least label of the neighbours, hands it to the vertex that the old label names, and takes the label of the label. So whole
    groups move at once and chains close in logarithmically many steps. It ends when a step changes nothing: then all neighbours agree.
    Labels stay in tables; the driver sees whether any changed.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = materialise(labels.join(seen, labels["id"] == seen["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")),
                             "nearer")
        hooks = nearer.where("label < old").groupBy(F.col("old").alias("root")).agg(F.min("label").alias("hook"))
        hooked = materialise(nearer.join(hooks, nearer["id"] == hooks["root"], "left").select("id", "old", F.least("label", "hook").alias("label")), "hooked")
        target = hooked.select(F.col("id").alias("to"), F.col("label").alias("far"))
        labels = materialise(hooked.join(target, F.col("label") == F.col("to")).select("id", "old", F.least("label", "far").alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("id", "label")
        labels = labels.drop("old")
