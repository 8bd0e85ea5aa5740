"""Connected components of an edge table, by contraction rounds on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node of ``edges`` (a, b).

    In a round every node goes over to its smallest neighbour, if that is smaller, and edges
    between nodes that came together vanish; chains halve and stars collapse at once. Minima are
    taken before the shuffle, so a node with very many neighbours is no hot key. Null ends and
    self loops are left out; an empty table gives none.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    edges = materialize(edges, "edges")
    labels = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        step = materialize(step.withColumnRenamed("a", "node"), "step")
        if labels is None:
            labels = step.withColumnRenamed("to", "label")
        else:
            moved = step.withColumnsRenamed({"node": "label"})
            labels = labels.join(moved, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label"))
            labels = materialize(labels, "labels")
        a = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = edges.join(a, "a").join(b, "b").where("to_a <> to_b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges = materialize(edges, "edges")
        if edges.isEmpty():
            return labels
