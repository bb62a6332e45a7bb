"""Connected components by hooking and contraction, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge, label the least node that it reaches.

    Each pass hooks every node to its least neighbour if that is less, follows the pointers to their roots by
    doubling, and contracts the edges to edges between roots; at least half of the nodes that still have
    edges vanish in a pass. Self-loops and repeated edges are harmless; rows with a null end are ignored.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "cc-parent")
        parent = to_roots(parent)
        labels = parent if labels is None else materialize(followed(labels, parent), "cc-labels")
        at = lambda end: parent.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        edges = edges.join(at("a"), "a").join(at("b"), "b").where("a_label <> b_label")
        edges = materialize(edges.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "cc-edges")
        if edges.isEmpty():
            return labels


def followed(labels: DataFrame, parent: DataFrame) -> DataFrame:
    """Labels replaced by their own labels, where they have one."""
    step = parent.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return labels.join(step, "label", "left").select("node", F.coalesce("further", "label").alias("label"))


def to_roots(parent: DataFrame) -> DataFrame:
    """Pointers to lesser nodes, followed to their ends by doubling."""
    while True:
        further = materialize(followed(parent, parent), "cc-parent")
        moved = further.where("label <> node").join(parent.where("label = node").select(F.col("node").alias("label")), "label", "left_anti")
        parent = further
        if moved.isEmpty():
            return parent
