"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for the ends of ``a, b`` edges; ``comp`` is the same within a component, and one of its nodes.

    Each round sends every node to its smallest neighbour, if that is smaller,
    and contracts the edges. A node that stays has a neighbour that goes, so a
    round leaves at most half of the nodes that still have edges. Minima are
    combined before the shuffle, so a node with very many edges is no hot task.
    """
    ends = edges.where("a <> b")
    labels = materialize(ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct().withColumn("comp", F.col("node")), "labels")
    ends = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not ends.isEmpty():
        # The larger end of an edge goes to the smallest of its smaller neighbours.
        moves = materialize(ends.groupBy(F.col("b").alias("old")).agg(F.min("a").alias("new")), "moves")
        labels = materialize(labels.join(moves, labels["comp"] == moves["old"], "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels")
        first = ends.join(moves, ends["a"] == moves["old"], "left").select(F.coalesce("new", "a").alias("a"), "b")
        both = first.join(moves, first["b"] == moves["old"], "left").select("a", F.coalesce("new", "b").alias("b")).where("a <> b")
        ends = materialize(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
