"""Connected components of an edge table, without a node's edges ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm._common import stage


def _root(parent: DataFrame) -> DataFrame:
    """Follow parents to the end by doubling: each round halves the way."""
    while True:
        up = parent.select(F.col("node").alias("p"), F.col("parent").alias("pp"))
        moved = parent.withColumnRenamed("parent", "p").join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("parent"), (F.coalesce("pp", "p") != F.col("p")).alias("moved"))
        moved = stage(moved, "roots")
        parent = moved.select("node", "parent")
        if moved.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (columns ``a, b``); ``comp`` is some node of the component.

    Each round joins every node to its least neighbour, follows these to their roots, and keeps
    only edges between different roots; a round at least halves the nodes that still have edges.
    Minima are formed before the shuffle, and relabelling joins the edges with one row per node,
    so a node with very many edges is a skewed join that Spark splits, not a group in one task.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent"))
        root = _root(stage(parent, "parents"))
        found = root.withColumnRenamed("parent", "comp") if found is None else relabel(found, root, "comp")
        edges = relabel(relabel(edges, root, "a"), root, "b").where("a <> b").distinct()
        edges = stage(edges, "edges")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def relabel(df: DataFrame, root: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its parent in ``root``, where it has one."""
    names = df.columns
    up = root.select(F.col("node").alias(column), F.col(root.columns[1]).alias("__up"))
    return df.join(up, column, "left").withColumn(column, F.coalesce("__up", column)).select(*names)
