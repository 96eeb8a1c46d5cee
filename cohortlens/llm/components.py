"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge for each node: (node, smallest node of its component)."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = np.arange(len(nodes))
    u, v = at[: len(a)], at[len(a) :]
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low != high
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root, again := root[root]):
            root = again
    return nodes, nodes[root]


def thinned(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Each task replaces its edges, about ``most`` at a time, by a forest."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            x, y = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            keep = x != y
            return pa.RecordBatch.from_arrays([pa.array(y[keep]), pa.array(x[keep])], ["a", "b"])

        for batch in batches:
            held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
            n += len(batch)
            if n >= most:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return edges.select("a", "b").mapInArrow(thin, "a bigint, b bigint")


def components(edges: DataFrame, one_task: int = 1 << 20) -> DataFrame:
    """``a, b`` (longs) -> ``node, component`` (its smallest node), for all nodes with an edge.

    In each round every node takes its smallest neighbour as parent, chains are shortened, and the edges are drawn between
    the parents; at most half of the nodes are left, and the edges that stay inside a component go. What is left of at
    most ``one_task`` edges (16 MB) is finished in one task.
    """
    edges = stored(thinned(edges.filter("a <> b")), "edges")
    total = None
    while n := edges.count():
        if n <= one_task:
            tree = stored(thinned(edges.coalesce(1), most=one_task), "tree")
            step = tree.select(F.col("b").alias("node"), F.col("a").alias("parent")).unionByName(tree.select(F.col("a").alias("node"), F.col("a").alias("parent")).distinct())
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
            for _ in range(2):
                up = step.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
                step = stored(step.join(up, "parent").select("node", F.col("grand").alias("parent")), "parents")
            for end in ("a", "b"):
                edges = edges.join(step.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("parent", end)
            edges = stored(thinned(edges.select("a", "b").filter("a <> b").repartition("a")).distinct(), "edges")
        if total is None:
            total = step.select("node", F.col("parent").alias("component"))
        else:
            more = step.select(F.col("node").alias("component"), "parent")
            total = stored(total.join(more, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "components")
        if n <= one_task:
            break
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def joined_further(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` after more edges between the nodes: only the components that they touch are contracted."""
    c = found.select(F.col("node").alias("__n"), "component")
    for end in ("a", "b"):
        edges = edges.join(c, edges[end] == F.col("__n"), "left").withColumn(end, F.coalesce("component", end)).drop("__n", "component")
    step = components(edges)
    every = found.unionByName(step.select("node", F.col("node").alias("component")).join(found, "node", "left_anti"))
    return every.join(step.select(F.col("node").alias("component"), F.col("component").alias("__c")), "component", "left").select("node", F.coalesce("__c", "component").alias("component"))
