"""Connected components of an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Node, component (its smallest node). Nodes take the smallest label around them, then their label's label.

    Each round is checkpointed in ``spark.checkpoint.dir``; with the jumps the rounds grow with the logarithm of the
    longest path.
    """
    context = edges.sparkSession.sparkContext
    if not context.getCheckpointDir():  # unset, as in tests
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-"))
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")).checkpoint()
    for _ in range(most_rounds):
        near = e.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", "component", F.least("component", "c").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("component").alias("further"))
        new = step.join(jump, "best").select("node", "component", F.least("best", "further").alias("new")).checkpoint()
        moved = new.filter("new <> component").isEmpty()
        labels = new.select("node", F.col("new").alias("component"))
        if moved:
            return labels
    raise RuntimeError("components didn't settle")
