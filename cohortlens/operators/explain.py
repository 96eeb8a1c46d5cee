"""Shapley values of tree models, from the trees' own node tables and in the JVM.

A leaf is a path: for each feature on it an interval of values, and the share of training rows that went the leaf's way at the
feature's splits. If only the features of a set S are known, the leaf counts with its value times, for each feature in S,
whether the row lies in the interval, and for each other feature that share. Averaged over all orders of learning features
this depends only on which features of the path the row fits, so each leaf has a table of contributions by that pattern, 2^d
for d features on its path. A row looks up one line of each leaf.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features on a path at most; its table has 2^d lines.
MOST_FEATURES = 12
LEAF = "array<struct<f: array<int>, lo: array<double>, hi: array<double>, t: array<array<double>>>>"


def trees_of(model) -> list[tuple[float, object]]:
    """(weight, tree) of an ensemble or a single tree. A forest's trees share its weight."""
    trees = getattr(model, "trees", None)
    if trees is None:
        return [(1.0, model)]
    boosted = "GBT" in type(model).__name__
    return list(zip(model.treeWeights if boosted else [1 / len(trees)] * len(trees), trees, strict=True))


def paths(tree, klass: int | None) -> Iterator[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, [(feature, above, up to, share)]) of each leaf. ``klass``: the probability of this class, else the prediction. Splits of categories are not taken."""

    def value(node) -> float:
        if klass is None:
            return float(node.prediction())
        stats = list(node.impurityStats().stats())
        return stats[klass] / (sum(stats) or 1.0)

    stack = [(tree._java_obj.rootNode(), {})]
    while stack:
        node, way = stack.pop()
        if node.subtreeDepth() == 0:
            yield value(node), [(f, *v) for f, v in sorted(way.items())]
            continue
        split = node.split()
        if not hasattr(split, "threshold") or "Categorical" in split.getClass().getSimpleName():
            raise ValueError("a split by categories has no interval")
        f, t = split.featureIndex(), split.threshold()
        every = node.impurityStats().count()
        lo, hi, share = way.get(f, (-math.inf, math.inf, 1.0))
        for child, (a, b) in ((node.leftChild(), (lo, min(hi, t))), (node.rightChild(), (max(lo, t), hi))):
            stack.append((child, way | {f: (a, b, share * child.impurityStats().count() / every)}))


def contributions(value: float, shares: list[float]) -> list[list[float]]:
    """For each pattern (bit k: the row fits feature k) the Shapley value of each feature on the path."""
    d = len(shares)
    weight = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
    out = []
    for pattern in range(1 << d):
        fits, row = [pattern >> k & 1 for k in range(d)], []
        for i in range(d):
            others, total = [k for k in range(d) if k != i], 0.0
            for s in range(d):
                for known in combinations(others, s):
                    total += weight[s] * math.prod(fits[k] if k in known else shares[k] for k in others)
            row.append(value * (fits[i] - shares[i]) * total)
        out.append(row)
    return out


def leaf_tables(model, klass: int | None = None) -> tuple[float, list[dict]]:
    """The expectation of the model without any feature, and the leaves of all trees with their tables."""
    base, out = 0.0, []
    for weight, tree in trees_of(model):
        for value, way in paths(tree, klass):
            shares = [w[3] for w in way]
            if len(way) > MOST_FEATURES:
                raise ValueError(f"a path has over {MOST_FEATURES} features")
            base += weight * value * math.prod(shares)
            if way:
                cut = lambda x: max(-1.7e308, min(1.7e308, x))
                out.append({"f": [w[0] for w in way], "lo": [cut(w[1]) for w in way], "hi": [cut(w[2]) for w in way], "t": contributions(weight * value, shares)})
    return base, out


def shapley_values(model, df: DataFrame, key: str, klass: int | None = None, features: str = "features") -> DataFrame:
    """Key, feature (its place), contribution, for features that any tree uses; with ``base`` they sum to the model's value for the row.

    That is the margin of boosted trees (before its link), the prediction of regression trees, or with ``klass`` the class's
    probability in a forest or tree. Keys are distinct. A split sends values up to its threshold to the left, NaN to the right.
    """
    base, leaves = leaf_tables(model, klass)
    x = df.select(F.col(key).alias("key"), vector_to_array(features).alias("x"))
    each = x.withColumn("leaf", F.explode(F.from_json(F.lit(json.dumps(leaves)), LEAF)))
    fits = lambda k: ((F.col("x")[F.col("leaf.f")[k]] > F.col("leaf.lo")[k]) & (F.col("x")[F.col("leaf.f")[k]] <= F.col("leaf.hi")[k])).cast("int")
    pattern = F.aggregate(F.sequence(F.lit(0), F.size("leaf.f") - 1), F.lit(0), lambda a, k: a + F.call_function("shiftleft", fits(k), k))
    told = each.withColumn("c", F.zip_with("leaf.f", F.col("leaf.t")[pattern], lambda f, v: F.struct(f.alias("f"), v.alias("v")))).select("key", F.explode("c").alias("c"))
    return told.groupBy("key", F.col("c.f").alias("feature")).agg(F.sum("c.v").alias("contribution")).select(F.col("key").alias(key), "feature", "contribution", F.lit(base).alias("base"))
