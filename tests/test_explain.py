"""Shapley values of trees against brute force over subsets, and bootstraps drawn by splitting."""

import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap, explain, metrics, ml


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(250, 5)).round(2)
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5) | (x[:, 2] + 0.3 * x[:, 3] > 1)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(250)], "id long, v array<double>, label double").coalesce(2)
    return x, df.withColumn("features", array_to_vector("v")).cache()


def known(node, x, s, klass):
    """The expectation of a tree if only the features of s are known: both ways by their share of rows at a split on another."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return float(node.prediction()) if klass is None else stats[klass] / sum(stats)
    split, left, right = node.split(), node.leftChild(), node.rightChild()
    if split.featureIndex() in s:
        return known(left if x[split.featureIndex()] <= split.threshold() else right, x, s, klass)
    a, b = left.impurityStats().count(), right.impurityStats().count()
    return (a * known(left, x, s, klass) + b * known(right, x, s, klass)) / (a + b)


def brute(model, x, klass=None):
    trees = explain.trees_of(model)
    f = {s: sum(w * known(t._java_obj.rootNode(), x, s, klass) for w, t in trees) for n in range(6) for s in combinations(range(5), n)}
    out = []
    for i in range(5):
        rest = [k for k in range(5) if k != i]
        out.append(sum(math.factorial(n) * math.factorial(4 - n) / 120 * (f[tuple(sorted((*s, i)))] - f[s]) for n in range(5) for s in combinations(rest, n)))
    return f[()], out


@pytest.mark.parametrize("kind", ["boosting", "forest", "tree", "regression", "boosted regression"])
def test_shapley_values(data, kind):
    x, df = data
    klass = 1 if kind in ("forest", "tree") else None
    if kind == "regression":
        est = DecisionTreeRegressor(maxDepth=4, minInstancesPerNode=3)
    elif kind == "boosted regression":
        est = GBTRegressor(maxIter=4, maxDepth=3)
    else:
        est = ml.classifier(kind, **({"maxIter": 4} if kind == "boosting" else {"numTrees": 4} if kind == "forest" else {}))
    model = est.fit(df)
    got, bases = defaultdict(lambda: [0.0] * 5), set()
    for r in explain.shapley_values(model, df, "id", klass).collect():
        got[r.id][r.feature] = r.contribution
        bases.add(r.base)
    base = bases.pop()
    for i in range(0, 250, 25):
        b, want = brute(model, x[i], klass)
        assert base == pytest.approx(b) and got[i] == pytest.approx(want, abs=1e-9)
    out = model.transform(df)
    value = vector_to_array("rawPrediction")[1] if kind == "boosting" else vector_to_array("probability")[1] if klass else F.col("prediction")
    for r in out.select("id", value.alias("v")).collect():
        assert base + sum(got[r.id]) == pytest.approx(r.v, abs=1e-6)


def labelled(spark, n=120):
    g = np.random.default_rng(5)
    rows = [(u, int(y), int(y if g.random() < 0.8 else 2 - y), int(y if g.random() < 0.5 else 2 - y)) for u in range(n) for y in g.integers(0, 3, 2)]
    return spark.createDataFrame(rows, "unit long, y int, pred int, other int").repartition(3)


@pytest.mark.parametrize("size", [4096, 9])
def test_resamples_by_splitting(spark, monkeypatch, size):
    """Exactly n units in every resample, with the moments of drawing with replacement; the interval is that of exact draws."""
    monkeypatch.setattr(bootstrap, "SLICE", size)
    ones = spark.range(60).select(F.col("id").alias("unit"), F.col("id").cast("int").alias("y"), F.lit(0).alias("pred")).repartition(4)
    got = bootstrap.split_counts(ones, "unit", "y", "pred", 2000, 3).collect()
    w = np.zeros((2000, 60))
    for r in got:
        w[r.b, r.y] += r.n
    assert (w.sum(1) == 60).all()
    assert np.abs(w.mean(0) - 1).max() < 0.12 and abs(w.var(0).mean() - 59 / 60) < 0.04
    c = np.cov(w.T)
    assert abs(c[~np.eye(60, dtype=bool)].mean() + 1 / 60) < 0.004
    df = labelled(spark)
    a, b = (bootstrap.metric_interval(df, "unit", "y", "pred", "accuracy", 600, how=h).first() for h in ("exact", "split"))
    assert abs(a.mean - b.mean) < 0.01 and abs(a.lo - b.lo) < 0.02 and abs(a.hi - b.hi) < 0.02
    again = bootstrap.split_counts(df.repartition(7), "unit", "y", "pred", 50, 3)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(again) == key(bootstrap.split_counts(df, "unit", "y", "pred", 50, 3))


def test_paired_resamples_by_splitting(spark):
    df = labelled(spark)
    first, second = df.select("unit", "y", "pred"), df.select("unit", "y", F.col("other").alias("pred"))
    same = bootstrap.paired_difference(first, first, "unit", "y", "pred", "accuracy", 40, how="split").first()
    assert (same.mean, same.lo, same.hi, same.distinguishable) == (0, 0, 0, False)
    got = bootstrap.paired_difference(first, second, "unit", "y", "pred", "accuracy", 400, how="split").first()
    assert got.distinguishable and 0.15 < got.mean < 0.45 and got.p < 0.05
    none = bootstrap.split_counts(first.filter("false"), "unit", "y", "pred", 10)
    assert none.count() == 0 and metrics.classification(none, ["b"]).count() == 0
