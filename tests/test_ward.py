"""Ward linkage against brute force over all merges, and on planted groups beyond the number of leaves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ward

SCHEMA = "id long, v array<double>, cluster string, top string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(vectors)], SCHEMA)


def brute(x, share):
    """Clusters (sets of row numbers) and top height: the pair whose union adds least to the sum of squares merges first."""
    sse = lambda g: float(((x[g] - x[g].mean(0)) ** 2).sum())
    groups, steps = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        cost, a, b = min((sse(groups[i] + groups[j]) - sse(groups[i]) - sse(groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        steps.append((math.sqrt(max(2 * cost, 0)), [list(g) for g in groups]))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
    top = steps[-1][0]
    at = next((g for h, g in steps if h > share * top), groups)
    return {frozenset(g) for g in at}, top


def clusters(rows):
    return {frozenset(r.id for r in rows if r.cluster == c) for c in {r.cluster for r in rows}}


@pytest.mark.parametrize("share", [0.5, 0.15])
def test_equal_to_brute_force_where_leaves_are_rows(spark, share):
    x = np.random.default_rng(3).normal(size=(36, 3)) * [1, 3, 0.2] + np.repeat(np.eye(3) * 6, 12, 0)
    want, top = brute(x, share)
    got = ward.ward(frame(spark, x.tolist()).repartition(5), "v", share).collect()
    assert clusters(got) == want
    assert all(math.isclose(r.top, top, rel_tol=1e-9) for r in got)
    sizes = [sum(r.cluster == c for r in got) for c in range(len(want))]
    assert sizes == sorted(sizes, reverse=True)


def test_planted_groups_beyond_the_leaves(spark):
    """1,500 rows of five far groups, one of them with half of all rows, on 40 leaves; partitions change nothing."""
    r = np.random.default_rng(5)
    label = np.r_[np.full(750, 0), r.integers(1, 5, 750)]
    x = r.normal(size=(1500, 4)) + (np.arange(5)[:, None] * [30.0, -20, 10, 0] + 1e6)[label]
    df = frame(spark, x.tolist())
    one, two = (sorted((q.id, q.cluster) for q in ward.ward(df.repartition(n, *by), "v", 0.1, leaves=40).select("id", "cluster").collect()) for n, by in ((3, []), (7, ["id"])))
    assert one == two
    assert {frozenset(i for i, c in one if c == k) for k in range(5)} == {frozenset(np.flatnonzero(label == k).tolist()) for k in range(5)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[0.0, 0.0], [0.0, 0.0], [0.1, 0.0], [9.0, 9.0], None, [], [1.0], [nan, 1.0], [None, 1.0], [1.0, inf]]
    got = {r.id: r.cluster for r in ward.ward(frame(spark, rows), "v").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1} | dict.fromkeys(range(4, 10))
    same = ward.ward(frame(spark, [[2.0, 3.0]] * 5), "v").select("cluster", "top").distinct().collect()
    assert [tuple(r) for r in same] == [(0, 0.0)]
    assert ward.ward(frame(spark, []).filter(F.lit(True)), "v").count() == 0
    assert {r.cluster for r in ward.ward(frame(spark, [None, [nan]]), "v").collect()} == {None}
