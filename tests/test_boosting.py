"""Histogram boosting against a plain re-implementation on raw values, GBTClassifier and planted classes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import boosting, ml, scratch
from cohortlens.operators.split import seeded

SCHEMA = "id long, v array<double>, label int"


def table(spark, x, y):
    return spark.createDataFrame([(i, [None if math.isnan(a) else float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], SCHEMA).repartition(3)


def plain(x, y, rounds, depth, leaves, rate, lam, alpha, gamma, bins):
    """Margins by growing each tree leaf by leaf, the best split of all leaves first, on raw values."""
    classes, n = sorted(set(y)), len(y)
    borders = [sorted(set(np.quantile(c[~np.isnan(c)], [i / bins for i in range(1, bins)]))) for c in x.T]
    m = np.tile([math.log((y == c).mean()) for c in classes], (n, 1))
    t = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
    for _ in range(rounds):
        p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
        step = np.zeros_like(m)
        for k, c in enumerate(classes):
            g, h = p[:, k] - (y == c), p[:, k] * (1 - p[:, k])

            def best(rows, level):
                out = None
                for f in range(x.shape[1]) if level < depth else ():
                    for low in [np.isnan(x[:, f]), *(~(x[:, f] > b) for b in borders[f])]:
                        a, b = rows & low, rows & ~low
                        if not a.any() or not b.any():
                            continue
                        gain = round(t(g[a].sum()) ** 2 / (h[a].sum() + lam) + t(g[b].sum()) ** 2 / (h[b].sum() + lam) - t(g[rows].sum()) ** 2 / (h[rows].sum() + lam), 9)
                        if min(h[a].sum(), h[b].sum()) >= 1e-3 and gain > gamma and (out is None or gain > out[0]):
                            out = (gain, a, b, level + 1)
                return out

            found = [(np.ones(n, bool), best(np.ones(n, bool), 0))]
            while len(found) < leaves and any(s for _, s in found):
                i = max((i for i in range(len(found)) if found[i][1]), key=lambda i: found[i][1][0])
                _, a, b, level = found.pop(i)[1]
                found += [(a, best(a, level)), (b, best(b, level))]
            if len(found) > 1:
                for rows, _ in found:
                    step[rows, k] = -rate * t(g[rows].sum()) / (h[rows].sum() + lam)
        m = m + step
    return m


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(4)
    x = g.normal(size=(160, 4)).round(2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.2)
    x[::9, 1] = np.nan
    x[:, 3] = 5
    return x, y


@pytest.mark.parametrize(("leaves", "alpha", "gamma", "every"), [(31, 0.0, 0.0, 8), (4, 0.3, 0.05, 1)])
def test_margins_are_those_of_growth_leaf_by_leaf(spark, data, monkeypatch, leaves, alpha, gamma, every):
    monkeypatch.setattr(boosting, "STATE_EVERY", every)
    monkeypatch.setattr(boosting, "PIECE", 100)
    x, y = data
    df = table(spark, x, y)
    left = set(scratch._written.get(spark.sparkContext.applicationId, []))
    model = boosting.fit(df, "v", "label", "id", rounds=3, max_depth=3, max_leaves=leaves, rate=0.3, lam=1.0, alpha=alpha, gamma=gamma, bins=8)
    assert not [p for p in scratch._written[spark.sparkContext.applicationId] if "boosting-" in p and p not in left]
    got = np.array([r.m for r in df.select("id", model.margins("v").alias("m")).orderBy("id").collect()])
    assert np.allclose(got, plain(x, y, 3, 3, leaves, 0.3, 1.0, alpha, gamma, 8), atol=1e-9)
    assert all(sum(f >= 0 for f in t.feature) < leaves for one in model.trees for t in one)
    assert 3 not in model.importance() and sum(model.importance().values()) == pytest.approx(1)


def test_ten_classes_as_good_as_one_against_the_rest(spark):
    g = np.random.default_rng(7)
    y = np.arange(800) % 10
    x = g.normal(size=(800, 5)) + np.c_[y % 2 * 4, y // 2 % 3 * 4, y // 5 * 3, y * 0, y % 3]
    df = table(spark, x, y).withColumn("label", F.col("label").cast("double")).cache()
    train, test = df.filter("id % 40 < 30"), df.filter("id % 40 >= 30")
    model = boosting.fit(train, "v", "label", "id", rounds=5, max_depth=4, max_leaves=8, rate=0.3)
    out = model.transform(test, "v")
    mine = out.filter("prediction = label").count()
    vectors = ml.vectors(train, "v")
    gbt = ml.classifier("boosting", n_classes=10, maxIter=5).fit(vectors)
    theirs = gbt.transform(ml.vectors(test, "v")).filter("prediction = label").count()
    assert mine >= theirs and mine > 150
    assert out.select(F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda a, b: a + b) - 1))).first()[0] < 1e-9


def test_samples_edges_and_names(spark, data):
    x, y = data
    df = table(spark, x, y)
    options = {"rounds": 4, "max_depth": 2, "subsample": 0.6, "colsample": 0.5, "bins": 8, "seed": 3}
    margins = lambda d: np.array([r.m for r in df.select("id", boosting.fit(d, "v", "label", "id", **options).margins("v").alias("m")).orderBy("id").collect()])
    once = margins(df)
    odd = df.withColumns({"y": F.lit("a"), "w": F.lit(1), "h": F.lit(2), "k": F.lit(None), "node.x": F.lit(1)})
    bad = spark.createDataFrame([(900, None, 1), (901, [1.0] * 4, None)], SCHEMA)
    assert np.allclose(once, margins(odd.repartition(7))) and np.allclose(once, margins(df.unionByName(bad)))
    assert not np.allclose(once, np.array([r.m for r in df.select("id", boosting.fit(df, "v", "label", "id", **{**options, "seed": 4}).margins("v").alias("m")).orderBy("id").collect()]))
    none = boosting.fit(df.filter("false"), "v", "label", "id")
    assert none.transform(df, "v").select("p", "prediction").distinct().collect() == [([], None)]
    one = boosting.fit(df.filter("label = 1"), "v", "label", "id", rounds=2)
    assert {(tuple(r.p), r.prediction) for r in one.transform(df.unionByName(bad), "v").collect()} == {((1.0,), 1)}
    weighted = df.withColumn("weight", (F.col("label") == 2).cast("int"))
    assert boosting.fit(weighted, "v", "label", "id", "weight", rounds=1).classes == [2]
    text = boosting.fit(df.withColumn("label", F.concat(F.lit("c"), "label")), "v", "label", "id", rounds=1, bins=8)
    assert text.classes == ["c0", "c1", "c2"]


def test_ordered_statistics(spark):
    rows = [(i, ["a", "b", None][min(2, i % 5)], None if i % 11 == 0 else i % 3) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, c string, y int").repartition(3)
    order = [r.id for r in df.orderBy(seeded(1, "id"), "id").collect()]
    mean, want, sums = np.mean([r[2] for r in rows if r[2] is not None]), {}, {}
    for i in order:
        _, c, y = rows[i]
        s, n = sums.get(c, (0, 0))
        want[i] = (s + 2 * mean) / (n + 2)
        sums[c] = (s, n) if y is None else (s + y, n + 1)
    got = {r.id: r.t for r in boosting.ordered_statistics(df, "c", "y", "id", "t", 1, 2.0).collect()}
    assert got == pytest.approx(want)
    new = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    told = {r.c: r.t for r in boosting.category_statistics(df, new, "c", "y", "t", 2.0).collect()}
    assert told == pytest.approx({c: (s + 2 * mean) / (n + 2) for c, (s, n) in sums.items() if c != "b"} | {"z": mean})
    assert boosting.ordered_statistics(df.filter("false"), "c", "y", "id", "t").count() == 0
