"""Kernel maps against exact kernels, local surrogates against planted and plain fits."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import kernels, ml, surrogates


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(a) for a in v], float(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, label double").repartition(3)


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_error_of_the_maps(kind):
    x = np.random.default_rng(1).normal(size=(60, 6)) / 6**0.5
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2)) if kind == "rbf" else (0.5 * x @ x.T + 1) ** 3
    error = []
    for size in (64, 1024):
        z = [kernels.Kernel(kind, 0.5, size, seed=s).map(6)(x) for s in range(8)]
        error.append(np.mean([np.sqrt(((a @ a.T - exact) ** 2).mean()) for a in z]))
    # The error falls with the root of the size; for rbf it is at most 1 / sqrt(size) at each pair.
    assert error[1] < error[0] / 2.5 and error[1] < (1 / 1024**0.5 if kind == "rbf" else 0.15)
    assert z[0].shape == (60, 1024)


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_rings(spark, kind):
    """Rings that no line separates."""
    g = np.random.default_rng(2)
    y = np.arange(200) % 2
    a, r = g.uniform(0, 2 * np.pi, 200), 1 + y * 1.5 + g.normal(size=200) * 0.1
    df = ml.vectors(table(spark, np.c_[r * np.cos(a), r * np.sin(a)], y), "v").coalesce(1).cache()
    line = ml.classifier("svm", 200, maxIter=5).fit(df).transform(df).filter("prediction = label").count()
    k = kernels.Kernel(kind, kernels.gamma_by_scale(df), 128, degree=2)
    mapped = k.apply(df.drop("features"), "v").cache()
    ring = ml.classifier("svm", 200, C=10.0, maxIter=12).fit(mapped).transform(mapped).filter("prediction = label").count()
    assert ring >= 196 and line < 150
    x = np.array([r.v for r in df.orderBy("id").collect()])
    assert kernels.gamma_by_scale(df) == pytest.approx(1 / (2 * x.var()))
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [1.0, 2.0])], "id long, v array<double>")
    assert [r.features is None for r in k.apply(odd, "v").orderBy("id").collect()] == [True, True, False]
    assert k.apply(odd.filter("false"), "v").count() == 0


def test_surrogates_recover_a_linear_model(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(150, 3)) * [1, 5, 0] + [0, 0, 2]
    df = ml.vectors(table(spark, x, (x[:, 0] > x[:, 1] / 5).astype(float)), "v").cache()
    m = ml.classifier("logistic", 150, maxIter=20).fit(df)
    few = df.filter("id % 30 = 0")
    margin = vector_to_array("rawPrediction")[1]
    got = surrogates.local_surrogates(m, few.withColumn("h", F.lit("x")), df, "id", margin, samples=60, alpha=1e-9).collect()
    sd, want = x.std(0, ddof=1), np.array(m.coefficients)
    assert len(got) == 15
    for r in got:
        assert r.weight == pytest.approx(want[r.feature] * sd[r.feature], abs=1e-5) and r.r2 == pytest.approx(1)
        assert r.intercept == pytest.approx(float(x[r.id] @ want + m.intercept), abs=1e-5)


def test_surrogates_are_the_weighted_ridge(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(80, 2))
    df = ml.vectors(table(spark, x, (x[:, 0] * x[:, 1] > 0).astype(float)), "v").cache()
    m = ml.classifier("naive_bayes").fit(df)
    few, p = df.filter("id < 3"), vector_to_array("probability")[1]
    ask = lambda d: {(r.id, r.feature): (r.weight, r.intercept, r.r2) for r in surrogates.local_surrogates(m, d, df, "id", p, 50, width=1.0, alpha=0.5, seed=9).collect()}
    got, sd = ask(few), x.std(0, ddof=1)
    hashes = {r.id: r.h for r in few.select("id", F.xxhash64("id").alias("h")).collect()}
    for i, h in hashes.items():
        u = surrogates.noise(h, 50, sd, 9)
        z = ml.vectors(spark.createDataFrame([(j, [float(a) for a in r]) for j, r in enumerate(x[i] + u * sd)], "id long, v array<double>"), "v")
        v = np.array([r.p for r in m.transform(z).orderBy("id").select(p.alias("p")).collect()])
        w = np.exp(-(u**2).sum(1) / 2)
        a = np.r_[np.c_[u, np.ones(50)] * np.sqrt(w / w.sum())[:, None], [[0.1, 0, 0], [0, 0.1, 0]]]  # 0.5 / 50 = 0.1²
        want = np.linalg.lstsq(a, np.r_[v * np.sqrt(w / w.sum()), 0, 0], rcond=None)[0]
        assert [got[i, 0][0], got[i, 1][0], got[i, 0][1]] == pytest.approx(want.tolist(), abs=1e-8)
    again = ask(few.repartition(5))
    assert set(again) == set(got) and all(again[k] == pytest.approx(got[k]) for k in got)
    assert ask(few.filter("false")) == {}
    null = few.unionByName(few.limit(1).withColumn("id", F.lit(999).cast("long")).withColumn("features", F.when(F.col("id") < 0, F.col("features"))))
    assert set(ask(null)) == set(got)
