"""Quantiles by rank refinement and information from nearest neighbours, against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clean, order, profile, quantiles


def percentile(v, shares):
    return [float(np.quantile(v, s)) for s in shares]


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles_are_those_of_percentile(spark, monkeypatch, few):
    """Ties, magnitudes from 1e-250 to 1e250, one value, signs, infinities; narrowed to the end or read off early."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 16 if few == 3 else 4096)
    g = np.random.default_rng(few)
    n = 500
    columns = {"a": g.normal(size=n), "b": g.integers(0, 3, n).astype(float), "c": np.exp(g.uniform(-575, 575, n)) * g.choice([-1, 1], n), "d": np.full(n, 7.0), "e": np.r_[np.full(n - 3, 2.0), 1e-300, -5.0, np.inf]}
    rows = [(int(i % 3) if i % 7 else None, *(None if (i + k) % 11 == 0 else float(v[i]) for k, v in enumerate(columns.values())), None, math.nan) for i in range(n)]
    df = spark.createDataFrame(rows, "grp int, a double, b double, c double, d double, e double, f double, g double").repartition(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = {r.column_name: r.q for r in quantiles.quantiles(df, [*columns, "f", "g"], shares).collect()}
    assert set(got) == set(columns)
    spark_own = df.agg(*[F.percentile(c, F.array(*[F.lit(s) for s in shares])).alias(c) for c in "abcd"]).first()
    for c in "abcd":
        assert got[c] == pytest.approx(spark_own[c], rel=1e-12)
    held = sorted(r[5] for r in rows if r[5] is not None)
    assert got["e"][:1] == [held[0]] and got["e"][3] == 2.0
    by = quantiles.quantiles(df, ["a", "b"], [0.25, 0.5], ["grp"]).collect()
    assert len(by) == 8
    for r in by:
        k = {"a": 1, "b": 2}[r.column_name]
        assert r.q == pytest.approx(percentile([x[k] for x in rows if x[0] == r.grp and x[k] is not None], [0.25, 0.5]), rel=1e-12)
    assert quantiles.quantiles(df.filter("false"), ["a"], [0.5]).count() == 0


def test_fits_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (3.0, None, None)], "a double, b double, t string")
    p = clean.FitParams().fit_fills(df, ["a", "b"], ["t"])
    assert p.fills == {"a": 2.0, "b": None, "t": "x"}
    assert set(p.fit_bounds(df, ["a", "b"]).bounds) == {"a"} and set(p.fit_scales(df, ["a", "b"], robust=True).scales) == {"a"}
    told = {r.column_name: r for r in profile.describe(df, ["a", "b"]).collect()}
    assert told["a"].q50 == 2.0 and told["b"].q50 is None and told["b"].non_null == 0


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def information(x, y, k):
    """Brute force, with the counts of every pair."""
    keep = [i for i in range(len(x)) if sum(b == y[i] for b in y) > 1]
    terms = []
    for i in keep:
        near = sorted(abs(x[j] - x[i]) for j in keep if j != i and y[j] == y[i])
        kk = min(k, len(near))
        r = near[kk - 1]
        m = sum((x[i] - r < x[j] < x[i] + r) if r > 0 else x[j] == x[i] for j in keep)
        terms.append((psi(kk), psi(len(near) + 1), psi(m)))
    t = np.mean(terms, axis=0)
    return max(0.0, psi(len(keep)) + t[0] - t[1] - t[2])


@pytest.mark.parametrize("run", [4096, 5])
def test_information_of_neighbours(spark, monkeypatch, run):
    monkeypatch.setattr(clean, "RUN", run)
    monkeypatch.setattr(order, "ROWS", 9)
    g = np.random.default_rng(run)
    y = [*g.integers(0, 3, 120).tolist(), 8, 8, 9]  # a class with fewer rows than k, one with a single row
    told, ties, noise = [v + float(n) for v, n in zip(y, g.normal(scale=0.1, size=123), strict=True)], [float(v) for v in g.integers(0, 4, 123)], g.normal(size=123).tolist()
    df = spark.createDataFrame([(i, y[i], told[i], ties[i], noise[i]) for i in range(123)] + [(500, None, 1.0, 1.0, 1.0), (501, 1, None, math.nan, None)], "id long, y int, told double, ties double, noise double").repartition(3)
    got = {r.feature: r.mi for r in clean.neighbour_information(df, ["told", "ties", "noise"], "y", "id", 3).collect()}
    for f, x in (("told", told), ("ties", ties), ("noise", noise)):
        assert got[f] == pytest.approx(information(x, y, 3), abs=1e-9)
    assert got["told"] > 0.8 > 0.3 > got["noise"]
