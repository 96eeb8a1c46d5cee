"""Cluster bootstrap: units are drawn with replacement, all resamples in one pass.

A unit's weight in resample b comes from a hash: in ``exact`` mode n draws hit ranks md5(b | i) mod n, so a resample has
exactly n draws; in ``poisson`` mode each unit has an independent Poisson(1) weight, which needs no ranks and no second
table; in ``split`` mode the n draws of a resample are dealt to slices of the units by binomials, then within a slice to its
units, so a resample has exactly n draws and no table of draws exists. Rows never cross resamples in a shuffle: each task adds
up confusion counts per resample first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import classification
from .order import numbered

#: Units of a slice in ``split`` mode.
SLICE = 4096


def draws(units: DataFrame, unit: str, n_resamples: int, seed: int = 0) -> DataFrame:
    """Exact mode: b, unit, weight. Rank r of n is drawn by md5(seed|b|i) mod n for i < n: n_resamples * n draws in all; for many units take the Poisson mode."""
    u = units.select(unit).distinct()
    n = u.count()
    ranked = numbered(u, unit, "rank")
    spark = units.sparkSession
    grid = spark.range(n_resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("i"))
    rank = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1)))
    return grid.select("b", rank.alias("rank")).groupBy("b", "rank").agg(F.count(F.lit(1)).alias("weight")).join(ranked, "rank").select("b", unit, "weight")


def exact_counts(rows: DataFrame, unit: str, y: str, pred: str, n_resamples: int, seed: int = 0) -> DataFrame:
    """b, y, pred, n: confusion counts of each resample. Rows are added up per unit before they meet the draws."""
    per_unit = rows.groupBy(unit, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("k"))
    return draws(rows, unit, n_resamples, seed).join(per_unit, unit).groupBy("b", "y", "pred").agg(F.sum(F.col("weight") * F.col("k")).alias("n"))


def poisson_weight(seed: int, b: Column, unit: Column) -> Column:
    """A Poisson(1) number for each resample and unit: how many of its cumulative probabilities a uniform hash exceeds."""
    u = F.pmod(F.xxhash64(F.lit(seed), b, unit), F.lit(1 << 52)) / float(1 << 52)
    out, upto = F.lit(0), 0.0
    for k in range(16):
        upto += math.exp(-1) / math.factorial(k)
        out = out + (u >= upto).cast("int")
    return out


def poisson_counts(rows: DataFrame, unit: str, y: str, pred: str, n_classes: int, n_resamples: int, seed: int = 0) -> DataFrame:
    """The same with Poisson(1) weights; classes from 0 to ``n_classes`` - 1, others are left out."""
    inside = F.col(y).between(0, n_classes - 1) & F.col(pred).between(0, n_classes - 1)
    per_unit = rows.filter(inside).groupBy(F.xxhash64(unit).alias("u"), F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("k"))
    each = per_unit.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_resamples - 1).cast("long"))))
    n = F.col("k") * poisson_weight(seed, F.col("b"), F.col("u"))
    return each.groupBy("b", "y", "pred").agg(F.sum(n).alias("n")).filter("n > 0")


def dealt(n_resamples: int, sizes: np.ndarray, place: int, seed: int) -> np.ndarray:
    """How many of each resample's draws (as many as there are units) fall to one slice: halves of the slices share by binomials down to it.

    Every task that comes through a half draws the same numbers for it, so the slices add up.
    """
    upto = np.r_[0, np.cumsum(sizes)]
    lo, hi, n = 0, len(sizes), np.full(n_resamples, upto[-1])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).binomial(n, (upto[mid] - upto[lo]) / max(1, upto[hi] - upto[lo]))
        lo, hi, n = (lo, mid, left) if place < mid else (mid, hi, n - left)
    return n


def split_counts(rows: DataFrame, unit: str, y: str, pred: str, n_resamples: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """b, ``by``, y, pred, n as ``exact_counts`` has them, drawn by splitting: work and shuffle grow with the slices (``SLICE`` units each), not with resamples times units.

    ``by``: columns, of a model for instance, whose counts come from the same draws. Rows without a unit are left out.
    """
    cells = [*by, "y", "pred"]
    per_unit = rows.filter(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit"), *by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("k"))
    n = rows.select(unit).distinct().count()
    slices = max(1, -(-n // SLICE))
    per_unit = per_unit.withColumn("slice", F.pmod(F.xxhash64("unit"), F.lit(slices)).cast("int"))
    sizes = np.zeros(slices, np.int64)
    for r in per_unit.select("slice", "unit").distinct().groupBy("slice").count().collect():  # 8 bytes for each slice
        sizes[r.slice] = r["count"]
    kinds = dict(per_unit.dtypes)
    schema = ", ".join(["b bigint", *[f"`{c}` {kinds[c]}" for c in cells], "n bigint"])

    def draw(t: pa.Table) -> pa.Table:
        place = t["slice"][0].as_py()
        t = t.sort_by([(c, "ascending") for c in ("unit", *cells)])
        units = t["unit"].combine_chunks().dictionary_encode()
        u, m = units.indices.to_numpy(), len(units.dictionary)
        cell = t.select(cells).append_column("at", pa.array(np.arange(len(t)))).group_by(cells).aggregate([("at", "list")])
        counts = np.zeros((m, len(cell)))
        for c, at in enumerate(cell["at_list"].to_pylist()):
            counts[u[at], c] = t["k"].to_numpy()[at]
        falls, rng, out = dealt(n_resamples, sizes, place, seed), np.random.default_rng([seed, place]), []
        for s in range(0, n_resamples, 64):
            out.append(rng.multinomial(falls[s : s + 64], np.full(m, 1 / m)) @ counts)
        total = np.concatenate(out) if out else np.zeros((0, len(cell)))
        b, c = np.nonzero(total)
        return pa.table({"b": pa.array(b), **{k: cell[k].take(pa.array(c)) for k in cells}, "n": pa.array(total[b, c].astype(np.int64))})

    return per_unit.groupBy("slice").applyInArrow(draw, schema).groupBy("b", *cells).agg(F.sum("n").alias("n"))


def interval(values: DataFrame, column: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval over resamples; undefined ones (NULL) are left out."""
    q = F.percentile(F.col(column), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return values.groupBy(*by).agg(q.alias("q"), F.avg(column).alias("mean")).select(*by, "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def metric_interval(rows: DataFrame, unit: str, y: str, pred: str, metric: str = "macro_f1", n_resamples: int = 1000, seed: int = 0, how: str = "exact") -> DataFrame:
    """Interval of a metric of ``classification`` under resampling of units; ``how``: exact or split."""
    counts = {"exact": exact_counts, "split": split_counts}[how](rows, unit, y, pred, n_resamples, seed)
    return interval(classification(counts, ["b"]), metric)


def paired_difference(a: DataFrame, b: DataFrame, unit: str, y: str, pred: str, metric: str = "macro_f1", n_resamples: int = 1000, seed: int = 0, how: str = "exact") -> DataFrame:
    """Difference a - b over the same resamples: interval, two-sided p, and whether 0 is outside the interval. Units of both only."""
    both = a.select(unit).intersect(b.select(unit))
    if how == "split":
        tagged = [x.join(both, unit, "left_semi").select(unit, F.col(y).alias("y"), F.col(pred).alias("pred"), F.lit(name).alias("model")) for x, name in ((a, "va"), (b, "vb"))]
        m = classification(split_counts(tagged[0].unionByName(tagged[1]), unit, "y", "pred", n_resamples, seed, ["model"]), ["b", "model"])
        pairs = m.groupBy("b").pivot("model", ["va", "vb"]).agg(F.first(metric))
    else:
        one = lambda x, name: classification(exact_counts(x.join(both, unit, "left_semi"), unit, y, pred, n_resamples, seed), ["b"]).select("b", F.col(metric).alias(name))
        pairs = one(a, "va").join(one(b, "vb"), "b")
    d = pairs.withColumn("d", F.col("va") - F.col("vb"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))))
    x = d.agg(F.avg("d").alias("mean"), q.alias("q"), p.alias("p"))
    return x.select("mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "p", ((F.col("q")[0] > 0) | (F.col("q")[1] < 0)).alias("distinguishable"))
