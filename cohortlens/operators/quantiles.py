"""Exact quantiles by rank refinement: no task sees a whole column.

Each wanted rank lies in an interval of values. A pass counts the values of all open intervals by bin, and each rank moves to
the bin that holds it, whose own smallest and largest value are the next interval; bins are equal in width or, every second
time, in magnitude, so that no distribution slows it down. When an interval holds few values, or one, the rank is read off.
All columns and groups are refined together; a task sends one row for each bin at most.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored

#: Bins of an interval; values of an interval that are read off.
BINS, FEW = 4096, 4096
LARGEST = sys.float_info.max


def magnitude(x: Column) -> Column:
    """A monotone function that spreads the exponents of doubles evenly."""
    return F.signum(x) * (F.log2(F.greatest(F.abs(x), F.lit(1e-300))) + 1000)


def bin_of(x: Column, lo: Column, hi: Column, by_magnitude: bool) -> Column:
    if by_magnitude:
        x, lo, hi = magnitude(x), magnitude(lo), magnitude(hi)
    else:
        x, lo, hi = x / 2, lo / 2, hi / 2  # the width stays finite
    place = F.floor(F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)) * BINS)
    return F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """k (a struct of ``by``), c (which column), x. NULL and NaN are left out; infinities are the largest doubles."""
    value = lambda c: F.greatest(F.least(F.col(c).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), value(c)).alias("x")) for i, c in enumerate(columns)]))
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]) if by else F.lit(0)
    return df.select(key.alias("k"), each.alias("e")).select("k", "e.c", "e.x").filter("x is not null")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., column_name, q: for each group and column the exact quantiles, interpolated between neighbouring values as ``percentile`` does.

    Groups and columns without a value have no row. NaN counts as missing.
    """
    rows = long_form(df, columns, by)
    keys = ["k", "c"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in at])))
    sizes = stored(sizes, "sizes")
    # rank: among all values; before: how many values are below the interval; inside: how many it holds.
    wanted = stored(sizes.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")), "ranks")
    done, turn = None, 0
    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > FEW)
        settled, rest = wanted.filter(~wide), wanted.filter(wide)
        done = settled if done is None else done.unionByName(settled)
        if rest.isEmpty():
            break
        spans = rest.select(*keys, "lo", "hi").distinct()
        hit = rows.join(spans, keys).filter(F.col("x").between(F.col("lo"), F.col("hi")))
        bins = hit.groupBy(*keys, "lo", "hi", bin_of(F.col("x"), F.col("lo"), F.col("hi"), turn % 2 == 1).alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        below = W.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # BINS rows at most
        bins = bins.withColumn("below", F.coalesce(F.sum("m").over(below), F.lit(0)))
        place = F.col("rank") - F.col("before")
        found = rest.join(bins, [*keys, "lo", "hi"]).filter((place >= F.col("below")) & (place < F.col("below") + F.col("m")))
        wanted = stored(found.select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("m").alias("inside")), "ranks")
        turn += 1
    one = done.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("x"))
    few = done.filter("lo < hi")
    values = rows.join(few.select(*keys, "lo", "hi").distinct(), keys).filter(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "lo", "hi", "x").agg(F.count(F.lit(1)).alias("m"))
    upto = W.partitionBy(*keys, "lo", "hi").orderBy("x").rowsBetween(W.unboundedPreceding, 0)  # FEW rows at most
    values = values.withColumn("upto", F.sum("m").over(upto))
    place = F.col("rank") - F.col("before")
    read = few.join(values, [*keys, "lo", "hi"]).filter((place >= F.col("upto") - F.col("m")) & (place < F.col("upto"))).select(*keys, "rank", "x")
    at_rank = one.unionByName(read).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("v"))  # two for each share at most
    n = at_rank.join(sizes.select(*keys, "n"), keys)

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        a, b = F.col("v")[low], F.col("v")[high]
        return F.when((low == high) | (a == b), a).otherwise((high - p) * a + (p - low) * b)

    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    return n.select(*[F.col("k")[f"k{i}"].alias(c) for i, c in enumerate(by)], names.alias("column_name"), F.array(*[between(p) for p in at]).alias("q"))


def fitted(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
    """The quantiles of whole columns, on the driver; columns without a value are missing."""
    return {r.column_name: r.q for r in quantiles(df, columns, shares).collect()} if columns else {}
