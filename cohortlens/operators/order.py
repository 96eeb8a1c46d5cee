"""Orders over a whole table without a task that holds all of it: rows are cut into slices of a column, numbered within each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a slice of an order, slices at least and at most. About so many values for each slice are drawn, by their hash, to find where it begins.
ROWS, LEAST, SLICES, DRAWN = 50_000, 8, 256, 32


def literal(v) -> Column:
    """A value, or a struct of values, as a column."""
    return F.struct(*[literal(x).alias(k) for k, x in v.asDict(recursive=False).items()]) if isinstance(v, Row) else F.lit(v)


def slice_of(df: DataFrame, column: str, descending: bool = False) -> Column:
    """The number of the slice that the column's value lies in, from 0; NULLs come first. Bounds are values, so equal values share a slice."""
    values = df.select(F.col(column).alias("v")).filter("v is not null")
    n = values.count()
    slices = min(SLICES, max(LEAST, n // ROWS))
    every = max(1, n // (slices * DRAWN))
    drawn = [r.v for r in values.filter(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).select("v").distinct().orderBy("v").collect()]
    bounds = [drawn[i] for i in sorted({len(drawn) * i // slices for i in range(1, slices)})] if drawn else []
    kind = df.schema[column].dataType.simpleString()

    def upto(lo: int, hi: int) -> Column:
        """How many bounds are at or below the value, if it is from lo to hi: by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) >= literal(bounds[mid]).cast(kind), upto(mid + 1, hi)).otherwise(upto(lo, mid))

    above = F.when(F.col(column).isNotNull(), upto(0, len(bounds))).otherwise(-1)
    return len(bounds) - above if descending else above


def running(df: DataFrame, column: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``df`` with ``before_<c>`` and ``all_<c>`` for each c of ``sums``: its sum over the rows before this one, and over all rows, of the group ``by``.

    Values of ``column`` are distinct within a group. Sums of the slices are added up first (a few rows for each group).
    """
    x = df.withColumn("__slice", slice_of(df, column, descending))
    keys = [*by, "__slice"]
    totals = x.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    upto, whole = W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    first = totals.select(*keys, *[F.coalesce(F.sum(f"__{c}").over(upto), F.lit(0)).alias(f"__first_{c}") for c in sums], *[F.sum(f"__{c}").over(whole).alias(f"all_{c}") for c in sums])
    within = W.partitionBy(*keys).orderBy(F.desc(column) if descending else F.asc(column)).rowsBetween(W.unboundedPreceding, -1)
    x = x.join(first.withColumnsRenamed({k: f"__k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    x = x.withColumns({f"before_{c}": F.col(f"__first_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    return x.drop("__slice", *[f"__k_{k}" for k in keys], *[f"__first_{c}" for c in sums])


def numbered(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with ``to``: the place of the row in the order of ``column``, from 0. Its values are distinct."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), column, ["__one"]).withColumnRenamed("before___one", to).drop("__one", "all___one")
