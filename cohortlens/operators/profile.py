"""Profiling: one wide aggregation for all columns, then one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles


def rows_per_column(wide: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn one row with fields ``<field>__<column>`` into rows (column_name, field, ...)."""
    parts = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in columns]
    return wide.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def aggregate_columns(df: DataFrame, columns: Sequence[str], fields: dict) -> DataFrame:
    """``fields``: name -> function of a column that gives an aggregate. All columns in one pass."""
    wide = df.agg(*[f(F.col(c)).alias(f"{name}__{c}") for c in columns for name, f in fields.items()])
    return rows_per_column(wide, columns, list(fields))


def describe(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Rows, non-null count, mean, sample deviation, min, quartiles, max of numeric columns.

    ``exact=False`` takes quartiles from sketches, for tables whose columns have very many distinct values.
    """
    fields = {"n": lambda c: F.count(F.lit(1)), "non_null": F.count, "mean": lambda c: F.avg(c.cast("double")), "std": lambda c: F.stddev_samp(c.cast("double")), "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    if exact:
        x = aggregate_columns(df, columns, fields).join(quantiles(df, columns, [0.25, 0.5, 0.75]), "column_name", "left")
    else:
        x = aggregate_columns(df, columns, fields | {"q": lambda c: F.percentile_approx(c.cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))})
    return x.select("column_name", "n", "non_null", "mean", "std", "min", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))], "max")


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of NULLs, columns with any only."""
    return aggregate_columns(df, columns, {"missing_pct": lambda c: F.avg(c.isNull().cast("double")) * 100}).filter("missing_pct > 0")


def duplicate_rows(df: DataFrame, columns: Sequence[str], most: int = 120) -> DataFrame:
    """D3: groups of equal rows (NULLs are equal) with their size; the label is cut to ``most`` characters."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    label = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])
    return groups.select(F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 3), F.lit("..."))).otherwise(label).alias("label"), "n")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Each value (NULL included) with count and percent of all rows; 0 and 1 read No and Yes in ``label``."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    label = F.when(F.col("value") == "0", "No").when(F.col("value") == "1", "Yes").otherwise(F.col("value"))
    return counts.select("value", label.alias("label"), "n", (F.col("n") * 100.0 / total).alias("pct"))


def low_cardinality(df: DataFrame, columns: Sequence[str], most: int = 10) -> DataFrame:
    """Columns with 2 to ``most`` distinct values."""
    return aggregate_columns(df, columns, {"n_distinct": F.countDistinct}).filter((F.col("n_distinct") > 1) & (F.col("n_distinct") <= most))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal bins from minimum to maximum, the last closed. A constant column is one bin."""
    edge = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = df.select(F.col(column).alias("x")).filter("x is not null").crossJoin(F.broadcast(edge))  # one row
    place = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))
    return x.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Label ``(lo, hi]`` of the bin (the lowest edge is included); NULL outside."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        inside = ((x > lo) | ((x == edges[0]) & F.lit(lo == edges[0]))) & (x <= hi)
        out = F.when(inside, F.lit(f"({lo:g}, {hi:g}]")).otherwise(out)
    return out


def edge_counts(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    return df.groupBy(edge_bin(F.col(column), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def correlation(x: str, y: str) -> Column:
    """Pearson's r over rows where both are there; NULL if one is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per pair a < b (places in ``columns``); all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[correlation(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def top_correlations(df: DataFrame, columns: Sequence[str], n: int = 10, keep_perfect: bool = False) -> DataFrame:
    """The n pairs with the largest |r|; pairs with |r| = 1 only if asked for."""
    r = correlation_matrix(df, columns).withColumn("abs_r", F.abs("r")).filter("abs_r is not null")
    return (r if keep_perfect else r.filter("abs_r < 1")).orderBy(F.desc("abs_r"), "a", "b").limit(n)


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """R of each feature with the target; 0 where it is undefined."""
    wide = df.agg(*[F.coalesce(correlation(f, target), F.lit(0.0)).alias(f"r__{f}") for f in features])
    return rows_per_column(wide, features, ["r"])


def profile_similarity(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Mean absolute difference of each column's row of the matrix and the target's row, over the other columns."""
    half = correlation_matrix(df, [*columns, target])
    full = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    t = full.filter(F.col("a") == target).select(F.col("b").alias("other"), F.col("r").alias("r_target"))
    rows = full.filter(F.col("a") != target).filter(F.col("b") != target).select("a", F.col("b").alias("other"), "r")
    return rows.join(t, "other").groupBy(F.col("a").alias("column_name")).agg(F.avg(F.abs(F.col("r") - F.col("r_target"))).alias("distance"))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def target_mean(df: DataFrame, by: str, target: str) -> DataFrame:
    """Mean of the target for each value, with a normal 95 % interval."""
    t = df.groupBy(by).agg(F.avg(F.col(target).cast("double")).alias("mean"), F.count(target).alias("n"), F.coalesce(F.stddev_samp(F.col(target).cast("double")), F.lit(0.0)).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return t.select(by, "mean", "n", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def box_statistics(df: DataFrame, by: str, column: str) -> DataFrame:
    """Quartiles, whiskers (the last values within 1.5 IQR) and number of outliers for each group."""
    box = quantiles(df, [column], [0.25, 0.5, 0.75], [by]).select(F.col(by).alias("__by"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    rows = df.select(by, F.col(column).alias("x")).join(box, F.col(by).eqNullSafe(F.col("__by")))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("whisker_lo"), F.max(F.when(inside, F.col("x"))).alias("whisker_hi"), F.count_if(~inside).alias("n_outliers"))
