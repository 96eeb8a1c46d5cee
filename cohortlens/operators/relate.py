"""Joins, set operations and inventories of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def set_overlap(df: DataFrame, set_column: str, key: str) -> DataFrame:
    """|A and B| for each pair of sets a < b. One pass over the keys: each key is grouped once, so no self-join."""
    per_key = df.select(set_column, key).distinct().groupBy(key).agg(F.array_sort(F.collect_set(set_column)).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per_key.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("shared"))


def split_leaks(df: DataFrame, split: str, key: str) -> DataFrame:
    """Keys that are in more than one split, counted by pair of splits."""
    return set_overlap(df, split, key)


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key -> value for keys with exactly one distinct value."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__hi")).filter(F.col(value) == F.col("__hi")).drop("__hi")


def lookup(df: DataFrame, key: str, mapping: DataFrame, map_key: str, map_value: str, default, alias: str) -> DataFrame:
    """Left join with a default."""
    m = mapping.select(F.col(map_key).alias("__k"), F.col(map_value).alias("__v"))
    return df.join(m, F.col(key) == F.col("__k"), "left").withColumn(alias, F.coalesce("__v", default if hasattr(default, "alias") else F.lit(default))).drop("__k", "__v")


def merge_odd_groups(df: DataFrame, klass: str, group: str, size: int) -> DataFrame:
    """C20: per class, the groups whose size isn't ``size`` become one group named ``a+b+...``; group -> merged."""
    g = df.groupBy(klass, group).agg(F.count(F.lit(1)).alias("n"))
    odd = g.filter(F.col("n") != size).groupBy(klass).agg(F.array_join(F.array_sort(F.collect_set(F.col(group).cast("string"))), "+").alias("merged"))
    return g.join(odd, klass, "left").select(klass, group, F.when(F.col("n") != size, F.col("merged")).otherwise(F.col(group).cast("string")).alias("merged"))


def pivot_counts(df: DataFrame, by: str, column: str, values: Sequence) -> DataFrame:
    """One column per value, zero where there is none."""
    return df.groupBy(by).pivot(column, list(values)).count().na.fill(0)


def top_values(df: DataFrame, by: str, value: str, n: int = 5) -> DataFrame:
    """The n most frequent values of each group (ties: the smallest)."""
    c = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), value))).filter(F.col("rank") <= n)


def duplicate_summary(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows, distinct keys, keys with copies, rows among copies, keys whose copies disagree in the label."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.min(label) != F.max(label)).alias("odd"))
    many = F.col("n") > 1
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique"), F.count_if(many).alias("dup_groups"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("rows_in_dups"), F.count_if(many & F.col("odd")).alias("conflicting"))


def group_sizes(df: DataFrame, klass: str, group: str) -> DataFrame:
    """Groups per class and their smallest, median and largest size."""
    g = df.groupBy(klass, group).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(klass).agg(F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min"), F.median("n").alias("median"), F.max("n").alias("max"))


def keep(df: DataFrame, by: Sequence[str], order: Sequence, first: bool = True) -> DataFrame:
    """One row of each key: the first (or last) by ``order``; the same on every run if the order has no ties."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    w = W.partitionBy(*by).orderBy(*(c.asc_nulls_last() if first else c.desc_nulls_last() for c in cols))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def match_accuracy(df: DataFrame, predicted: str, truth: str, by: str) -> DataFrame:
    """Rows and share of right matches by source, where the truth is known."""
    return df.filter(F.col(truth).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col(predicted) == F.col(truth), F.lit(False)).cast("double")).alias("accuracy"))
