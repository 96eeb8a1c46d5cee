"""Choosing among models: best per fold, ensembles, comparison tables and the registry of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_per_fold(registry: DataFrame, fold: Sequence[str], score: str, method: str) -> DataFrame:
    """E5: the method with the highest inner score of each fold (ties: the smallest name)."""
    w = W.partitionBy(*fold).orderBy(F.desc(score), method)
    return registry.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def best_of_families(registry: DataFrame, fold: Sequence[str], family: str, score: str, method: str, n: int = 3) -> DataFrame:
    """The best method of each family, then the n best of those."""
    one = best_per_fold(registry, [*fold, family], score, method)
    w = W.partitionBy(*fold).orderBy(F.desc(score), method)
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def ensemble(predictions: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Mean of the members' probability vectors for each row, by place."""
    x = predictions.select(*keys, F.posexplode(p).alias("k", "x")).groupBy(*keys, "k").agg(F.avg("x").alias("x"))
    return x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias(p))  # as many as classes


def auto_select(registry: DataFrame, predictions: DataFrame, fold: Sequence[str], score: str, method: str) -> DataFrame:
    """Outer predictions of the method that the inner score chose in each fold."""
    chosen = best_per_fold(registry, fold, score, method).select(*fold, method)
    return predictions.join(chosen, [*fold, method])


def selection_frequency(chosen: DataFrame, column: str) -> DataFrame:
    """D40."""
    return chosen.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def comparison(metrics: DataFrame, model: str, metric: str, value: str, names: Sequence[str], by: str) -> DataFrame:
    """One row per model, one column per metric, best first; ``winner`` marks the first."""
    t = metrics.groupBy(model).pivot(metric, list(names)).agg(F.first(value))
    return t.withColumn("winner", F.row_number().over(W.orderBy(F.desc(by), model)) == 1)


def best_config(runs: DataFrame, score: str, loss: str, key: str) -> DataFrame:
    """Highest score, then lowest loss."""
    return runs.orderBy(F.desc(score), F.asc(loss), key).limit(1)
