"""Local linear explanations of any model: seeded perturbations of a row, the model's values for them, a weighted ridge for each row.

Perturbations are made from the row's hash in the task that scores them; only their values, one number each, are brought
together by row, and the task that fits makes the same perturbations again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Perturbed rows of one batch.
PIECE = 4096


def noise(h: int, samples: int, spread: np.ndarray, seed: int) -> np.ndarray:
    """Perturbations in standard deviations, the first of them none; features that don't vary stay."""
    out = np.random.default_rng([seed, h % 2**64]).normal(size=(samples, len(spread))) * (spread > 0)
    out[0] = 0
    return out


def ridge(u: np.ndarray, v: np.ndarray, width: float, alpha: float) -> np.ndarray:
    """Weights of the features, intercept and R² of v on u, rows weighted by their nearness; the intercept has no penalty."""
    w = np.exp(-(u**2).sum(1) / (2 * width**2))
    w /= w.sum()
    mu, mv = w @ u, w @ v
    a, b = u - mu, v - mv
    beta = np.linalg.solve((a * w[:, None]).T @ a + alpha / len(u) * np.eye(u.shape[1]), (a * w[:, None]).T @ b)
    all_, rest = w @ b**2, w @ (b - a @ beta) ** 2
    return np.r_[beta, mv - mu @ beta, 1 - rest / all_ if all_ > 0 else 1.0]


def local_surrogates(model, df: DataFrame, background: DataFrame, key: str, value: Column, samples: int = 500, width: float | None = None, alpha: float = 1.0, seed: int = 0, features: str = "features") -> DataFrame:
    """Key, feature (its place), weight (change of ``value`` for one standard deviation of the feature near the row), intercept, r2.

    ``value`` is a column of what ``model`` returns, ``background`` the frame whose deviations are the scale, ``width`` that of
    the kernel (0.75 times the root of the number of features). Keys are distinct; rows with a null key or vector have no
    explanation. A feature that doesn't vary in ``background`` weighs 0. Equal vectors with different keys are perturbed differently.
    """
    if samples < 2:
        raise ValueError("two samples at least")
    std = background.select(Summarizer.std(F.col(features)).alias("s")).first().s
    spread = np.array(std.toArray()) if std is not None else np.zeros(0)
    spread = np.nan_to_num(spread)
    wide = width or 0.75 * max(1, len(spread)) ** 0.5
    rows = df.filter(F.col(features).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("h"), vector_to_array(features).alias("x"))
    kind = df.schema[key].dataType.simpleString()

    def perturbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for i, (h, x) in enumerate(zip(batch.column("h").to_pylist(), batch.column("x").to_pylist(), strict=True)):
                z = np.array(x) + noise(h, samples, spread, seed) * spread
                for j in range(0, samples, PIECE):
                    part = z[j : j + PIECE]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array([i] * n)), pa.array([h] * n, pa.int64()), pa.array(range(j, j + n), pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], ["key", "h", "j", "z"])

    z = rows.mapInArrow(perturbed, f"key {kind}, h long, j int, z array<double>").withColumn(features, array_to_vector("z"))
    v = model.transform(z).select("key", "h", F.struct("j", value.cast("double").alias("v")).alias("v"))
    v = v.groupBy("key", "h").agg(F.transform(F.array_sort(F.collect_list("v")), lambda s: s["v"]).alias("v"))  # ``samples`` numbers a row

    @F.arrow_udf("array<double>")
    def fitted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hs, vs in batches:
            yield pa.array([ridge(noise(h, samples, spread, seed), np.array(a, float), wide, alpha) for h, a in zip(hs.to_pylist(), vs.to_pylist(), strict=True)], pa.list_(pa.float64()))

    n = len(spread)
    told = v.select("key", fitted("h", "v").alias("b"))
    told = told.select("key", F.posexplode(F.slice("b", 1, n)).alias("feature", "weight"), F.col("b")[n].alias("intercept"), F.col("b")[n + 1].alias("r2")) if n else told.select("key", F.lit(0).alias("feature"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("intercept"), F.lit(0.0).alias("r2")).filter("false")
    return told.withColumnRenamed("key", key)
