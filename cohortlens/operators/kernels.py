"""Kernels for linear learners: columns whose inner products come near a kernel's values, so that nothing is quadratic in rows.

A map is a few seeded arrays of features times ``size`` numbers, made again in every task; ``size`` sets the error, which
falls with its root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are mapped at once.
PIECE = 1024


@dataclass(frozen=True)
class Kernel:
    """``rbf``: exp(-gamma |x - y|²) by random Fourier features. ``poly``: (gamma x.y + coef0)^degree by tensor sketch."""

    kind: str
    gamma: float
    size: int = 512
    degree: int = 3
    coef0: float = 1.0
    seed: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("rbf", "poly") or self.gamma <= 0 or self.size < 2 or self.degree < 1 or self.coef0 < 0:
            raise ValueError("rbf or poly; gamma above 0, size of 2 and degree of 1 at least, no negative coef0")

    def map(self, width: int):
        """A function from rows of ``width`` values to rows of ``size`` values."""
        g, size = np.random.default_rng(self.seed), self.size
        if self.kind == "rbf":
            w, b = g.normal(scale=(2 * self.gamma) ** 0.5, size=(width, size)), g.uniform(0, 2 * np.pi, size)
            return lambda x: np.cos(x @ w + b) * (2 / size) ** 0.5
        place, sign = g.integers(0, size, (self.degree, width + 1)), g.choice([-1.0, 1.0], (self.degree, width + 1))

        def sketched(x: np.ndarray) -> np.ndarray:
            x = np.c_[x * self.gamma**0.5, np.full(len(x), self.coef0**0.5)]
            product = np.ones((len(x), size // 2 + 1), complex)
            for p, s in zip(place, sign, strict=True):
                count = np.zeros((size, len(x)))
                np.add.at(count, p, (x * s).T)
                product *= np.fft.rfft(count.T, axis=1)
            return np.fft.irfft(product, size, axis=1)

        return sketched

    def apply(self, df: DataFrame, vector: str, to: str = "features") -> DataFrame:
        """``df`` with the mapped array column as an ML vector. A null array, or one with a null component, gives null."""

        @F.arrow_udf("array<double>")
        def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            made, f = None, None
            for batch in batches:
                rows = batch.to_pylist()
                out: list = [None] * len(rows)
                good = [i for i, r in enumerate(rows) if r is not None and None not in r]
                for j in range(0, len(good), PIECE):
                    part = good[j : j + PIECE]
                    x = np.array([rows[i] for i in part], float)
                    if made != x.shape[1]:
                        made, f = x.shape[1], self.map(x.shape[1])
                    for i, z in zip(part, f(x), strict=True):
                        out[i] = z
                yield pa.array(out, pa.list_(pa.float64()))

        z = df.withColumn("__z", mapped(F.transform(F.col(vector), lambda x: x.cast("double"))))
        return z.withColumn(to, F.when(F.col("__z").isNotNull(), array_to_vector(F.coalesce("__z", F.array().cast("array<double>"))))).drop("__z")


def gamma_by_scale(train: DataFrame, features: str = "features") -> float:
    """One over the number of features times the variance of all values; 1 if nothing varies."""
    r = train.select(Summarizer.mean(F.col(features)).alias("m"), Summarizer.variance(F.col(features)).alias("v"), Summarizer.count(F.col(features)).alias("n")).first()
    if not r.n:
        return 1.0
    m, v = np.array(r.m.toArray()), np.array(r.v.toArray()) * (r.n - 1) / r.n
    spread = float((v + m**2).mean() - m.mean() ** 2)
    return 1 / (len(m) * spread) if spread > 0 else 1.0
