"""Gradient boosting for any number of classes, on histograms.

Values become bins once, cut at exact quantiles. In each round every class gets a tree on the gradients of the softmax loss:
tasks add up gradients by node, feature and bin, Spark adds the tasks' sums, and one row for each open node, its best split,
comes to the driver. A tree is grown by levels and then cut back to the splits that growth leaf by leaf, best gain first,
would have made, so a tree takes ``max_depth`` passes however many leaves it has.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import running
from .quantiles import quantiles
from .scratch import release, stored_at
from .split import seeded

#: After so many rounds the rows' margins are written; between, a task adds the newer trees itself.
STATE_EVERY = 8
#: Values of a piece of a batch (rows times features): bounds the memory of a task.
PIECE = 4 << 20
SUMS = "k int, node int, feature int, bin int, g double, h double, n long"
_SUMS = pa.schema([("k", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())])
STATE = "h long, bins binary, y int, w double, m array<double>"
_STATE = pa.schema([("h", pa.int64()), ("bins", pa.binary()), ("y", pa.int32()), ("w", pa.float64()), ("m", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Settings:
    """``subsample`` and ``colsample`` are shares of the rows and features of a round's trees; ``gamma`` the least gain, ``alpha`` and ``lam`` the L1 and L2 penalties of leaf values."""

    rounds: int = 20
    max_depth: int = 3
    max_leaves: int = 31
    rate: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    least_hessian: float = 1e-3
    bins: int = 32
    seed: int = 0

    def __post_init__(self) -> None:
        if not (2 <= self.bins <= 255 and self.rounds >= 0 and self.max_depth >= 0 and self.max_leaves >= 1):
            raise ValueError("2 to 255 bins, no negative rounds or depth, one leaf at least")


@dataclass
class Tree:
    """Nodes by number, the root first. Bins up to ``bin`` of ``feature`` go to ``left``; a feature below 0 is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, gain: float, values: Sequence[float]) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.gain[node], self.left[node], self.right[node] = feature, bin_, gain, a, a + 1
        for v in values:
            for column, x in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, v), (self.gain, 0.0)):
                column.append(x)
        return a, a + 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := feature[at] >= 0).any():
            low = bins[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return at

    def best_first(self, leaves: int) -> None:
        """Keep the splits that best-first growth makes before it has so many leaves."""
        kept, queue = set(), [(-self.gain[0], 0)] if self.feature[0] >= 0 else []
        while queue and len(kept) < leaves - 1:
            node = heapq.heappop(queue)[1]
            kept.add(node)
            for child in (self.left[node], self.right[node]):
                if self.feature[child] >= 0:
                    heapq.heappush(queue, (-self.gain[child], child))
        self.feature = [f if i in kept else -1 for i, f in enumerate(self.feature)]


def added(trees: Sequence[Sequence[Tree]], bins: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """Margins with the leaf values of the rounds in ``trees``."""
    out = margins.copy()
    for one in trees:
        for k, tree in enumerate(one):
            out[:, k] += np.array(tree.value)[tree.nodes_of(bins)]
    return out


def binned(x: np.ndarray, borders: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of each value: 0 if it is missing, else 1 and how many borders are below it."""
    out = np.zeros(x.shape, np.uint8)
    for f, b in enumerate(borders):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(b, x[:, f], "left"))
    return out


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Arrays of one length as rows; null components are NaN."""
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def as_vector(column: str, width: int) -> Column:
    """An array column as doubles of one length: a null array has only missing components, another length is an error."""
    v = F.coalesce(F.transform(F.col(column), lambda x: x.cast("double")), F.array_repeat(F.lit(None).cast("double"), width))
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.lit(f"vectors of {width} components")))


@dataclass(frozen=True)
class Boosted:
    """A fitted model: bounded by rounds, classes, leaves, features and bins."""

    classes: list
    base: list[float]
    borders: list[list[float]]
    trees: list[list[Tree]]

    def margins(self, vector: str) -> Column:
        """One number for each class, before the softmax."""
        if not self.classes:
            return F.array().cast("array<double>")

        @F.arrow_udf("array<double>")
        def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = matrix(batch, len(self.borders))
                m = added(self.trees, binned(x, self.borders), np.tile(self.base, (len(x), 1)))
                yield pa.array(list(m), pa.list_(pa.float64()))

        return told(as_vector(vector, len(self.borders)))

    def transform(self, df: DataFrame, vector: str, probability: str = "p", prediction: str = "prediction") -> DataFrame:
        """``df`` with the probability of each class, in the order of ``classes``, and the likeliest class (ties: the first). A model without classes gives an empty array and null."""
        out = df.withColumn("__m", self.margins(vector))
        e = F.transform("__m", lambda v: F.exp(v - F.array_max("__m")))
        out = out.withColumn(probability, F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
        if not self.classes:
            return out.withColumn(prediction, F.lit(None).cast("int")).drop("__m")
        m = F.transform("__m", lambda v: F.round(v, 9))
        return out.withColumn(prediction, F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.array_position(m, F.array_max(m)).cast("int"))).drop("__m")

    def importance(self) -> dict[int, float]:
        """Share of all gain for each feature that a tree uses."""
        sums: dict[int, float] = {}
        for tree in (t for one in self.trees for t in one):
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    sums[f] = sums.get(f, 0.0) + g
        total = sum(sums.values())
        return {f: g / total for f, g in sorted(sums.items())}


def borders_of(df: DataFrame, vector: str, width: int, bins: int) -> list[list[float]]:
    """For each feature the distinct quantiles at the shares i / bins, of the values that aren't missing."""
    each = df.select(F.posexplode(as_vector(vector, width)).alias("feature", "x"))
    found = {r.feature: sorted(set(r.q)) for r in quantiles(each, ["x"], [i / bins for i in range(1, bins)], ["feature"]).toLocalIterator()}
    return [found.get(f, []) for f in range(width)]


def pieces(batches: Iterator[pa.RecordBatch], width: int, classes: int, trees: Sequence[Sequence[Tree]]) -> Iterator[tuple]:
    """h, bins, y, w and margins (with ``trees`` added) of bounded pieces of the state."""
    for batch in batches:
        step = max(1, PIECE // max(1, width))
        for i in range(0, batch.num_rows, step):
            h, raw, y, w, m = (batch.slice(i, step).column(c) for c in ("h", "bins", "y", "w", "m"))
            bins = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, width)
            yield h.to_numpy(), bins, y.to_numpy(), w.to_numpy(), added(trees, bins, matrix(m, classes))


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def drawn(h: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Whether a row takes part in a round: a hash of its hash and the round."""
    x = (h.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) / np.float64(2**64) < share


def node_sums(state: DataFrame, width: int, classes: int, before, growing: Sequence[Tree], open_nodes: Sequence[Sequence[int]], features: Sequence[Sequence[int]], s: Settings, turn: int) -> DataFrame:
    """SUMS over all rows, for the open nodes of each class's growing tree and the features that it may use."""
    span = s.bins + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, len(open_nodes[k]) * len(features[k]) * span)) for k in range(classes)]
        for h, bins, y, w, m in pieces(batches, width, classes, before):
            p = softmax(m)
            takes = drawn(h, turn, s.subsample) if s.subsample < 1 else np.ones(len(h), bool)
            for k in range(classes):
                if not len(open_nodes[k]):
                    continue
                place = np.full(len(growing[k].feature), -1)
                place[open_nodes[k]] = np.arange(len(open_nodes[k]))
                at = place[growing[k].nodes_of(bins)]
                r = np.flatnonzero(takes & (at >= 0))
                n_f = len(features[k])
                where = ((at[r, None] * n_f + np.arange(n_f)) * span + bins[r][:, features[k]]).ravel()
                g, hess = w[r] * (p[r, k] - (y[r] == k)), w[r] * p[r, k] * (1 - p[r, k])
                for i, v in enumerate((g, hess, np.ones(len(r)))):
                    held[k][i] += np.bincount(where, np.repeat(v, n_f), held[k].shape[1])
        for k in range(classes):
            used = np.flatnonzero(held[k][2])
            node, rest = np.divmod(used, len(features[k]) * span)
            columns = [np.full(len(used), k), np.array(open_nodes[k], int)[node], np.array(features[k], int)[rest // span], rest % span, *held[k][:, used]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, _SUMS.types, strict=True)], schema=_SUMS)

    # Each task sends a sum once, so sums are not added before the shuffle; one shuffle serves them and the windows of ``best_splits``.
    parts = state.mapInArrow(add_up, SUMS).repartition("k", "node", "feature")
    return parts.groupBy("k", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def shrunk(g: Column, alpha: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """k, node, g, h, best: for each node its sums and (gain, -feature, -bin, gl, hl) of the largest gain, null if no split is allowed; equal gains (to 9 digits): the first feature, then bin."""
    of = ["k", "node", "feature"]
    upto, whole = W.partitionBy(*of).orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*of)  # 256 bins at most
    x = sums.select(*of, "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(c) for c in "ghn"])
    worth = lambda g, h: shrunk(g, s.alpha) ** 2 / (h + s.lam)
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    gain = F.round(worth(F.col("gl"), F.col("hl")) + worth(gr, hr) - worth(F.col("g"), F.col("h")), 9)
    allowed = (F.col("nl") < F.col("n")) & (F.least(F.col("hl"), hr) >= s.least_hessian) & (gain > s.gamma)
    best = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl")
    return x.groupBy("k", "node").agg(F.min("g").alias("g"), F.min("h").alias("h"), F.max(F.when(allowed, best)).alias("best"))


def fit(df: DataFrame, vector: str, label: str, key: str, weight: str | None = None, **options) -> Boosted:
    """H8: boosted trees for the classes of ``label``, with the settings of ``Settings``.

    Rows with a null label or vector, or a weight that is null or not above 0, take no part; null and NaN components are
    missing and lie below all values. Other columns are not read and may have any name. Repeated keys are rows like others.
    Without rows the model has no class, with one class no tree splits. Nothing depends on how rows are partitioned but the
    last digits of sums.
    """
    s, spark = Settings(**options), df.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(vector).alias("v"), F.col(label).alias("y"), F.xxhash64(F.lit(s.seed), F.col(key)).alias("h"), w.alias("w")).filter("v is not null and y is not null and w > 0")
    shares = {r.y: r.w for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    classes = sorted(shares)
    if not classes:
        return Boosted([], [], [], [])
    width, total = len(rows.select("v").first().v), sum(shares.values())
    base = [math.log(shares[c] / total) for c in classes]
    borders = borders_of(rows, "v", width, s.bins)

    @F.arrow_udf("binary")
    def to_bins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([b.tobytes() for b in binned(matrix(batch, width), borders)], pa.binary())

    number = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])[F.col("y")]
    state = rows.select("h", to_bins(as_vector("v", width)).alias("bins"), number.alias("y"), "w", F.array(*[F.lit(b) for b in base]).alias("m"))
    state, path = stored_at(state, "boosting")
    trees, pending = [], []

    def value(g: float, h: float) -> float:
        return -s.rate * math.copysign(max(abs(g) - s.alpha, 0.0), g) / (h + s.lam)

    for turn in range(s.rounds):
        growing, n = [Tree() for _ in classes], len(classes)
        rng = random.Random(f"{s.seed}|{turn}")
        features = [sorted(rng.sample(range(width), max(1, round(s.colsample * width)))) for _ in classes]
        open_nodes = [[0] for _ in classes]
        for _ in range(s.max_depth):
            if not any(open_nodes):
                break
            found = best_splits(node_sums(state, width, n, pending, growing, open_nodes, features, s, turn), s).collect()
            open_nodes = [[] for _ in classes]
            for r in sorted(found, key=lambda r: (r.k, r.node)):
                if r.best is not None:
                    b = r.best
                    open_nodes[r.k] += growing[r.k].split(r.node, -b.f, -b.b, b.gain, [value(b.gl, b.hl), value(r.g - b.gl, r.h - b.hl)])
        for tree in growing:
            tree.best_first(s.max_leaves)
        trees.append(growing)
        pending = [*pending, growing]
        if len(pending) == STATE_EVERY and turn + 1 < s.rounds:
            state, path, pending = *moved_on(state, path, width, n, pending), []
    release(spark, [path])
    return Boosted(classes, base, borders, trees)


def moved_on(state: DataFrame, path: str, width: int, classes: int, trees: Sequence[Sequence[Tree]]) -> tuple[DataFrame, str]:
    """The state with the trees in its margins, written; what it was made from is deleted."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, bins, y, w, m in pieces(batches, width, classes, trees):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(y), pa.array(w), pa.array(list(m), pa.list_(pa.float64()))], schema=_STATE)

    out, to = stored_at(state.mapInArrow(step, STATE), "boosting")
    release(state.sparkSession, [path])
    return out, to


def ordered_statistics(train: DataFrame, category: str, y: str, key: str, to: str, seed: int = 0, strength: float = 1.0) -> DataFrame:
    """H8: a category as a number, for training: the mean of ``y`` over the rows of that category that come before the row in a seeded order, with ``strength`` rows of the overall mean.

    No row sees its own ``y``. A null category is a category. Rows with a null ``y`` count nowhere. Keys are distinct. A
    category that many rows share is cut into slices of the order (``order.running``).
    """
    mean = train.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    counted = train.withColumns({"__at": F.struct(seeded(seed, key), F.col(key)), "__y": F.coalesce(F.col(y).cast("double"), F.lit(0.0)), "__n": F.col(y).isNotNull().cast("double")})
    x = running(counted, "__at", ["__y", "__n"], [category])
    return x.withColumn(to, (F.col("before___y") + strength * mean) / (F.col("before___n") + strength)).drop("__at", "__y", "__n", "before___y", "before___n", "all___y", "all___n")


def category_statistics(train: DataFrame, df: DataFrame, category: str, y: str, to: str, strength: float = 1.0) -> DataFrame:
    """H8: the same number for other rows: over all rows of ``train``; a category that it doesn't have gets the overall mean."""
    mean = train.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    told = train.groupBy(F.col(category).alias("__c")).agg(((F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)) + strength * mean) / (F.count(y) + strength)).alias("__v"))
    return df.join(told, F.col(category).eqNullSafe(F.col("__c")), "left").withColumn(to, F.coalesce("__v", F.lit(mean))).drop("__c", "__v")
