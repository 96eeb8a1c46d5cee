"""Ward linkage of any number of rows: clustering features of a bounded tree, then the exact hierarchy of its leaves.

A clustering feature is a group's count, sums and sums of squares; two add up to that of both groups. The tree is cut by levels:
a node splits at the mean of the column that varies most, the nodes with the largest sums of squares first, until there are
``leaves`` of them or every leaf holds equal rows. Tasks add up the features of all leaves in one pass over the rows of a level,
and one shuffle adds the tasks' sums; only the tree and its features (at most ``leaves`` rows) come to the driver. Neither the
rows' order nor their partitions matter, but for the last bits of sums. With at most ``leaves`` rows the leaves are the
rows (equal ones together) and the hierarchy is exact Ward linkage; beyond, it is Ward linkage of the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: A node: column it splits by (-1: a leaf), cut, first child.
NODE = [("column", np.int64), ("cut", float), ("child", np.int64)]
SUMS = "leaf int, i int, n double, s double, q double, lo double, hi double"


def leaf_of(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Leaf of each row; a node's second child comes after its first."""
    at = np.zeros(len(x), np.int64)
    while True:
        column = tree["column"][at]
        inner = np.flatnonzero(column >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = tree["child"][node] + (x[inner, column[inner]] > tree["cut"][node])


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is whole (d finite components), and which they are."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == d)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    fine = np.isfinite(x).all(axis=1)
    return x[fine], at[fine]


def features_of(df: DataFrame, tree: np.ndarray, shift: np.ndarray) -> dict[int, np.ndarray]:
    """Leaf -> count, and by column (about ``shift``) sum, sum of squares, least and largest value."""
    d = len(shift)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x, _ = matrix(batch["v"], d)
            x = x - shift
            leaf = leaf_of(x, tree)
            order = np.argsort(leaf, kind="stable")
            x, leaf = x[order], leaf[order]
            for at in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1) if len(leaf) else ():
                y = x[at]
                new = np.stack([np.full(d, float(len(y))), y.sum(0), (y * y).sum(0), y.min(0), y.max(0)])
                old = held.get(leaf[at[0]])
                held[leaf[at[0]]] = new if old is None else joined(old, new)
        for k, f in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, k, np.int32)), pa.array(np.arange(d, dtype=np.int32)), *(pa.array(c) for c in f)], ["leaf", "i", "n", "s", "q", "lo", "hi"])

    sums = df.mapInArrow(add_up, SUMS).groupBy("leaf", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    told = sums.toPandas()  # as many rows as leaves times columns, at most
    out = {int(k): np.zeros((5, d)) for k in told["leaf"].unique()}
    for k, i, f in zip(told["leaf"], told["i"], told[["n", "s", "q", "lo", "hi"]].to_numpy(), strict=True):
        out[k][:, i] = f
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([*(a[:3] + b[:3]), np.minimum(a[3], b[3]), np.maximum(a[4], b[4])])


def feature_tree(df: DataFrame, shift: np.ndarray, leaves: int, most_levels: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The tree over the rows of ``df`` (v) and the features of its leaves."""
    tree = np.array([(-1, 0.0, 0)], NODE)
    found = features_of(df, tree, shift)
    for _ in range(most_levels):
        open_ = []
        for k, (n, s, q, lo, hi) in found.items():
            spread = np.where(hi > lo, np.maximum(q - s * s / n, np.finfo(float).tiny), 0.0)
            if spread.any():
                open_.append((-spread.sum(), k, int(spread.argmax())))
        split = sorted(open_)[: leaves - len(found)]
        if not split:
            break
        for _, k, column in split:
            n, s, _, lo, hi = found[k][:, column]
            mean = s / n
            tree[k] = (column, mean if lo <= mean < hi else lo, len(tree))
            tree = np.concatenate([tree, np.array([(-1, 0.0, 0)] * 2, NODE)])
        found = features_of(df, tree, shift)
    return tree, found


def chain(n: np.ndarray, centres: np.ndarray) -> list[tuple[float, int, int]]:
    """Ward merges by nearest-neighbour chain: height and a member of either side, by height. Ties go to the smaller number."""
    n, centres = n.astype(float).copy(), centres.copy()
    alive, path, merges = np.ones(len(n), bool), [], []
    for _ in range(len(n) - 1):
        if not path:
            path = [int(np.argmax(alive))]
        while True:
            a = path[-1]
            far = 2 * n[a] * n / (n[a] + n) * ((centres - centres[a]) ** 2).sum(1)
            far[~alive] = np.inf
            far[a] = np.inf
            b = int(np.argmin(far))
            if len(path) > 1 and far[path[-2]] <= far[b]:
                b = path[-2]
                break
            path.append(b)
        path = path[:-2]
        merges.append((float(np.sqrt(far[b])), a, b))
        a, b = min(a, b), max(a, b)
        centres[a] = (n[a] * centres[a] + n[b] * centres[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
    return sorted(merges)


def cut(merges: list[tuple[float, int, int]], n: int, share: float) -> np.ndarray:
    """Group of each of n leaves after all merges of at most ``share`` of the top height."""
    root = np.arange(n)
    for height, a, b in merges:
        if height <= share * merges[-1][0]:
            x, y = root[a], root[b]
            root[root == max(x, y)] = min(x, y)
    return root


def ward(df: DataFrame, features: str, share: float = 0.5, leaves: int = 1024, most_levels: int = 64, cluster: str = "cluster", height: str = "top") -> DataFrame:
    """``df`` with ``cluster`` (int, from 0, larger clusters first) and ``top`` (the highest merge) of Ward linkage, cut at ``share`` of the top height.

    ``features``: arrays of numbers, of the most frequent length. Rows whose array is null, of another length, or holds a null or
    non-finite component take no part: their cluster is null. Repeated rows count each. No rows: no rows. All rows equal: one cluster.
    Columns of these two names are replaced.
    """
    v = df.select(F.col(features).cast("array<double>").alias("v"))
    width = v.filter("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is not None:
        v = stored(v.filter(F.size("v") == width.d), "ward")
        about = features_of(v, np.array([(-1, 0.0, 0)], NODE), np.zeros(width.d))
    if width is None or not about:
        return df.withColumn(cluster, F.lit(None).cast("int")).withColumn(height, F.lit(None).cast("double"))
    shift = about[0][1] / about[0][0]  # sums of squares about the mean keep their digits
    tree, found = feature_tree(v, shift, leaves, most_levels)
    names = sorted(found, key=lambda k: tuple(found[k][1] / found[k][0]))
    n = np.array([found[k][0, 0] for k in names])
    merges = chain(n, np.array([found[k][1] / found[k][0] for k in names]))
    group = cut(merges, len(names), share)
    by_size = sorted(set(group.tolist()), key=lambda g: (-n[group == g].sum(), g))
    number = np.full(len(tree), -1)
    for k, g in zip(names, group.tolist(), strict=True):
        number[k] = by_size.index(g)
    d, top = len(shift), merges[-1][0] if merges else 0.0

    @F.pandas_udf("int")
    def numbered(column: pd.Series) -> pd.Series:
        x, at = matrix(pa.array(column, pa.list_(pa.float64())), d)
        out = pd.Series([None] * len(column), dtype="Int32")
        out.iloc[at] = number[leaf_of(x - shift, tree)]
        return out

    return df.withColumn(cluster, numbered(F.col(features).cast("array<double>"))).withColumn(height, F.when(F.col(cluster).isNotNull(), F.lit(top)))
