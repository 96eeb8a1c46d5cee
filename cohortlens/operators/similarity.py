"""Similarity of vectors: thresholds, best matches and assignments.

Rows meet in tiles of bounded size, and there only where the bounds of a metric index (``metric_index``) on their distance leave
a match possible. Only pairs that count leave a task. Similarities count to 12 digits; of equal ones the
smaller id is first. Rows without a vector are left out; ids are whole numbers, each once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import dot, unit
from . import metric_index as M
from .scratch import stored


def similar_pairs(df: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """C11: a, b, sim for pairs a < b with cosine >= ``least``. A row visits its own cell and later ones, so a pair meets once."""
    index, schema = M.build(df, key, vector), "a long, b long, sim double"
    if not len(index.count):
        return df.sparkSession.createDataFrame([], schema)
    rows = index.rows.select("id", "v", F.col("cell").alias("home"))
    come = stored(M.visits(rows, index, math.acos(max(-1.0, min(1.0, least))), after="home"), "visits")

    def pairs(x: pa.Table, y: pa.Table, blocks: Callable) -> pa.Table:
        v, w, a, b, home, cell = M.matrix(x["v"]), M.matrix(y["v"]), x["id"].to_numpy(), y["id"].to_numpy(), x["home"].to_numpy(), y["cell"].to_numpy()
        out = []
        for rows, columns, use in blocks():
            i, j = M.likely(v[rows], w[columns], "cosine", np.full(len(rows), least))
            i, j = rows[i[use[i, j]]], columns[j[use[i, j]]]
            s = M.exactly(v[i], w[j], "cosine")
            keep = (s >= least - 1e-12) & np.where(home[i] == cell[j], a[i] < b[j], a[i] != b[j])
            out.append((np.minimum(a[i], b[j])[keep], np.maximum(a[i], b[j])[keep], s[keep]))
        return pa.table({n: np.concatenate([o[k] for o in out]) if out else [] for k, n in enumerate(("a", "b", "sim"))})

    return M.meet(come, index, pairs, schema)


def reach_of(close: Column, metric: str) -> Column:
    """The distance that a similarity stands for."""
    return F.acos(F.greatest(F.least(close, F.lit(1.0)), F.lit(-1.0))) if metric == "cosine" else -close


def closest(x: pa.Table, y: pa.Table, blocks: Callable, k: int, metric: str, itself: bool, group: np.ndarray | None = None) -> M.Best:
    """The best of a tile for each of its visitors."""
    v, w, a, b = M.matrix(x["v"]), M.matrix(y["v"]), x["id"].to_numpy(), y["id"].to_numpy()
    reach = x["reach"].fill_null(np.inf).to_numpy() if "reach" in x.column_names else None
    state = M.Best(len(a), k, metric, reach, itself, group is not None)
    for rows, columns, use in blocks():
        state.step(rows, v[rows], a[rows], w[columns], b[columns], None if group is None else group[columns], use)
    return state


def nearest(left: DataFrame, right: DataFrame, key: str, vector: str, k: int = 1, metric: str = "cosine", by: Sequence[str] = (), itself: bool = False) -> DataFrame:
    """For each left row its k most similar right rows (of equal ``by``; not itself): id, other, sim, rank.

    ``metric``: cosine, or l1 or l2, of which ``sim`` is the negative distance. The cells around a row tell how near its k-th
    match is at least; only cells that can hold nearer rows are opened after that.
    """
    index, schema = M.build(right, key, vector, metric, by), "id long, other long, sim double"
    if not len(index.count):
        return left.sparkSession.createDataFrame([], schema + ", rank int")

    def best(x: pa.Table, y: pa.Table, blocks: Callable) -> pa.Table:
        state = closest(x, y, blocks, k, metric, itself)
        r, other, _, sim = state.found()
        return pa.table({"id": x["id"].to_numpy()[r], "other": other, "sim": sim})

    order = W.partitionBy("id").orderBy(F.desc("sim"), "other")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    around = stored(M.visits(M.plain(left, key, vector, metric, by), index, least=k + 1), "around")
    first = stored(ranked(M.meet(around, index, best, schema, by)), "first")
    reach = first.filter(F.col("rank") == k).select("id", reach_of(F.col("sim"), metric).alias("reach"))
    again = stored(M.visits(around.withColumnRenamed("cells", "seen").join(reach, "id", "left"), index, "reach", but="seen"), "again")
    return ranked(first.drop("rank").unionByName(M.meet(again, index, best, schema, by)))


def group_match(left: DataFrame, right: DataFrame, key: str, vector: str, klass: str, group: str, around: int = 256) -> DataFrame:
    """For each left row the best and second-best group of its class (by the group's most similar row, not itself), the margin, and the row.

    The second-best group of the cells around a row (``around`` rows at least) tells which other cells can matter.
    """
    a, b = (d.select(key, vector, F.col(klass).alias("klass"), g.alias("grp")).filter("klass is not null") for d, g in ((left, F.lit(None).cast("long")), (right, F.col(group))))
    index = M.build(b, key, vector, "cosine", ["klass", "grp"])
    schema = f"id long, grp {dict(b.dtypes)['grp']}, nearest long, sim double"

    def best(x: pa.Table, y: pa.Table, blocks: Callable) -> pa.Table:
        names = y["grp"].combine_chunks().unique().sort()
        state = closest(x, y, blocks, 2, "cosine", False, pc.index_in(y["grp"].combine_chunks(), names).to_numpy(zero_copy_only=False))
        r, other, g, sim = state.found()
        return pa.table({"id": x["id"].to_numpy()[r], "grp": names.take(pa.array(g)), "nearest": other, "sim": sim})

    def by_group(found: DataFrame) -> DataFrame:
        g = found.groupBy("id", "grp").agg(F.max(F.struct("sim", (-F.col("nearest")).alias("less"))).alias("m"))
        return g.select("id", "grp", F.col("m.sim").alias("sim"), (-F.col("m.less")).alias("nearest"))

    order = W.partitionBy("id").orderBy(F.desc("sim"), "grp")
    if not len(index.count):
        return left.sparkSession.createDataFrame([], f"id long, grp {dict(b.dtypes)['grp']}, sim double, margin double, nearest long")
    near = stored(M.visits(M.plain(a, key, vector, "cosine", ["klass"]), index, least=around), "around")
    first = stored(by_group(M.meet(near, index, best, schema, ["klass"])), "first")
    reach = first.withColumn("r", F.row_number().over(order)).filter("r = 2").select("id", reach_of(F.col("sim"), "cosine").alias("reach"))
    again = stored(M.visits(near.withColumnRenamed("cells", "seen").join(reach, "id", "left"), index, "reach", but="seen"), "again")
    g = by_group(first.select("id", "grp", "nearest", "sim").unionByName(M.meet(again, index, best, schema, ["klass"])))
    return g.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("sim").over(order)).filter("r = 1").select("id", "grp", "sim", (F.col("sim") - F.coalesce("second", F.lit(0.0))).alias("margin"), "nearest")


def mutual_best(scores: DataFrame, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """C14, at scale: pairs that are each other's best."""
    ra = F.row_number().over(W.partitionBy(a).orderBy(F.desc(score), b))
    rb = F.row_number().over(W.partitionBy(b).orderBy(F.desc(score), a))
    return scores.withColumn("ra", ra).withColumn("rb", rb).filter("ra = 1 and rb = 1").select(a, b, score)


def mutual_nearest(left: DataFrame, right: DataFrame, key: str, vector: str, klass: str) -> DataFrame:
    """C14 on vectors: a, b, score of the left and right rows of one class that are each other's most similar; of equal ones the smallest id."""
    l, r = (d.select(key, vector, F.col(klass).alias("klass")).filter("klass is not null") for d in (left, right))  # noqa: E741
    there = nearest(l, r, key, vector, by=["klass"], itself=True).select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("sim").alias("score"))
    back = nearest(r, l, key, vector, by=["klass"], itself=True).select(F.col("id").alias("b"), F.col("other").alias("a"))
    return there.join(back, ["a", "b"]).select("a", "b", "score")


def neighbours(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Cosine of each row with the next of its group."""
    nxt = F.lead(vector).over(W.partitionBy(group).orderBy(order))
    return df.withColumn("__n", nxt).filter("__n is not null").withColumn("sim", dot(unit(F.col(vector)), unit(F.col("__n")))).drop("__n")


def triple(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Previous, own and next value; the edges repeat."""
    w = W.partitionBy(group).orderBy(order)
    return df.withColumn("previous", F.coalesce(F.lag(column).over(w), F.col(column))).withColumn("following", F.coalesce(F.lead(column).over(w), F.col(column)))


def successors(df: DataFrame, group: str, order: str) -> DataFrame:
    """Rows (group, k) with (group, k + 1): an equi-join of the table with itself."""
    nxt = df.select(F.col(group).alias("__g"), (F.col(order) - 1).alias("__k"))
    return df.join(nxt, (F.col(group) == F.col("__g")) & (F.col(order) == F.col("__k"))).drop("__g", "__k")


def sequence_report(df: DataFrame, group: str, pos: str, vector: str) -> DataFrame:
    """Unparsed rows, groups, repeated places, and the mean similarity of neighbours and of the ends of different groups."""
    base = df.agg(F.count_if(F.col(group).isNull() | F.col(pos).isNull()).alias("unparsed"), F.countDistinct(group).alias("n_groups"))
    good = df.filter(F.col(group).isNotNull() & F.col(pos).isNotNull())
    twice = good.groupBy(group, pos).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("repeated_places"))
    same = neighbours(good, group, pos, vector).agg(F.avg("sim").alias("mean_same"), F.percentile("sim", 0.01).alias("p01_same"))
    return base.crossJoin(twice).crossJoin(same)  # one row each

