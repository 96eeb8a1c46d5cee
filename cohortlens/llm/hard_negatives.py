"""Hard negatives: rows of another label that score nearly as high for an anchor as a row of its own label does.

Scores are exact integer inner products by the method of the Four Russians. Every component becomes an integer; eight
dimensions make a group. For a group an anchor has a table of its 256 subset sums. A candidate is stored as bit planes: for
each bit of the (two's complement) components and each group one byte, which is an index into the group's table. The score is
the sum over planes of 2^bit times the sum over groups of what the tables hold there, the sign's plane subtracted.

Anchors and candidates meet in blocks, and each pair of blocks is one group of a cogroup. A task sends on the few best rows of
each anchor, so what leaves it doesn't grow with equal scores, labels or vectors that many rows share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import flat, stored

#: Dimensions of a group; rows of a block of candidates and of anchors (its tables take 8 KB an anchor for 64 dimensions).
GROUP, BLOCK, ANCHORS = 8, 4096, 4096
#: Rows and anchors that are scored at once, so that tables and sums stay in a core's cache.
ROWS, AT_ONCE = 512, 64
#: Components beyond this are cut to it, so that 64 products of two fit in 64 bits.
MOST = 1 << 28
#: Tasks that a grid of blocks is dealt to at most.
MOST_PARTS = 20_000


def quantised(df: DataFrame, key: str, vector: str, label: str, anchor: Column, scale: float = 256.0) -> DataFrame:
    """id, label, anchor, q (floor of ``scale`` times each component): one row for each id that takes part."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    q = F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long"))
    rows = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(key).isNotNull() & finite)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), q.alias("q"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "anchor", "q")).alias("r")).select("id", "r.*")


def planes(q: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of integer rows: (rows, bits, groups) bytes."""
    wide = np.zeros((len(q), -(-q.shape[1] // GROUP) * GROUP), np.int64)
    wide[:, : q.shape[1]] = q
    on = (wide[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(on.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(q: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for each group and byte the sum of the anchor's components where the byte has a bit."""
    n, groups = len(q), -(-q.shape[1] // GROUP)
    wide = np.zeros((groups * GROUP, n), kind)
    wide[: q.shape[1]] = q.T
    out, each = np.zeros((groups, 1 << GROUP, n), kind), wide.reshape(groups, GROUP, n)
    for k in range(GROUP):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + each[:, k, None]
    return out


def scores(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(rows, anchors): shift and add what the tables hold at the planes' bytes."""
    bits, groups = packed.shape[1:]
    out = np.zeros((len(packed), sums.shape[2]), sums.dtype)
    buffer = np.empty((min(ROWS, len(packed)), sums.shape[2]), sums.dtype)
    for s in range(0, len(packed), ROWS):
        total, part = out[s : s + ROWS], packed[s : s + ROWS]
        found = buffer[: len(part)]
        for b in range(bits - 1, -1, -1):
            total += total
            for g in range(groups):
                np.take(sums[g], part[:, b, g], axis=0, out=found, mode="clip")
                if b == bits - 1:
                    total -= found
                else:
                    total += found
    return out


def first(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores are, best first, ties by place."""
    at = np.arange(len(s))
    if len(s) > k:
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    return ids[at[np.argsort(-s[at], kind="stable")[:k]]]


def cells(anchors: DataFrame, index: DataFrame, n_anchors: int, n: int, keep: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn`` for each pair of a block of anchors and a block of candidates, both as Arrow tables."""
    m, k = -(-n_anchors // ANCHORS), -(-n // BLOCK)
    parts = max(1, min(m * k, MOST_PARTS))
    row, column = (F.pmod(F.xxhash64("id"), F.lit(b)).cast("int") for b in (m, k))
    a = anchors.select("id", "label", "q", *keep, row.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    c = index.select("id", "label", "planes", column.alias("j"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"))
    a, c = a.repartition(parts, "i", "j"), c.repartition(parts, "i", "j")
    return a.groupBy("i", "j").cogroup(c.groupBy("i", "j")).applyInArrow(fn, schema)


def hard_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = 5, n_negatives: int = 5, least: int = 80, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first ``n_positives`` other rows of its label the first ``n_negatives`` rows of other labels that score from ``least`` % of the positive's score up to it.

    Higher scores come first, ties by smaller id. Ids and labels are whole numbers. Rows with a null id, label or vector, or a
    null or non-finite component take no part. Of rows that repeat an id that with the smallest label, then vector, stands for
    all. Vectors may differ in length: what is missing counts as 0; an empty one scores 0. Components are cut to +-2^28 after
    scaling. A positive of negative score has no negatives. Other columns are not read. No rows or no anchors: no rows.
    """
    rows = stored(quantised(df, key, vector, label, anchor, scale), "quantised")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("q")).alias("dims"), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))).alias("most")).first()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not size.anchors:
        return df.sparkSession.createDataFrame([], out)
    dims, most = max(size.dims, 1), size.most or 0
    bits, groups = most.bit_length() + 1, -(-dims // GROUP)
    kind = np.int32 if dims * max(most, 1) ** 2 < 1 << 30 else np.int64

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        at = np.diff(lists.offsets.to_numpy())
        q, into = np.zeros((len(lists), dims), np.int64), np.arange(dims)[None, :] < at[:, None]
        q[into] = lists.flatten().to_numpy()
        return q

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = planes(matrix(b["q"]), bits).reshape(len(b), -1)
            cut = pa.array(np.arange(len(b) + 1, dtype=np.int32) * p.shape[1]).buffers()[1]
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.BinaryArray.from_buffers(pa.binary(), len(b), [None, cut, pa.py_buffer(p.tobytes())])], ["id", "label", "planes"])

    index = stored(rows.select("id", "label", "q").mapInArrow(packed, "id bigint, label bigint, planes binary"), "planes")
    anchors = rows.filter("anchor").select("id", "label", "q")

    def lots(a: pa.Table, c: pa.Table) -> Iterator[tuple[range, np.ndarray]]:
        """Lots of anchors with the scores of all candidates of the block."""
        data, _ = flat(c["planes"])
        p, q = data.reshape(len(c), bits, groups), matrix(a["q"]).astype(kind)
        for s in range(0, len(a), AT_ONCE):
            yield range(s, min(s + AT_ONCE, len(a))), scores(subset_sums(q[s : s + AT_ONCE], kind), p)

    def table_of(parts: list, names: list[str]) -> pa.Table:
        columns = [np.concatenate(x) if len(parts) else np.zeros(0, np.int64) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * len(names)
        return pa.table(dict(zip(names, [pa.array(x.astype(np.int64)) for x in columns], strict=True)))

    def positives(a: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(c):
            c = c.sort_by("id")
            ids, labels, own = (x.to_numpy() for x in (c["id"], c["label"], a["id"]))
            of = {v: np.flatnonzero(labels == v) for v in np.unique(labels)}
            for lot, s in lots(a, c):
                for k in lot:
                    at = of.get(a["label"][k].as_py(), np.zeros(0, np.int64))
                    at = at[ids[at] != own[k]]
                    at = first(at, s[at, k - lot.start], n_positives)
                    found.append((np.full(len(at), own[k]), ids[at], s[at, k - lot.start]))
        return table_of(found, ["anchor_id", "positive_id", "positive_score"])

    best = cells(anchors, index, size.anchors, size.n, [], positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n_positives)
    of_anchor = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("positive_id").alias("others"), F.collect_list("positive_score").alias("reach"))  # n_positives at most
    asked = stored(anchors.join(of_anchor, "id"), "positives")

    def negatives(a: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(c):
            c = c.sort_by("id")
            ids, labels, own = (x.to_numpy() for x in (c["id"], c["label"], a["id"]))
            others, reach = a["others"].to_pylist(), a["reach"].to_pylist()
            for lot, s in lots(a, c):
                for k in lot:
                    mine = s[:, k - lot.start]
                    least_of = [least * (p // 100) + -(-least * (p % 100) // 100) for p in reach[k]]
                    at = np.flatnonzero((mine >= min(least_of)) & (mine <= max(reach[k])) & (labels != a["label"][k].as_py()))
                    if not len(at):
                        continue
                    at = at[np.argsort(-mine[at], kind="stable")]
                    down = -mine[at].astype(np.int64)
                    for o, p, low in zip(others[k], reach[k], least_of, strict=True):
                        s0 = np.searchsorted(down, -p, "left")
                        near = at[s0 : min(s0 + n_negatives, np.searchsorted(down, -low, "right"))]
                        n = len(near)
                        found.append((np.full(n, own[k]), np.full(n, o), ids[near], np.full(n, p), mine[near]))
        return table_of(found, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    near = cells(asked, index, size.anchors, size.n, ["others", "reach"], negatives, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11(spark, embeddings: DataFrame) -> DataFrame:
    """Every hundredth row is an anchor; of every seventh the label is off by one."""
    off = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(embeddings.select("vec_id", "embedding", off.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b, s.b AS c, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, b AS positive_id, r::INTEGER AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5
"""
