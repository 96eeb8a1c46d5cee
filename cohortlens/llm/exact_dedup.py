"""Exact duplicates by a tree merge of sorted digest runs.

Every task packs its rows into a run: entries sorted by digest, one for each digest, with its best row, count and what
verifies it. In each round runs meet in groups of ``FAN``: each node takes one slice of the digest range from each run of its
group and merges them, two and two, in the order of their digests. Of a digest that both sides have the better row stays,
after a check that length and second hash agree. After the rounds each node holds one slice of all digests, merged over all
runs. A group of copies is one entry of each run, so no node sees more than ``FAN`` entries of one digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, flat, stored

#: 3 bits: runs that meet in a node. A run is written in parts of so many rows.
BITS, FAN, RUN_ROWS = 3, 8, 500_000
#: A digest with over 1 / HOT of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 500
#: digest; its best row: code points (negative), whether its id is null, id, number; rows with the digest; length and second hash.
ENTRY = np.dtype([("digest", "S32"), ("neg", "<i8"), ("none", "u1"), ("id", "<i8"), ("uid", "<i8"), ("n", "<i8"), ("bytes", "<i8"), ("check", "<i8")])
BEST = ("neg", "none", "id", "uid")


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Thin rows: uid (a row's number), doc_id, n_chars of the original, digest of the normalised text and, to verify it, length and a second hash."""
    thin = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), normalised(text).alias("t"))
    return stored(thin.select("uid", "doc_id", "n_chars", F.sha2("t", 256).alias("digest"), F.octet_length("t").cast("long").alias("bytes"), F.xxhash64("t").alias("check")), "digests")


def verify(x: np.ndarray, y: np.ndarray) -> None:
    if ((x["bytes"] != y["bytes"]) | (x["check"] != y["check"])).any():
        raise ValueError("different texts have one SHA-256 digest")


def sorted_run(rows: np.ndarray) -> np.ndarray:
    """The rows as a run."""
    rows = rows[np.lexsort([rows[k] for k in (*BEST[::-1], "digest")])]
    first = np.flatnonzero(np.r_[True, rows["digest"][1:] != rows["digest"][:-1]])
    verify(rows, rows[first].repeat(np.diff(np.r_[first, len(rows)])))
    out = rows[first]
    out["n"] = np.add.reduceat(rows["n"], first)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One run of two."""
    if not len(a) or not len(b):
        return a if len(a) else b
    at = np.searchsorted(a["digest"], b["digest"])
    same = a["digest"][np.minimum(at, len(a) - 1)] == b["digest"]
    x, y = a[at[same]], b[same]
    verify(x, y)
    less, equal = np.zeros(len(x), bool), np.ones(len(x), bool)
    for k in BEST:
        less |= equal & (y[k] < x[k])
        equal &= y[k] == x[k]
    z = np.where(less, y, x)
    z["n"] = x["n"] + y["n"]
    a = a.copy()
    a[at[same]] = z
    return np.insert(a, at[~same], b[~same])


def sliced(run: np.ndarray, number: int, k: int, rounds: int) -> Iterator[tuple[int, bytes]]:
    """The run's slices for round k: the node of each, and its entries."""
    head = np.frombuffer(run["digest"].astype("S4").tobytes(), ">u4") if len(run) else np.zeros(0, ">u4")
    slice_ = head.astype(np.int64) >> (32 - BITS * k)
    cut = np.flatnonzero(np.r_[True, slice_[1:] != slice_[:-1]]) if len(run) else []
    for s, e in zip(cut, [*cut[1:], len(run)], strict=True):
        yield (number >> (BITS * k)) << (BITS * rounds) | int(slice_[s]), run[s:e].tobytes()


def tree_merge(thin: DataFrame, n_runs: int) -> DataFrame:
    """The rows of ``digests`` -> one row for each digest: d, keep_id, keep_uid, group_size."""
    rounds = 1
    while FAN**rounds < n_runs and BITS * (rounds + 1) <= 32:
        rounds += 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() % FAN**rounds, [], 0

        def out():
            rows = list(sliced(sorted_run(np.concatenate(held)), number, 1, rounds))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "entries"])

        for batch in batches:
            e = np.zeros(len(batch), ENTRY)
            e["digest"] = np.frombuffer(bytes.fromhex("".join(batch["digest"].to_pylist())), "S32")
            e["neg"], e["n"] = -batch["n_chars"].to_numpy(), 1
            e["none"], e["id"] = batch["doc_id"].is_null().to_numpy(zero_copy_only=False), batch["doc_id"].fill_null(0).to_numpy()
            for k in ("uid", "bytes", "check"):
                e[k] = batch[k].to_numpy()
            held.append(e)
            size += len(e)
            if size >= RUN_ROWS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def node(t: pa.Table) -> np.ndarray:
        runs = []
        for chunk in t["entries"].chunks:
            data, offs = flat(chunk)
            runs += [np.frombuffer(data[s:e].tobytes(), ENTRY) for s, e in zip(offs[:-1], offs[1:], strict=True)]
        while len(runs) > 1:
            runs = [merged(runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0]

    def onward(k: int):
        def to_next(t: pa.Table) -> pa.Table:
            # The group's number among the groups of its round is the run's number in the next.
            rows = list(sliced(node(t), (t["node"][0].as_py() >> (BITS * rounds)) << (BITS * k), k + 1, rounds))
            return pa.table({"node": pa.array([r[0] for r in rows], pa.int64()), "entries": pa.array([r[1] for r in rows], pa.binary())})

        return to_next

    level = thin.mapInArrow(packed, "node bigint, entries binary")
    for k in range(1, rounds):
        level = level.groupBy("node").applyInArrow(onward(k), "node bigint, entries binary")

    def last(t: pa.Table) -> pa.Table:
        e = node(t)
        raw = np.ascontiguousarray(e["digest"]).tobytes().hex()
        d = pa.array([raw[i : i + 64] for i in range(0, len(raw), 64)], pa.string())
        return pa.table({"d": d, "keep_id": pa.array(e["id"], mask=e["none"].astype(bool)), "keep_uid": pa.array(np.ascontiguousarray(e["uid"])), "group_size": pa.array(np.ascontiguousarray(e["n"]))})

    return level.groupBy("node").applyInArrow(last, "d string, keep_id bigint, keep_uid bigint, group_size bigint")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id (a long), keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts (whitespace deleted; null is empty) the row with the most code points in the original stays, then the
    smallest id (null ids last), then the first row read; so of rows that repeat id and text one stays. Other columns are
    not read. No rows: no rows.
    """
    thin = digests(docs, doc_id, text)
    n = thin.agg(F.count(F.lit(1)).alias("n"), F.max(F.shiftright("uid", 33)).alias("run")).first()
    winners = stored(tree_merge(thin, (n.run or 0) + 1), "winners")
    hot = winners.filter(F.col("group_size") * HOT > n.n).select("d", F.col("keep_id").alias("hot_id"), F.col("keep_uid").alias("hot_uid"), F.col("group_size").alias("hot_size"))
    marked = thin.join(F.broadcast(hot), F.col("digest") == F.col("d"), "left").drop("d")
    cold = marked.filter("hot_size is null").join(winners, F.col("digest") == F.col("d"))
    found = cold.select("doc_id", "digest", "uid", "keep_id", "keep_uid", "group_size").unionByName(
        marked.filter("hot_size is not null").select("doc_id", "digest", "uid", F.col("hot_id").alias("keep_id"), F.col("hot_uid").alias("keep_uid"), F.col("hot_size").alias("group_size"))
    )
    return found.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("digest").alias("text_sha256"))


def op7(spark, docs: DataFrame) -> DataFrame:
    return exact_groups(docs)


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
