"""Packing tokenised documents into sequences of bounded length: pattern packing by non-negative least squares.

Pieces of one length are alike, so what is planned are patterns: multisets of a few lengths that fill a sequence exactly. How
often each pattern is repeated is fitted to the histogram of lengths by non-negative least squares and rounded within what
there is; what is left over is packed by filling a sequence with the longest piece that still fits. The histogram has as many
bins as a sequence has tokens, so the plan is made on the driver and is as large for any corpus. A piece finds its place by
its rank among the pieces of its length; ranks come from counts of the parts that were written, so nothing is sorted.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, unused

#: Steps of the solver; pieces in a pattern at most; bits of a rank.
STEPS, MOST_PIECES, RANK_BITS = 400, 3, 44
_coders: dict[str, Coder] = {}


class Coder:
    """Ids of a byte-level BPE tokenizer, as little-endian 32-bit integers.

    Where the file's merges are in the order of their ids, a text is merged by rank, which gives the same ids several times
    faster. Texts that hold a special token's name, or letters of blocks that Unicode still adds to, are the tokenizer's own work.
    """

    #: Fixed value: how byte-level BPE splits a text.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    STABLE = re.compile("[\x00-\u024f\u0370-\u0373\u0391-\u03a1\u03a3-\u03c9\u0400-\u04ff\u2000-\u2bff\u3000-\u3020\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001faff]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.ranked = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}  # how byte-level BPE names bytes
        whole = json.loads(self.tokenizer.to_str())
        split, model = whole["pre_tokenizer"] or {}, whole["model"]
        names = {n: i for n, i in model.get("vocab", {}).items() if n not in self.special}
        made = [names["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model.get("merges", [])]
        plain = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not whole["normalizer"] and model["type"] == "BPE" and not model["ignore_merges"]
        if plain and sorted(made) == made and set().union(*names) <= set(byte):
            self.ranked = tiktoken.Encoding("ranked", pat_str=self.SPLIT, mergeable_ranks={bytes(byte[c] for c in n): i for n, i in names.items()}, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.ranked and self.STABLE.fullmatch(text) and not any(s in text for s in self.special):
            return np.frombuffer(array("I", self.ranked.encode_ordinary(text)), np.uint32).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def tokenised(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit): the ids of each row's text and ``end``.

    A row of more than ``capacity`` ids is cut: pieces of ``capacity`` ids, the first one shorter where they don't come out
    even. A null text is empty, so its ids are ``end`` alone. Rows that repeat an id, null ids and any other columns: each
    row is a document of its own; only these two columns are read.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for batch in batches:
            of, piece, start, ids, held = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                columns = [batch["doc_id"].take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, schema.names)

            for row, t in enumerate(batch["text"].to_pylist()):
                raw = code(t or "") + last
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    of.append(row), piece.append(k), start.append(s), ids.append(raw[4 * s : 4 * e])
                held += len(raw)
                if held > 16 << 20:
                    yield out()
                    of, piece, start, ids, held = [], [], [], [], 0
            if of:
                yield out()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def patterns(lengths: np.ndarray, capacity: int, most: int = MOST_PIECES) -> np.ndarray:
    """All multisets of up to ``most`` of the lengths whose sum is ``capacity``: rows of descending lengths, 0 for none."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    lengths = np.flatnonzero(have)
    rows = [np.zeros((0, most), np.int64)]

    def grow(picked: np.ndarray, left: np.ndarray, k: int) -> None:
        """Rows of k picked lengths, with what each has left to fill."""
        ends = (left > 0) & (left <= (picked[:, -1] if k else capacity)) & have[left]
        rows.append(np.pad(np.column_stack([picked[ends], left[ends]]), ((0, 0), (0, most - k - 1))))
        if k + 1 < most:
            for i in range(0, len(left), 4096):
                p, rest = picked[i : i + 4096], left[i : i + 4096]
                r, c = np.nonzero((lengths[None, :] < rest[:, None]) & (lengths[None, :] <= (p[:, -1] if k else np.full(len(p), capacity))[:, None]) & (lengths[None, :] * (most - k) >= rest[:, None]))
                if len(r):
                    grow(np.column_stack([p[r], lengths[c]]), rest[r] - lengths[c], k + 1)

    grow(np.zeros((1, 0), np.int64), np.array([capacity]), 0)
    return np.concatenate(rows)


def repeats(table: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats of the patterns whose lengths come nearest to ``counts`` (by length), weighted by length: accelerated projected gradient."""
    if not len(table):
        return np.zeros(0)
    n, weight = len(counts), np.arange(len(counts)) / (len(counts) - 1)
    weight[0] = 0
    used = lambda x: np.bincount(table.ravel(), np.repeat(x, table.shape[1]), n)
    back = lambda r: (weight * r)[table].sum(1)
    v = np.ones(len(table))
    for _ in range(20):
        v = back(used(v / np.linalg.norm(v)))
    step, total = 1 / (1.02 * np.linalg.norm(v)), max(1, counts.sum())
    target, x, y, t = counts / total, np.zeros(len(table)), np.zeros(len(table)), 1.0
    for _ in range(steps):
        new = np.maximum(y - step * back(used(y) - target), 0)
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / later * (new - x), new, later
    return x * total


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (descending lengths) and how often each is repeated; ``counts[n]`` is how many pieces have n ids. Every piece has a place, and no place is empty."""
    capacity, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    table = patterns(np.flatnonzero(counts[1:]) + 1, capacity)
    fitted = repeats(table, counts)
    for rounded in (np.floor(fitted).astype(np.int64), np.ceil(fitted - 0.25).astype(np.int64) - np.floor(fitted).astype(np.int64)):
        for p in np.argsort(-fitted, kind="stable"):
            if rounded[p] > 0:
                lengths, times = np.unique(table[p][table[p] > 0], return_counts=True)
                r = int(min(rounded[p], (left[lengths] // times).min()))
                if r > 0:
                    left[lengths] -= r * times
                    out.append((sorted(np.repeat(lengths, times).tolist(), reverse=True), r))
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        row, space = [longest], capacity - longest
        have = np.flatnonzero(left)
        taken = {longest: 1}
        while space:
            have = have[have <= space]
            while len(have) and left[have[-1]] <= taken.get(int(have[-1]), 0):
                have = have[:-1]
            if not len(have):
                break
            n = int(have[-1])
            m = int(min(space // n, left[n] - taken.get(n, 0)))
            row += [n] * m
            taken[n], space = taken.get(n, 0) + m, space - m * n
        r = int(min(left[n] // m for n, m in taken.items()))
        for n, m in taken.items():
            left[n] -= r * m
        out.append((row, r))
    return out


def places(found: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length and rank: where a range of ranks begins, its first sequence, pieces of the length in a sequence, their offset."""
    rows, sequence, cursor = [], 0, [0] * (capacity + 1)
    for lengths, times in found:
        at = 0
        for n in dict.fromkeys(lengths):
            m = lengths.count(n)
            rows.append((n << RANK_BITS | cursor[n], cursor[n], sequence, m, at))
            cursor[n] += m * times
            at += m * n
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("key", "rank", "sequence", "each", "offset"))}


def placed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Their ``length`` (1 to ``capacity``) decides; other columns are carried along.

    The offsets of a sequence are gapless from 0. Columns called sequence_id or offset are replaced. No rows: no rows.
    """
    rows = pieces.drop("sequence_id", "offset")
    kept = rows.columns
    part, nth, before = (unused(c, rows) for c in ("part", "nth", "before"))
    with_place = T.StructType([*rows.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(nth, T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            n = b["length"].to_numpy()
            if len(n) and not (n.min() >= 1 and n.max() <= capacity):
                raise ValueError(f"a piece has from 1 to {capacity} ids")
            order = np.argsort(n, kind="stable")
            first = np.flatnonzero(np.r_[True, n[order][1:] != n[order][:-1]]) if len(n) else np.zeros(0, np.int64)
            at = np.empty(len(n), np.int64)
            at[order] = np.arange(len(n)) - np.repeat(first, np.diff(np.r_[first, len(n)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), number, np.int32)), pa.array(seen[n] + at)], with_place.names)
            seen += np.bincount(n, minlength=capacity + 1)

    pieces = stored(rows.mapInArrow(numbered, with_place), "pieces")
    each = pieces.groupBy(part, "length").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("length").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    first = stored(each.withColumn(before, F.coalesce(F.sum("n").over(upto), F.lit(0))), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    where = places(plan(counts), capacity)
    out = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b["length"].to_numpy(), b[nth].to_numpy() + b[before].to_numpy()
            i = np.searchsorted(where["key"], n << RANK_BITS | rank, "right") - 1
            within = rank - where["rank"][i]
            sequence, at = where["sequence"][i] + within // where["each"][i], where["offset"][i] + within % where["each"][i] * n
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(sequence), pa.array(at)], out.names)

    ranked = pieces.join(first.select(F.col(part).alias("__part"), F.col("length").alias("__length"), before), (F.col(f"`{part}`") == F.col("__part")) & (F.col("length") == F.col("__length")))
    return ranked.select(*[f"`{c}`" for c in kept], nth, before).mapInArrow(put, out)


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2) -> DataFrame:
    """The pieces of ``tokenised`` with their ids, ``sequence_id`` and ``offset``."""
    return placed(tokenised(docs, tokenizer, doc_id, text, capacity, end), capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the pieces of each sequence (bounded by its length) joined in their order."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(inside, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op12(spark, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of 1024; the digest comes from the ids of each piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = stored(tokenised(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "tokenised")
    return placed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
