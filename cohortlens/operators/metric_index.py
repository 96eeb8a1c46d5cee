"""A metric index: rows in cells with a centre and a radius, so that only those meet whose distance can be small enough.

Cosine is searched as the angle between unit vectors, which is a metric like the Manhattan (``l1``) and Euclidean (``l2``)
distance. For a row x and a cell with centre c and radius r, no member of the cell is nearer to x than d(x, c) - r. A search
with a limit opens a cell only where that bound stays below the limit; a search for the k nearest gets its limit, for each
row, from the cells around it. What is left out can't be in the result, so results are exact; how much is left out depends on
how the data cluster. Centres are drawn from a bounded sample and moved a few times to the mean of what is nearest; every
row is indexed.

Rows meet in tiles: those of either side are dealt by hash to a few parts, and a tile is one part of each, so that a row is
sent once for each part of the other side, however many cells it opens. Within a tile, blocks of cells and rows that have
nothing open are skipped, and what may count is found in single precision, within its error, before it is computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import unit
from .scratch import stored

#: Rows of a block that meet at once; centres at most, and their bytes; rows drawn for each centre; moves of the centres.
BLOCK, MOST_CENTRES, CENTRE_BYTES, DRAWN, MOVES = 1024, 4096, 16 << 20, 8, 3
#: Parts of a side that is of one class; bytes of vectors in a part, beyond which there are more parts; classes whose sizes are broadcast.
PARTS, TILE_BYTES, MOST_CLASSES = 8, 64 << 20, 10_000
#: What rounding may add to a distance; cosines near 1 have angles of few digits.
SLACK = 1e-6
METRICS = ("cosine", "l1", "l2")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of arrays of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def closeness(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Cosine of unit vectors, or the negative distance; to 12 digits, so that equal vectors are equally close wherever they meet."""
    if metric == "cosine":
        return (x @ y.T).round(12)
    far = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = x[:, i, None] - y[:, i]
        far += np.abs(d) if metric == "l1" else d * d
    return -(far if metric == "l1" else np.sqrt(far)).round(12)


def distance(close: np.ndarray, metric: str) -> np.ndarray:
    return np.arccos(np.clip(close, -1, 1)) if metric == "cosine" else -close


def plain(df: DataFrame, key: str, vector: str, metric: str, keep: Sequence[str] = ()) -> DataFrame:
    """id, v (doubles, of length 1 for cosine) and ``keep``; rows without a vector are left out."""
    if metric not in METRICS:
        raise ValueError(f"no metric is called {metric}")
    v = unit(F.col(vector)) if metric == "cosine" else F.transform(vector, lambda x: x.cast("double"))
    return df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.alias("v"), *keep)


@dataclass
class Index:
    """Centres, and for each its radius and how many rows it has; ``rows``: id, v, kept columns, cell."""

    metric: str
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    rows: DataFrame
    keep: list[str]


def centres_of(sample: np.ndarray, n: int, metric: str) -> np.ndarray:
    """``n`` rows of the sample, moved to the mean of what is nearest to each."""
    c = np.unique(sample, axis=0)
    c = c[np.random.default_rng(7).permutation(len(c))[:n]]
    for _ in range(MOVES):
        near = np.concatenate([closeness(sample[i : i + BLOCK], c, metric).argmax(1) for i in range(0, len(sample), BLOCK)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        count = np.bincount(near, minlength=len(c))
        if metric == "cosine":
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
        else:
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def build(df: DataFrame, key: str, vector: str, metric: str = "cosine", keep: Sequence[str] = (), n_centres: int | None = None) -> Index:
    """All rows of ``df`` that have a vector, in about sqrt(rows) cells (``n_centres``; 4096 and 16 MB of centres at most)."""
    rows = plain(df, key, vector, metric, keep)
    n = df.count()
    wanted = n_centres or max(1, math.isqrt(n))
    drawn = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(DRAWN * min(wanted, MOST_CENTRES)).toPandas()["v"]
    out = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    if not len(drawn):
        none = np.zeros(0)
        return Index(metric, np.zeros((0, 0)), none, none, df.sparkSession.createDataFrame([], out), list(keep))
    sample = np.stack(drawn.to_numpy())
    centres = centres_of(sample, max(1, min(wanted, MOST_CENTRES, CENTRE_BYTES // (8 * sample.shape[1]))), metric)
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, cells, far = matrix(b["v"]), [], []
            for i in range(0, len(v), BLOCK):
                close = closeness(v[i : i + BLOCK], sent.value, metric)
                cells.append(close.argmax(1))
                far.append(distance(close.max(1), metric))
            if len(v):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(far))], out.names)

    placed = stored(rows.mapInArrow(put, out), "index")
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r.cell], count[r.cell] = r.radius, r.n
    return Index(metric, centres, radius, count, placed, list(keep))


def visits(rows: DataFrame, index: Index, limit: str | float | None = None, least: int = 0, after: str | None = None, but: str | None = None) -> DataFrame:
    """``rows`` (id, v, ...) with ``cells``, a bit for each: those in which a row may be as near as ``limit`` (a distance, or a column of distances; NULL: any).

    ``least``: instead, the nearest cells that hold so many rows together. ``after``: only cells from the one that this column
    names on. ``but``: not those in this column of bits.
    """
    m, metric = len(index.centres), index.metric
    out = T.StructType([*(f for f in rows.schema.fields if f.name != but), T.StructField("cells", T.BinaryType())])
    names = [f.name for f in out.fields[:-1]]
    sent = rows.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.count))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, count = sent.value
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                far = distance(closeness(matrix(part["v"]), centres, metric), metric)
                if least:
                    order = np.argsort(np.where(count > 0, far, np.inf), axis=1, kind="stable")
                    upto = np.cumsum(count[order], axis=1) - count[order]
                    use = np.zeros(far.shape, bool)
                    np.put_along_axis(use, order, (upto < least) & (count[order] > 0), axis=1)
                else:
                    most = np.full(part.num_rows, np.inf) if limit is None else part[limit].fill_null(np.inf).to_numpy(zero_copy_only=False) if isinstance(limit, str) else np.full(part.num_rows, limit)
                    use = (far - radius <= most[:, None] + SLACK) & (count > 0)
                if after:
                    use &= np.arange(m)[None, :] >= part[after].to_numpy()[:, None]
                if but:
                    use &= ~bits(part[but], m)
                cells = pa.array([r.tobytes() for r in np.packbits(use, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], cells], out.names)

    return rows.mapInArrow(look, out)


def bits(column: pa.Array, m: int) -> np.ndarray:
    """The first ``m`` bits of each value as truth values."""
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1, count=m).astype(bool)


def opened(visiting: DataFrame) -> int:
    """Pairs of a row and a cell that a search opens; without bounds they were rows times cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.unpackbits(np.frombuffer(b"".join(b["cells"].to_pylist()), np.uint8)).sum())], pa.int64())], ["n"])

    return visiting.select("cells").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def manhattan(x: np.ndarray, y: np.ndarray, rows: int = 64) -> np.ndarray:
    """Manhattan distances, a few rows at a time, so that sums stay near the processor."""
    out, y = np.zeros((len(x), len(y)), x.dtype), np.ascontiguousarray(y.T)
    d = np.empty((rows, y.shape[1]), x.dtype)
    for i in range(0, len(x), rows):
        part = out[i : i + rows]
        for k in range(len(y)):
            e = np.subtract(x[i : i + rows, k, None], y[k], out=d[: len(part)])
            part += np.abs(e, out=e)
    return out


def likely(x: np.ndarray, y: np.ndarray, metric: str, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of all pairs as close as ``least`` of their row at least, and of few others: single precision and a bound on its error."""
    u = (x.shape[1] + 8) * 2.4e-7
    with np.errstate(over="ignore", invalid="ignore"):  # what isn't a number may count
        if metric == "cosine":
            return np.nonzero(~(x.astype(np.float32) @ y.astype(np.float32).T < (least - u).astype(np.float32)[:, None]))
        if metric == "l1":
            size = np.abs(x).sum(1) + np.abs(y).sum(1).max()
            return np.nonzero(~(manhattan(x.astype(np.float32), y.astype(np.float32)) > (-least + u * size).astype(np.float32)[:, None]))
        middle = y.mean(0)
        x, y = x - middle, y - middle
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        most = least * least + u * (np.sqrt(xx) + np.sqrt(yy.max())) ** 2
        # |y|^2 - 2 x y against most - |x|^2
        return np.nonzero(~(yy.astype(np.float32) - 2 * (x.astype(np.float32) @ y.astype(np.float32).T) > (most - xx).astype(np.float32)[:, None]))


def exactly(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """``closeness`` of each row with the row in its place."""
    if metric == "cosine":
        return np.einsum("ij,ij->i", x, y).round(12)
    d = x - y
    return -(np.abs(d).sum(1) if metric == "l1" else np.sqrt(np.einsum("ij,ij->i", d, d))).round(12)


def best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row where its k largest values are, largest first, ties by place; and the values."""
    if k > 8:
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(s, at, 1)
    s, rows, at, top = s.copy(), np.arange(len(s)), [], []
    for _ in range(min(k, s.shape[1])):
        at.append(s.argmax(1))
        top.append(s[rows, at[-1]])
        s[rows, at[-1]] = -np.inf
    return np.stack(at, axis=1), np.stack(top, axis=1)


class Best:
    """The ``k`` closest residents of each visitor of a tile, ties by the smaller id; ``groups``: the ``k`` best groups, each by its closest resident, ties by the smaller group."""

    def __init__(self, n: int, k: int, metric: str, reach: np.ndarray | None, itself: bool, groups: bool = False) -> None:
        self.k, self.metric, self.itself, self.groups = k, metric, itself, groups
        self.sim, self.other, self.group = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        far = np.full(n, np.inf) if reach is None else reach + SLACK
        self.floor = np.where(far < np.pi, np.cos(np.minimum(far, np.pi)), -np.inf) if metric == "cosine" else -far

    def step(self, rows: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, group: np.ndarray | None, use: np.ndarray) -> None:
        """Visitors ``rows`` meet residents that are sorted by id where ``use`` is true."""
        least = np.maximum(self.sim[rows, -1], self.floor[rows])
        known = np.flatnonzero(least > -np.inf)
        r, c = likely(x[known], y, self.metric, least[known]) if len(known) else (known, known)
        if len(r) * 16 > len(x) * len(y) or len(known) < len(rows):
            dense = np.setdiff1d(np.arange(len(rows)), known) if len(r) * 16 <= len(x) * len(y) else np.arange(len(rows))
            s = closeness(x[dense], y, self.metric)
            s[~use[dense]] = -np.inf
            if not self.itself:
                s[own[dense, None] == ids[None, :]] = -np.inf
            found = [(known[r], c)] if len(dense) < len(rows) else []
            for p in [np.flatnonzero(group == g) for g in np.unique(group)] if self.groups else [np.arange(len(ids))]:
                at, top = best_columns(s[:, p], 1 if self.groups else self.k)
                i, j = np.nonzero(top > -np.inf)
                found.append((dense[i], p[at[i, j]]))
            r, c = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        else:
            r = known[r]
        keep = use[r, c] if self.itself else use[r, c] & (own[r] != ids[c])
        r, c = r[keep], c[keep]
        sim = exactly(x[r], y[c], self.metric)
        keep = sim >= least[r]
        if keep.any():
            self.add(rows[r[keep]], sim[keep], ids[c[keep]], group[c[keep]] if self.groups else np.zeros(keep.sum(), np.int64))

    def add(self, row: np.ndarray, sim: np.ndarray, other: np.ndarray, group: np.ndarray) -> None:
        old = np.unique(row)
        row, sim, other, group = (np.concatenate(z) for z in ((np.repeat(old, self.k), row), (self.sim[old].ravel(), sim), (self.other[old].ravel(), other), (self.group[old].ravel(), group)))
        order = np.lexsort((other, -sim, group, row) if self.groups else (other, -sim, row))
        order = order[sim[order] > -np.inf]
        if self.groups:
            a, b = row[order], group[order]
            order = order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]]
            order = order[np.lexsort((group[order], -sim[order], row[order]))]
        a = row[order]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.sim[old] = -np.inf
        for mine, new in ((self.sim, sim), (self.other, other), (self.group, group)):
            mine[row[order], rank] = new[order]

    def found(self) -> tuple[np.ndarray, ...]:
        """Visitor, resident's id, group, closeness."""
        r, k = np.nonzero(self.sim > -np.inf)
        return r, self.other[r, k], self.group[r, k], self.sim[r, k]


def meet(visiting: DataFrame, index: Index, fn: Callable, schema: str, by: Sequence[str] = ()) -> DataFrame:
    """``fn(visitors, residents, blocks)`` as Arrow tables for each tile (of one value of ``by``); neither is empty.

    ``blocks()`` yields what meets in the tile: places of visitors, places of residents (sorted by id), and where a visitor opens
    the resident's cell. ``visiting`` is written already.
    """
    m, size = len(index.count), BLOCK
    tile = max(size, TILE_BYTES // (8 * max(1, index.centres.shape[1])))
    come = visiting.filter(F.col("cells") != F.lit(bytes(-(-m // 8))))
    residents = index.rows.drop("far")
    nv, nr = come.count(), int(index.count.sum())

    def parts(n: Column, total: int) -> Column:
        spread = F.least(F.ceil(n / size), F.ceil(PARTS * F.sqrt(n / max(1, total))))
        return F.greatest(F.lit(1), F.ceil(n / tile), spread).cast("int")

    if by:
        sizes = come.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(residents.groupBy(*by).agg(F.count(F.lit(1)).alias("m")), [*by])
        sizes = stored(sizes.select(*by, parts(F.col("n"), nv).alias("nv"), parts(F.col("m"), nr).alias("nr")), "sizes")
        sizes = F.broadcast(sizes) if sizes.count() <= MOST_CLASSES else sizes
        come, residents = come.join(sizes, [*by]), residents.join(sizes, [*by])
    else:
        sizes = [parts(F.lit(n), n).alias(name) for n, name in ((nv, "nv"), (nr, "nr"))]
        come, residents = come.select("*", *sizes), residents.select("*", *sizes)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    come = come.withColumn("i", place("nv")).withColumn("j", every("nr")).drop("nv", "nr")
    residents = residents.withColumn("j", place("nr")).withColumn("i", every("nv")).drop("nv", "nr")
    none = to_arrow_schema(T._parse_datatype_string(schema))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return none.empty_table()
        cell, ids = y["cell"].to_numpy(), y["id"].to_numpy()
        order = np.lexsort((ids, cell))
        chunks = [c[np.argsort(ids[c], kind="stable")] for c in (order[i : i + size] for i in range(0, len(order), size))]
        open_bits = x["cells"].combine_chunks()

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for i in range(0, len(x), size):
                use = bits(open_bits.slice(i, size), m)
                for c in chunks:
                    cells, at = np.unique(cell[c], return_inverse=True)
                    own = use[:, cells]
                    rows = np.flatnonzero(own.any(1))
                    if len(rows):
                        yield i + rows, c, own[rows][:, at]

        return fn(x, y, blocks).cast(none)

    keys = ["i", "j", *by]
    return come.groupBy(*keys).cogroup(residents.groupBy(*keys)).applyInArrow(run, schema)
