"""Repeated passages by bucket-pointer refinement over sampled suffixes.

A window of ``LENGTH`` bytes is told by its anchor: of the 51 50-grams in it, the one with the smallest hash. Equal windows
have equal anchors at the same place, so suffixes need to be sorted only at anchors (about one position in 26), and only
where the anchor's 50-gram occurs again. Texts around such anchors meet by anchor. There the buckets of equal 8-grams are
refined by the buckets at later offsets until they stand for whole 50-grams, and then, one byte more at a time to the right
and to the left, by reusing the identifiers of the step before; a window is one pair of such identifiers. Of equal windows
all but the first are removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, flat, parts_for, prefix_hash, range_hash, slices, small_batches, text_bytes, unpack, unused

LENGTH, GRAM = 100, 50
#: Windows that may share an anchor.
SPAN = LENGTH - GRAM + 1
#: The places in one piece fit into so many bits; longer texts are cut into overlapping pieces.
PLACE = 20
#: Bits of the filter of repeated anchors: 4 for each anchor expected, at most 2^30 (128 MB). A fuller filter lets more through, nothing less.
MOST_BITS = 30
NO_ID = -(1 << 63)
#: An anchor in more places is frequent: its windows are dealt out one by one, by all their bytes. A coarser filter tells which (one bit for 2^8 of the others).
FREQUENT, COARSE = 4096, 8


def pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets of its texts, number of the first text, where in that text the piece begins)."""
    most = (1 << PLACE) - 1
    for i, j in slices(offs, most):
        if offs[j] - offs[i] <= most:
            yield data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i, 0
            continue
        for at in range(0, int(offs[j] - offs[i]), most - LENGTH + 1):
            part = data[offs[i] + at : min(offs[j], offs[i] + at + most)]
            if len(part) >= LENGTH:
                yield part, np.array([0, len(part)]), i, at


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first window, number of windows, anchor (places in ``data``) and anchor's hash: the windows of each anchor, none over the end of a text."""
    n = len(data)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    h = range_hash(prefix_hash(data), at, at + GRAM)
    low = np.uint64((1 << PLACE) - 1)
    key = (h & ~low) | at.astype(np.uint64)
    width = 1
    while width * 2 <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: n - LENGTH + 1], key[SPAN - width : SPAN - width + n - LENGTH + 1])
    anchor = (key & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offs) >= LENGTH)
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long + 1] - LENGTH + 1, -1)
    good = np.cumsum(inside)[: len(anchor)] > 0
    text = np.zeros(len(anchor), bool)
    text[offs[:-1][offs[:-1] < len(anchor)]] = True
    new = good & np.r_[True, (anchor[1:] != anchor[:-1]) | ~good[:-1] | text[1:]]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(good & np.r_[new[1:] | ~good[1:], True])
    return first, stop - first + 1, anchor[first], h[anchor[first]]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(36)) % np.uint64(n)).astype(np.int32)


def bit_of(bucket: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    return (low.astype(np.uint64) + bucket.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64((1 << bits) - 1)


def repeated_anchors(texts: DataFrame, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each anchor hash that occurs twice at least, over all texts; coarser bits for the frequent ones."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            h = np.concatenate(held)
            rows = list(by_bucket(bucket_of(h, n), h.astype(np.uint32)))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "data": pa.array([c[0] for _, c in rows], pa.binary())})

        for batch in batches:
            for part, offs, _, _ in pieces(*flat(batch["t"])):
                held.append(runs(part, offs)[3])
                size += len(held[-1])
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    block_bits = min(bits, 20)

    def again(t: pa.Table) -> pa.Table:
        u, c = np.unique(unpack(t["data"], np.uint32), return_counts=True)
        place = bit_of(np.full(1, t["bucket"][0].as_py()), u, bits)
        rows = []
        for kind, b in enumerate((place[c > 1], place[c > FREQUENT] >> np.uint64(COARSE))):
            rows += [(kind, *r) for r in by_bucket((b >> np.uint64(block_bits)).astype(np.int32), (b & np.uint64((1 << block_bits) - 1)).astype(np.uint32))]
        return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2][0] for r in rows], pa.binary())})

    def filled(t: pa.Table) -> pa.Table:
        flags = np.zeros(1 << block_bits, bool)
        flags[unpack(t["data"], np.uint32)] = True
        return pa.table({"kind": t["kind"][:1], "block": t["block"][:1], "data": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    found = texts.select("t").mapInArrow(packed, "bucket int, data binary").groupBy("bucket").applyInArrow(again, "kind int, block int, data binary")
    size = (1 << block_bits) >> 3
    out = np.zeros((1 << bits) >> 3, np.uint8), np.zeros(max(size, (1 << bits >> COARSE) >> 3), np.uint8)
    for r in found.groupBy("kind", "block").applyInArrow(filled, "kind int, block int, data binary").toLocalIterator():
        out[r.kind][r.block * size : (r.block + 1) * size] = np.frombuffer(r.data, np.uint8)
    return out


def flagged(flags: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return flags[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0


#: A piece of text around an anchor: document (id, hash), place of the anchor, bytes before it and number of windows.
AROUND = np.dtype([("id", "<i8"), ("h", "<i8"), ("at", "<i8"), ("before", "u1"), ("n", "u1")])
COVER = np.dtype([("id", "<i8"), ("h", "<i8"), ("s", "<i8"), ("e", "<i8")])


def refine(ids: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Bucket identifiers of (bucket, code of a later offset); codes below 2^31."""
    return np.unique(ids.astype(np.int64) << 31 | code.astype(np.int64), return_inverse=True)[1]


def later_windows(rows: np.ndarray, text: np.ndarray) -> np.ndarray:
    """What the windows around equal anchors cover that occurred earlier; ``text``: the bytes of all rows, one after the other."""
    order = np.lexsort((rows["at"], rows["h"], rows["id"]))  # so that a smaller row number is an earlier window
    length = rows["n"].astype(np.int64) + LENGTH - 1
    starts = np.r_[0, np.cumsum(length)[:-1]]
    rows, length, starts = rows[order], length[order], starts[order]
    side = SPAN - 1
    # Lines of bytes, the anchors below each other; zeros where a row has none.
    line = np.zeros((len(rows), side + GRAM + side), np.uint8)
    row = np.repeat(np.arange(len(rows)), length)
    col = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    line[row, col + (side - rows["before"].astype(np.int64))[row]] = text[np.repeat(starts, length) + col]
    ids = np.zeros(len(rows), np.int64)
    for k in [*range(side, side + GRAM - 7, 8), side + GRAM - 8]:
        gram = np.unique(np.ascontiguousarray(line[:, k : k + 8]).view(np.uint64).ravel(), return_inverse=True)[1]
        ids = refine(ids, gram)
    again = np.bincount(ids, minlength=1)[ids] > 1
    rows, line, ids = rows[again], line[again], ids[again]
    if not len(rows):
        return np.zeros(0, COVER)
    right, left = [ids], [np.zeros(len(rows), np.int64)]
    for k in range(side):
        right.append(refine(right[-1], line[:, side + GRAM + k]))
        left.append(refine(left[-1], line[:, side - 1 - k]))
    before = rows["before"].astype(np.int64)
    low, high = np.full(len(rows), 1 << 30), np.full(len(rows), -1)
    for o in range(SPAN):
        has = np.flatnonzero((o <= before) & (o > before - rows["n"]))
        if len(has) < 2:
            continue
        _, first, which = np.unique(right[side - o][has] << 31 | left[o][has], return_index=True, return_inverse=True)
        f, has_f = has[first][which], has
        later = (rows["id"][f] != rows["id"][has_f]) | (rows["h"][f] != rows["h"][has_f]) | (rows["at"][f] != rows["at"][has_f])
        dup = has[later]
        low[dup] = np.minimum(low[dup], o)
        high[dup] = o
    hit = np.flatnonzero(high >= 0)
    out = np.zeros(len(hit), COVER)
    out["id"], out["h"] = rows["id"][hit], rows["h"][hit]
    out["s"], out["e"] = rows["at"][hit] - high[hit], rows["at"][hit] - low[hit] + LENGTH
    return out


def covered(texts: DataFrame, filter_, n: int, bits: int) -> DataFrame:
    """``id, h, s, e``: byte ranges that windows with an earlier copy cover."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, frequent = filter_.value
        held, size, later = [], 0, []

        def combined(rows, h, text):
            """Which rows go on: of equal texts the first; the others are covered."""
            length = rows["n"].astype(np.int64) + LENGTH - 1
            starts = np.r_[0, np.cumsum(length)[:-1]]
            order = np.lexsort((rows["at"], rows["h"], rows["id"], h))
            keep = np.ones(len(rows), bool)
            first = order[0]
            for i, same in zip(order[1:].tolist(), (h[order[1:]] == h[order[:-1]]).tolist(), strict=True):
                if not same:
                    first = i
                elif length[i] == length[first] and np.array_equal(text[starts[i] : starts[i] + length[i]], text[starts[first] : starts[first] + length[first]]) and rows[["id", "h", "at"]][i] != rows[["id", "h", "at"]][first]:
                    keep[i] = False
            gone = np.zeros((~keep).sum(), COVER)
            r = rows[~keep]
            gone["id"], gone["h"], gone["s"] = r["id"], r["h"], r["at"] - r["before"]
            gone["e"] = gone["s"] + r["n"] + LENGTH - 1
            later.append(gone)
            return rows[keep], text[np.repeat(keep, length)], keep

        def dealt():
            """The rows of a task with their buckets, windows of frequent anchors one by one."""
            rows, h, b, many, text = (np.concatenate(x) for x in zip(*held, strict=True))
            rows, text, keep = combined(rows, h, text)
            b, many, count = b[keep], many[keep], rows["n"].astype(np.int64)
            length = count + LENGTH - 1
            if not many.any():
                return rows, b, text, length
            starts = np.r_[0, np.cumsum(length)[:-1]]
            k = np.flatnonzero(many)
            each = np.repeat(k, count[k])
            step = np.arange(len(each)) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
            one = rows[each]
            one["before"], one["n"] = one["before"] - step, 1
            piece = text[(starts[each] + step)[:, None] + np.arange(LENGTH)]
            w = range_hash(prefix_hash(piece.ravel()), np.arange(len(each)) * LENGTH, np.arange(1, len(each) + 1) * LENGTH)
            one, piece, keep = combined(one, w, piece.ravel())
            few = np.repeat(~many, length)
            return np.r_[rows[~many], one], np.r_[b[~many], bucket_of(w[keep], n)], np.r_[text[few], piece], np.r_[length[~many], np.full(len(one), LENGTH)]

        def out():
            parts = []
            if held:
                rows, b, text, length = dealt()
                order = np.argsort(b, kind="stable")
                starts = np.r_[0, np.cumsum(length)[:-1]]
                cut = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
                for s, e in zip(cut, np.r_[cut[1:], len(b)], strict=True):
                    o = order[s:e]
                    at = np.repeat(starts[o] - np.r_[0, np.cumsum(length[o])[:-1]], length[o]) + np.arange(length[o].sum())
                    parts.append((int(b[o[0]]), rows[o].tobytes(), text[at].tobytes(), b""))
            if later and (c := np.concatenate(later)).size:
                parts.append((int(c["s"][0] % n), b"", b"", c.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), *(pa.array([p[k] for p in parts], pa.binary()) for k in (1, 2, 3))], ["bucket", "rows", "text", "later"])

        for batch in batches:
            ids, hs = batch["id"].to_numpy(), batch["h"].to_numpy()
            for part, offs, i, base in pieces(*flat(batch["t"])):
                first, count, anchor, h = runs(part, offs)
                b = bucket_of(h, n)
                bit = bit_of(b, h.astype(np.uint32), bits)
                hit = np.flatnonzero(flagged(flags, bit))
                if not len(hit):
                    continue
                first, count, anchor, b = first[hit], count[hit], anchor[hit], b[hit]
                many = flagged(frequent, bit[hit] >> np.uint64(COARSE))
                text = np.searchsorted(offs, first, "right") - 1
                r = np.zeros(len(hit), AROUND)
                r["id"], r["h"], r["at"], r["before"], r["n"] = ids[i + text], hs[i + text], anchor - offs[text] + base, anchor - first, count
                length = count + LENGTH - 1
                run = prefix_hash(part)
                at = np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                held.append((r, range_hash(run, first, first + length), b, many, part[at]))
                size += int(length.sum())
                if size > 4_000_000:
                    yield out()
                    held, size, later = [], 0, []
        if held:
            yield out()

    def windows(t: pa.Table) -> pa.Table:
        rows = unpack(t["rows"], AROUND)
        c = np.concatenate([unpack(t["later"], COVER), later_windows(rows, unpack(t["text"], np.uint8)) if len(rows) else np.zeros(0, COVER)])
        return pa.table({k: pa.array(np.ascontiguousarray(c[k])) for k in ("id", "h", "s", "e")})

    return texts.mapInArrow(packed, "bucket int, rows binary, text binary, later binary").groupBy("bucket").applyInArrow(windows, "id bigint, h bigint, s bigint, e bigint")


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of overlapping or touching ranges."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[new], e[np.r_[new[1:], len(e)] - 1] if len(s) else e


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 4 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with ``removed`` (byte ranges: maximal runs) and ``kept`` (the other bytes).

    A byte is removed if a string of 100 bytes over it also starts earlier: in a row with a smaller id (null first; then a
    smaller hash of the text), or earlier in the same text. Rows that repeat id and text are one document and get the same
    result. Null and empty texts, and those below 100 bytes, lose nothing. Columns with these two names are replaced, others
    may have any name. No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("removed", "kept")
    k_id, k_h, k_spans, k_cut = (unused(c, docs) for c in ("key_id", "key_hash", "spans", "cut"))
    rows = docs.withColumn(k_id, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))).withColumn(k_h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    texts = rows.select(F.col(k_id).alias("id"), F.col(k_h).alias("h"), F.col(text).alias("t"))
    total = text_bytes(texts, "t")
    n = parts_for(texts, "t", bucket_bytes, total)
    bits = min(MOST_BITS, max(20, math.ceil(math.log2(total * 4 / (SPAN / 2) + 1))))
    seen = spark.sparkContext.broadcast(repeated_anchors(texts, n, bits))
    spans = covered(texts, seen, n, bits).groupBy(F.col("id").alias(k_id), F.col("h").alias(k_h)).agg(F.collect_list(F.struct("s", "e")).alias(k_spans))

    @F.arrow_udf("struct<removed:array<struct<start:bigint,end:bigint>>,kept:binary>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        for t, spans in batches:
            data, offs = flat(t)
            out = []
            for i, sp in enumerate(spans):
                b = data[offs[i] : offs[i + 1]]
                if not sp.is_valid:
                    out.append({"removed": [], "kept": b.tobytes()})
                    continue
                s, e = merged(np.asarray(sp.values.field("s")), np.asarray(sp.values.field("e")))
                keep = np.zeros(len(b) + 1, np.int32)
                keep[s] += 1
                keep[e] -= 1
                out.append({"removed": [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)], "kept": b[np.cumsum(keep[:-1]) == 0].tobytes()})
            yield pa.array(out, kind)

    done = rows.join(spans, [k_id, k_h], "left").withColumn(k_cut, cut(F.col(text), F.col(k_spans)))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(k_cut)["removed"].alias("removed"), F.col(k_cut)["kept"].alias("kept"))


def op10(spark, docs: DataFrame) -> DataFrame:
    rows = without_repeats(docs.select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS nb FROM d),
w AS (SELECT doc_id, p, hash(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, nb - 99)) AS p FROM n WHERE nb >= 100)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM f)),
s AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM i GROUP BY doc_id, g),
k AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS a, s AS b FROM s UNION ALL SELECT doc_id, max(e), NULL FROM s GROUP BY 1),
t AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, nb) - a)), '' ORDER BY a) AS kept FROM k JOIN n USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM s GROUP BY 1)
SELECT doc_id, nb::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM n LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
