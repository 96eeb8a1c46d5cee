"""How filters of a corpus interact: what each removes, alone and after others, in every order.

A document's failures are five bits. Four depend on its text alone; the fifth, a copy of a text with a smaller id anywhere in
the table, is found by radix tries. Every task inserts its whole texts into a compressed trie whose terminals hold the
smallest id; what is larger there is a copy, and one text for each terminal goes on. Those are range-partitioned by adaptive
prefixes - a prefix grows until what begins with it fits a part or is one text - and inserted into a trie for each part. After
that only counts by part of the corpus and failure bits are left, 32 at most for each, and all orders are read off these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The filters, by bit.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of text that a trie holds before it is emptied, and that a part has about; groups of a prefix are split beyond a part's bytes.
HELD, PART = 64 << 20, 16 << 20
#: First length of a prefix in characters and what it grows by; tasks that the copies of one text are dealt to before they meet.
PREFIX, GROWTH, SALTS = 8, 4, 32
UPPER = bytes(range(65, 91))
SIGNS = b"#$%&*|"
ROWS = "text string, doc_id bigint, mask int, parts array<string>, counts array<bigint>"


class Trie:
    """A compressed trie of byte strings. An edge is a slice of a text that was inserted; a terminal holds what the caller keeps for its text."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = [{}, None]  # children by first byte: [text, start, end, node]; value

    def at(self, text: bytes) -> list:
        """The node of this text, made if need be."""
        node, i, n = self.root, 0, len(text)
        while i < n:
            edge = node[0].get(text[i])
            if edge is None:
                new = [{}, None]
                node[0][text[i]] = [text, i, n, new]
                return new
            other, s, e, below = edge
            k = e - s
            if text[i : i + k] != other[s:e]:
                lo, hi = 1, min(k, n - i)  # the first byte agrees; how many do
                if text[i : i + hi] == other[s : s + hi]:
                    lo = hi
                while lo < hi - 1:
                    mid = (lo + hi) // 2
                    if text[i + lo : i + mid] == other[s + lo : s + mid]:
                        lo = mid
                    else:
                        hi = mid
                k = lo
                middle = [{other[s + k]: [other, s + k, e, below]}, None]
                edge[2], edge[3] = s + k, middle
                below = middle
            node, i = below, i + k
        return node

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """All texts with what their terminals hold."""
        stack = [(b"", self.root)]
        while stack:
            path, (children, value) = stack.pop()
            if value is not None:
                yield path, value
            for text, _, end, node in children.values():
                stack.append((text[:end], node))


def failures(text: bytes, chars: int) -> int:
    """Bits A to D."""
    words = text.split()  # of bytes: splits at space and 9 to 13
    n = len(words)
    upper = len(text) - len(text.translate(None, UPPER))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * upper > 3 * chars) << 2 | (len(text) != len(text.translate(None, SIGNS))) << 3


def told(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = {"text": pa.string(), "doc_id": pa.int64(), "mask": pa.int32(), "parts": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[c]) for i, c in enumerate(columns)], columns)


COLUMNS = ["text", "doc_id", "mask", "parts", "counts"]


def emptied(trie: Trie, known: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a trie. A terminal holds its text's mask and {id: {part: rows}}. Larger ids are copies; the smallest goes on with its text, or (``known``) stays without being a copy."""
    rows, size = [], 0
    for text, (mask, ids) in trie.terminals():
        least = min(ids)
        for i, parts in ids.items():
            goes = i == least and not known
            rows.append((text.decode() if goes else None, i, mask | (0 if i == least else COPY), list(parts), list(parts.values())))
            size += len(text) * goes + 64
        if size > 8 << 20:
            yield told(rows, COLUMNS)
            rows, size = [], 0
    if rows:
        yield told(rows, COLUMNS)


def inserted(known: bool, held: int | None = HELD):
    """Rows of ROWS that have a text, into tries; a trie is emptied when its texts hold ``held`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size = Trie(), 0
        for b in batches:
            for text, i, mask, parts, counts in zip(b["text"].cast(pa.binary()).to_pylist(), *(b[c].to_pylist() for c in COLUMNS[1:]), strict=True):
                node = trie.at(text)
                if node[1] is None:
                    node[1], size = (mask, {}), size + len(text)
                of = node[1][1].setdefault(i, {})
                size += 256
                for p, n in zip(parts, counts, strict=True):
                    of[p] = of.get(p, 0) + n
                if held and size > held:
                    yield from emptied(trie, known)
                    trie, size = Trie(), 0
        yield from emptied(trie, known)

    return run


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, part, text) as ROWS: failure bits, and a trie for what a task holds at a time."""

    def rows() -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, raw = pc.utf8_length(b["text"]).to_pylist(), b["text"].cast(pa.binary()).to_pylist()
            masks = [failures(t, n) for t, n in zip(raw, chars, strict=True)]
            one = [(None, i, m, [p], [1]) for i, m, p in zip(b["doc_id"].to_pylist(), masks, b["part"].to_pylist(), strict=True)]
            whole = told(one, COLUMNS).set_column(0, "text", b["text"])
            none = whole.column("doc_id").is_null()
            if pc.any(none).as_py():  # smaller than none, larger than none
                lost.append(whole.filter(none).set_column(0, "text", pa.nulls(pc.sum(none).as_py(), pa.string())))
                whole = whole.filter(pc.invert(none))
            yield whole

    lost: list[pa.RecordBatch] = []
    for out in inserted(False)(rows()):
        yield from lost
        lost.clear()
        yield out
    yield from lost


def leaf(texts: DataFrame, part_bytes: int) -> tuple[Column, Column]:
    """The adaptive prefix of each text, and whether what begins with it is over a part of one text alone.

    Prefixes with over ``part_bytes`` grow; as hashes they are broadcast: fewer than the parts, for each length.
    """
    out, hot, n, candidates = F.substring("text", 1, PREFIX), F.lit(False), PREFIX, texts
    while True:
        at = F.xxhash64(F.substring("text", 1, n))
        h = F.xxhash64("text")
        heavy = candidates.groupBy(at.alias("h")).agg(F.sum(F.octet_length("text") + 64).alias("b"), (F.min(h) == F.max(h)).alias("one")).filter(F.col("b") > part_bytes).collect()
        grow, alone = [r.h for r in heavy if not r.one], [r.h for r in heavy if r.one]
        if alone:
            hot = hot | at.isin(alone)
        if not grow:
            return out, hot
        candidates = candidates.filter(at.isin(grow))
        out = F.when(at.isin(grow), F.substring("text", 1, n * GROWTH)).otherwise(out)
        n *= GROWTH


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", part_bytes: int = PART) -> DataFrame:
    """doc_id, part, mask, n: how many rows of an id and part fail the filters of ``mask`` (A is bit 0, E bit 4).

    A null text is empty, a null part the empty string. Rows that repeat an id are no copies of each other; a row without an id
    is no copy and makes none. Other columns are not read. No rows: no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = stored(rows.mapInArrow(read, ROWS), "tries")
    texts = first.filter("text is not null")
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    prefix, hot = leaf(texts, max(part_bytes // 2, total >> 16))
    texts = texts.withColumns({"prefix": prefix, "hot": hot})
    # Copies of one text that fill a part are dealt out once more before they meet.
    dealt = texts.filter("hot").drop("prefix", "hot").repartition(SALTS, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    dealt = stored(dealt.mapInArrow(inserted(False), ROWS), "dealt")
    cold = texts.filter("not hot").select(*COLUMNS, "prefix").unionByName(dealt.filter("text is not null").withColumn("prefix", F.substring("text", 1, PREFIX)))
    judged = cold.repartitionByRange(parts, "prefix").select(*COLUMNS).mapInArrow(inserted(True, None), ROWS)
    settled = first.filter("text is null").unionByName(dealt.filter("text is null")).unionByName(judged)
    each = settled.select("doc_id", "mask", F.explode(F.arrays_zip("parts", "counts")).alias("x"))
    return each.groupBy("doc_id", F.col("x.parts").alias("part"), "mask").agg(F.sum("x.counts").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all 120 orders of the five filters, for each value of ``part``.

    A document is labelled good (quality 1) or toxic (toxic 1) if any of its labels says so; without labels it is neither. For
    the rest see ``masks``.
    """
    marks = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    found = masks(docs, doc_id, text, part).join(marks, "doc_id", "left")
    counts = found.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("good")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.col("n") * F.col("toxic")), F.lit(0)).alias("toxic"))
    # From here on there are 32 rows at most for each part.
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    each = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")
    before = F.expr(f"aggregate(transform(sequence(1, {len(FILTERS)}), i -> if(i < step, shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1), 0)), 0, (a, b) -> a + b)")
    each = each.withColumns({"own": own, "before": before})
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    gone = fails & ~earlier
    long = lambda condition, value="n": F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")
    share = F.sum(F.when(fails, F.col("n") * (F.lit(120) / F.bit_count("mask")).cast("long")).otherwise(0)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        long(~fails & ~earlier).alias("kept"), long(gone).alias("removed"), long(fails & earlier).alias("redundant"), long(F.col("mask") == F.col("own")).alias("unique_fails"), long(gone, "good").alias("good_lost"), long(gone, "toxic").alias("toxic_lost"), share.alias("shapley")
    )


def op13(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > first_id, false)} AS x
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (
  SELECT part, list_sort(list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN x['A'] WHEN 'B' THEN x['B'] WHEN 'C' THEN x['C'] WHEN 'D' THEN x['D'] ELSE x['E'] END)) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || c FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, step, substring(filter_order, step, 1) AS own, string_split(substring(filter_order, 1, step - 1), '') AS earlier FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
j AS (SELECT m.*, s.*, list_contains(fails, own) AS fails_own, list_has_any(fails, earlier) AS gone FROM m, s)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (NOT fails_own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails_own AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails_own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_own AND len(fails) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails_own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails_own AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(len(fails), 1)) FILTER (fails_own), 0)::BIGINT AS shapley
FROM j GROUP BY ALL
"""
