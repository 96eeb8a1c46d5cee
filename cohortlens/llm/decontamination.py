"""Benchmark decontamination: an Aho-Corasick automaton over the test items, one scan of each text.

The automaton holds anchors: 5-grams at every sixth word of an item, one at least in each window of 10 words, and short
items whole. Where an anchor occurs, the words around it in the text are held against those around it in the items: a run
of 10 is a window. Places are mapped back to the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flat, small_batches, stored, unused, word_ranges

#: An automaton holds about so many bytes of item text (some 60 bytes of memory each); a larger benchmark is scanned for block by block.
BLOCK_BYTES = 4 << 20
RUNS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
HITS = f"struct<n_words:bigint,items:array<string>,runs:{RUNS}>"
_RUN = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])
_HITS = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(_RUN))])

#: Bytes between words: ASCII but for digits and letters.
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[48:58] = GAP[65:91] = GAP[97:123] = False
NORMAL = bytes(32 if GAP[i] else int(LOWER[i]) for i in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: bytes) -> list[bytes]:
    """`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return text.translate(NORMAL).split()


#: An anchor with more places than a hit has windows is told by its windows instead.
FEW = 6


class Anchors:
    """The automaton of anchors, between blanks, and the windows of anchors that many places share.

    An anchor's value is its number of words, its places (words before, nearest first, and after it, words needed, items) and
    whether it has windows, so that a hit costs as much as a window has words, however many items share the anchor.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        found: dict[bytes, dict[tuple, set]] = {}
        gram = (width + 1) // 2
        step, self.side = width - gram + 1, width - gram
        for name, text in items:
            w = words(text)
            if 0 < len(w) < width:
                found.setdefault(b" ".join(w), {}).setdefault(((), (), len(w)), set()).add(name)
            for p in range(0, len(w) - gram + 1, step) if len(w) >= width else ():
                around = (tuple(w[max(0, p - self.side) : p][::-1]), tuple(w[p + gram : p + gram + self.side]), width)
                found.setdefault(b" ".join(w[p : p + gram]), {}).setdefault(around, set()).add(name)
        self.windows: dict[bytes, set] = {}
        self.automaton = ahocorasick.Automaton()
        for k, places in found.items():
            n, hot = k.count(b" ") + 1, len(places) > FEW
            kept = [(*place, names) for place, names in places.items() if not hot or place[2] == n]
            for (before, after, need), names in places.items() if hot else ():
                for b in range(need - n + 1) if need > n else ():
                    if b <= len(before) and need - n - b <= len(after):
                        self.windows.setdefault(b" ".join((*before[:b][::-1], k, *after[: need - n - b])), set()).update(names)
            self.automaton.add_word(f" {k.decode('latin-1')} ", (n, kept, hot))
        if found:
            self.automaton.make_automaton()
        self.empty = not found


def automaton(items: list[tuple[str | None, bytes]], width: int) -> Anchors | None:
    """None if there is no anchor."""
    a = Anchors(items, width)
    return None if a.empty else a


def agree(x, y) -> int:
    """How many leading words are the same."""
    n = 0
    for p, q in zip(x, y, strict=False):
        if p != q:
            break
        n += 1
    return n


def scan(text: bytes, a: Anchors | None) -> tuple[int, np.ndarray | None, set]:
    """Words, flags of the words hit (None: none) and the items with a window in the text."""
    w = words(text)
    line = f" {b' '.join(w).decode('latin-1')} "
    hit, ends, whose = None, None, {}
    for at, (k, places, hot) in a.automaton.iter(line) if a and w else ():
        if ends is None:
            ends = np.cumsum([len(x) + 1 for x in w])
        last = int(np.searchsorted(ends, at))
        first = last - k + 1
        seen = []
        for before, after, need, names in places:
            x, y = agree(before, w[max(0, first - len(before)) : first][::-1]), agree(after, w[last + 1 : last + 1 + len(after)])
            if x + k + y >= need:
                seen.append((first - x, last + 1 + y, names))
        for start in range(max(0, first - a.side), min(first, len(w) - k - a.side) + 1) if hot else ():
            names = a.windows.get(b" ".join(w[start : start + k + a.side]))
            if names:
                seen.append((start, start + k + a.side, names))
        for start, end, names in seen:
            hit = np.zeros(len(w), bool) if hit is None else hit
            hit[start:end] = True
            whose[id(names)] = names
    return len(w), hit, set().union(*whose.values())


def runs(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words: first and last word (exclusive), start and end in code points of the original text."""
    start, end, _ = word_ranges(np.frombuffer(text, np.uint8), np.array([0, len(text)]), GAP)
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    # Code points before each byte: bytes that don't continue one.
    chars = np.r_[0, np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)]
    return [{"first": int(a), "last": int(b), "start": int(chars[start[a]]), "end": int(chars[end[b - 1]])} for a, b in edge.reshape(-1, 2)]


def scanned(text: Column, items: list[tuple[str | None, bytes]], width: int, spark) -> Column:
    """HITS of each text, for these items: sent once to an executor, one automaton for each task."""
    sent = spark.sparkContext.broadcast(items)

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(sent.value, width)
        for batch in batches:
            data, offs = flat(batch)
            out = []
            for i in range(len(batch)):
                t = data[offs[i] : offs[i + 1]].tobytes()
                n, hit, names = scan(t, a)
                out.append({"n_words": n, "items": sorted(x for x in names if x is not None), "runs": [] if hit is None else runs(t, hit)})
            yield pa.array(out, _HITS)

    return hits(text)


def shown(h: Column) -> Column:
    """n_words, n_hit, items and spans, from HITS."""
    n = F.aggregate(h["runs"], F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"])
    return F.struct(h["n_words"].alias("n_words"), n.alias("n_hit"), h["items"].alias("items"), F.transform(h["runs"], lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """``i, t, block`` of the items with a text, and the number of blocks of about ``BLOCK_BYTES``."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))), n


def held(rows: DataFrame) -> list[tuple[str | None, bytes]]:
    """The items of one block, on the driver."""
    return [(r.i, r.t.encode()) for r in rows.select("i", "t").toLocalIterator()]


def contamination(text: Column, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", width: int = 10) -> Column:
    """``with_contamination`` as a column, for a benchmark of one block."""
    rows, n = blocks_of(benchmark, item_id, item_text)
    if n > 1:
        raise ValueError("a benchmark of several blocks: use with_contamination")
    return shown(scanned(text, held(rows), width, benchmark.sparkSession))


def with_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: n_words, n_hit, items (ids, sorted as strings) and spans (code points of the original).

    A null or empty text has no words and no hits; long texts are read whole, repeated texts are hit alike. Items without
    words never hit; items that repeat an id count once, a null id is left out of ``items``. An empty benchmark hits
    nothing. A benchmark of several blocks is looked for block by block; only hits are kept between them, by text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, n = blocks_of(benchmark, item_id, item_text)
    name = unused("hits", docs)
    if n == 1:
        return docs.withColumn(name, shown(scanned(F.col(text), held(rows), width, spark))), name
    keys = [F.xxhash64(F.lit(k), F.col(text)) for k in (1, 2)]
    every = None
    for k in range(n):
        some = docs.select(*[c.alias(x) for c, x in zip(keys, ("k1", "k2"), strict=True)], scanned(F.col(text), held(rows.filter(F.col("block") == k)), width, spark).alias("h")).filter(F.size("h.runs") > 0)
        some = stored(some.groupBy("k1", "k2").agg(F.first("h.items").alias("items"), F.first("h.runs").alias("runs")), "hits")
        every = some if every is None else every.unionByName(some)
    every = every.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))

    def join_runs(acc, r):
        last = F.element_at(acc, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        apart = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["last"] < r["first"])
        return F.when(apart, F.concat(acc, F.array(r))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer)))

    k1, k2 = unused("k1", docs), unused("k2", docs)
    every = every.select(F.col("k1").alias(k1), F.col("k2").alias(k2), "items", F.aggregate("runs", F.array().cast(RUNS), join_runs).alias("runs")).select(k1, k2, F.struct("items", "runs").alias(name))
    out = docs.withColumns({k1: keys[0], k2: keys[1]}).join(every, [k1, k2], "left")
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    whole = F.struct(n_words.alias("n_words"), F.coalesce(F.col(f"{name}.items"), F.array().cast("array<string>")).alias("items"), F.coalesce(F.col(f"{name}.runs"), F.array().cast(RUNS)).alias("runs"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], shown(whole).alias(name)), name


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no word is hit, with all their columns, whatever their names. Null and empty texts stay; no rows: no rows."""
    found, name = with_contamination(docs, benchmark, text, **options)
    return found.filter(F.col(name)["n_hit"] == 0).drop(name)


def op8(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found, name = with_contamination(docs.select("doc_id", "text"), benchmark)
    found = found.select("doc_id", F.col(name).alias("h"))
    return found.select(
        "doc_id", "h.n_words", "h.n_hit", F.size("h.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "h.items"), 256).alias("items_sha256"), (F.col("h.n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH lo AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wi AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lo, (SELECT DISTINCT n FROM wi) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN wi USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lo LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
