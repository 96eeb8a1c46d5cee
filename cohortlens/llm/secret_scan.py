"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near its hits, then checksums.

Hexadecimal runs have no keyword that could be filtered for, so one expression finds them in the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flat, small_batches

# Keywords, patterns and least lengths of the base kinds.
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ["assign", "access", "hex", "checked"]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_LOWER = bytes(LOWER.tolist())


def prefilter():
    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k, (len(k), "access" if k == "akia" else "checked" if k.endswith("_") else "assign"))
    a.make_automaton()
    return a


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(width, "0")


def valid_checksum(body: bytes, check: bytes) -> bool:
    """Whether the token's last six characters are the CRC-32 of those before them, in base 62."""
    return base62(zlib.crc32(body)) == check.decode()


def find(text: bytes, keywords) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), byte offsets, sorted; non-overlapping within a kind."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    done = {"assign": 0, "access": 0, "checked": 0}
    # Keywords of a kind may overlap only as one holds the other; hits are sorted so that the leftmost match wins.
    for start, kind in sorted({(at - k + 1, kind) for at, (k, kind) in keywords.iter(text.translate(_LOWER).decode("latin-1"))}):
        if start < done[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, start)
        if not m:
            continue
        done[kind] = m.end()
        if kind == "assign":
            good = len(m[2]) >= LEAST[kind]
        elif kind == "access":
            good = len(m[0]) >= LEAST[kind]
        else:
            good = valid_checksum(m[1], m[2])
        if good:
            out.append((start, KINDS.index(kind), m.end()))
    return sorted(out)


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    if not text.isascii():
        # Code points before each byte: bytes that don't continue one.
        before = np.r_[0, np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)]
        spans = [(int(before[s]), k, int(before[e])) for s, k, e in spans]
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]


def secrets(text: Column) -> Column:
    """All secrets of each text: kind, start, end (code points, end exclusive), sorted by start, then kind.

    Kinds: assign, access and hex (the base), and ``checked``: tokens with an embedded checksum that is right. A null or
    empty text has none; long texts are read whole, repeated ones give the same. No rows: no rows.
    """

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keywords = prefilter()
        for batch in batches:
            data, offs = flat(batch)
            texts = (data[offs[i] : offs[i + 1]].tobytes() for i in range(len(batch)))
            yield pa.array([in_code_points(t, f) if (f := find(t, keywords)) else [] for t in texts], _SPANS)

    return found(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9(spark, docs: DataFrame) -> DataFrame:
    small_batches(spark)
    rows = docs.select("doc_id", secrets(F.col("text")).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["kind"] != "checked")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
