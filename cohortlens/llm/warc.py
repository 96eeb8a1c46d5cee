"""A content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, records by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, stored

# The alphabet of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A digest with over 1 / HOT of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 500


def base32_sha1(sha1_hex: Column) -> Column:
    """32 letters from 40 hex digits: 5 digits are 20 bits are 4 letters."""
    letters = []
    for i in range(8):
        v = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*letters)


def record_header(row: dict[str, Column]) -> Column:
    """The bytes of a record before its payload."""
    response = row["type"] == "response"
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), row["type"]), F.concat(F.lit("WARC-Record-ID: <urn:page:"), row["page_id"], F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), row["url"]),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), row["sha1"]), F.concat(F.lit("X-Payload-Length: "), row["bytes"]),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: <urn:page:"), row["refers_to"], F.lit(">"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(response, row["bytes"]).otherwise("0")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Write ``path/headers`` (uid, digest, header) and ``path/payloads`` (digest, payload), both Parquet.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id (null: smallest; ties:
    the last row read) is a response, the others are revisits of it; smaller ones are all responses. A null payload is
    empty; a null id is written as ``null``, carriage returns and line feeds in a URL as spaces. Payloads whose digests agree
    are verified to agree in length and two more hashes, else the job fails. No pages: an archive without records.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    thin = stored(
        pages.select(F.monotonically_increasing_id().alias("uid"), F.col(page_id).alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\r\n]+", " ").alias("url"), payload.alias("p"))
        .select("uid", "page_id", "url", F.sha2("p", 256).alias("digest"), base32_sha1(F.sha1("p")).alias("sha1"), F.octet_length("p").cast("long").alias("bytes")),
        "pages",
    )
    n = thin.count()
    best = stored(thin.groupBy("digest").agg(F.max(F.struct("page_id", "uid")).alias("best"), F.count(F.lit(1)).alias("n")).select(F.col("digest").alias("d"), F.col("best.page_id").alias("best_id"), F.col("best.uid").alias("best_uid"), "n").filter("n > 1"), "best")
    hot = best.filter(F.col("n") * HOT > n).select("d", F.col("best_id").alias("hot_id"), F.col("best_uid").alias("hot_uid"))
    marked = thin.join(F.broadcast(hot), F.col("digest") == F.col("d"), "left").drop("d")
    cold = marked.filter("hot_uid is null").drop("hot_id", "hot_uid").join(best, F.col("digest") == F.col("d"), "left").drop("d", "n")
    rows = cold.unionByName(marked.filter("hot_uid is not null").withColumnsRenamed({"hot_id": "best_id", "hot_uid": "best_uid"}))
    first = F.col("best_uid").isNull() | (F.col("best_uid") == F.col("uid")) | (F.col("bytes") < min_bytes)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    header = record_header({"type": F.when(first, "response").otherwise("revisit"), "page_id": name("page_id"), "url": F.col("url"), "sha1": F.col("sha1"), "bytes": F.col("bytes").cast("string"), "refers_to": name("best_id")})
    rows.select("uid", "digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    once = pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload", F.octet_length("payload").alias("b"), F.xxhash64("payload").alias("x"), F.crc32("payload").alias("c"))
    same = F.assert_true((F.min("b") == F.max("b")) & (F.min("x") == F.max("x")) & (F.min("c") == F.max("c")), "different payloads have one SHA-256 digest")
    once = once.groupBy("digest").agg(F.first("payload").alias("payload"), same.alias("same")).filter(F.col("same").isNull())
    once.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark, path: str) -> DataFrame:
    """Every record again: page_id, record_type, refers_to, payload_digest, payload_bytes, header, payload (whole, for revisits too), record (its WARC bytes).

    Fails where a payload is missing or its SHA-256 isn't its key.
    """
    heads = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").filter(F.assert_true(F.sha2("payload", 256) == F.col("digest"), "a payload was changed").isNull())
    counts = heads.groupBy("digest").count()
    # A hot payload's records go to several tasks: its payload is copied once for each 2,000 records.
    spread = stored(counts.filter("count > 2000").select("digest", F.ceil(F.col("count") / 2000).cast("int").alias("parts")), "spread")
    spread = F.broadcast(spread) if spread.count() <= 10_000 else spread
    heads = heads.join(spread, "digest", "left").withColumn("part", F.pmod(F.xxhash64("uid"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    payloads = payloads.join(spread, "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    text = F.decode("header", "UTF-8")
    # (?d): a line ends at a line feed only, and those in URLs are gone; other line separators stay part of the URL.
    field = lambda k: F.nullif(F.regexp_extract(text, rf"(?dm)^{k}\r$", 1), F.lit(""))
    kind = field("WARC-Type: ([a-z]+)")
    return heads.join(payloads, ["digest", "part"], "left").select(
        "uid", field("WARC-Record-ID: <urn:page:([0-9-]+)>").cast("long").alias("page_id"), kind.alias("record_type"), field("WARC-Refers-To: <urn:page:([0-9-]+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest: sha1:([A-Z2-7]+)").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "header", "payload",
        F.concat("header", F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"),
    ).filter(F.assert_true(F.col("payload").isNotNull(), "a payload is missing").isNull())


def op4(spark, pages: DataFrame) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    back = read_archive(spark, path)
    digest = base32_sha1(F.sha1("payload"))
    checked = F.assert_true(digest == F.col("payload_digest"), "a payload doesn't have the digest in its header")
    return back.filter(checked.isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, row_number() OVER w AS k, first_value(page_id) OVER w AS f FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST)),
d AS (SELECT *, sha1(h) AS x FROM r)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM d
"""
