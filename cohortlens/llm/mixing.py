"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Words are summed by source and bucket of a row hash; a running sum finds the bucket in which a source's budget ends, and
only that bucket is split again (12 bits of the hash at a time). What is left is a hash threshold for each source, so the
rows are chosen by a filter, without a sort, and the same rows on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, unused

#: 4 levels of 12 bits: the 48 bits of the row hash.
STEP, LEVELS = 12, 4
#: Thresholds are broadcast up to so many sources (about 60 bytes each); beyond it Spark chooses the join.
FEW_SOURCES = 50_000


def row_hash(doc_id: str, text: str, seed: str) -> Column:
    """48 bits of md5 over seed, id and text."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, 12), 16, 10).cast("long")


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """``source, source_size`` -> with ``target``: weights 1, 2, 3, 1, ... by code point (null last), each at most ``most`` sizes.

    If the sources with the lowest cap per weight are at their caps, the others share the rest by weight; the level at
    which they share is the highest that any such prefix gives.
    """
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("per", F.col("source").asc_nulls_last())
    t = sizes.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    t = t.withColumn("per", F.col("cap") / F.col("w"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / weight).withColumn("level", F.max("level").over(all_rows))
    return t.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def thresholds(thin: DataFrame, most: int = 3) -> DataFrame:
    """``source, size, h`` -> per source: source_size, target, ``base`` whole passes, ``cut``: rows with h < cut are taken once more."""
    t = targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    t = t.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = t.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("source_size"))
    names = ["source_size", "target", "base", "rest", "prefix", "below"]
    few = t.count() <= FEW_SOURCES
    for k in range(LEVELS):
        right = state.withColumnRenamed("source", "s").select("s", *names)
        high = F.shiftright("h", 48 - STEP * k) if k else F.lit(0).cast("long")
        rows = thin.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("s")) & (high == F.col("prefix")))
        hist = rows.groupBy("source", *names, F.shiftright("h", 48 - STEP * (k + 1)).alias("b")).agg(F.sum("size").alias("inside"))
        run = W.partitionBy("source").orderBy("b")
        hist = hist.withColumn("upto", F.col("below") + F.sum("inside").over(run))
        # The first bucket that goes over the budget; the last one if none does.
        rank = F.row_number().over(W.partitionBy("source").orderBy((F.col("upto") <= F.col("rest")), F.when(F.col("upto") > F.col("rest"), F.col("b")).otherwise(-F.col("b"))))
        state = hist.withColumn("rank", rank).filter("rank = 1").select("source", "source_size", "target", "base", "rest", F.col("b").alias("prefix"), (F.col("upto") - F.col("inside")).alias("below"), "inside")
    upto = F.col("below") + F.col("inside")
    take = (upto <= F.col("rest")) | (upto - F.col("rest") < F.col("rest") - F.col("below"))
    return state.select("source", "source_size", "target", "base", F.when(F.col("rest") > 0, F.col("prefix") + F.when(take, 1).otherwise(0)).otherwise(0).alias("cut"))


def with_copies(docs: DataFrame, doc_id: str, text: str, source: str, most: int, seed: str) -> tuple[DataFrame, list[str]]:
    """``docs`` and, under names that it doesn't have (they are returned too), size, source size, target and copies of each row."""
    thin = stored(docs.select(F.col(source).alias("source"), words(text).alias("size"), row_hash(doc_id, text, seed).alias("h")), "mix")
    cuts = stored(thresholds(thin, most), "cuts")
    few = cuts.count() <= FEW_SOURCES
    new = [unused(c, docs) for c in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]
    h, own = unused("mix_hash", docs), {c: unused(f"cut_{c}", docs) for c in cuts.columns}
    cuts = cuts.withColumnsRenamed(own)
    out = docs.withColumn(h, row_hash(doc_id, text, seed)).join(F.broadcast(cuts) if few else cuts, F.col(source).eqNullSafe(F.col(own["source"])), "left")
    copies = F.col(own["base"]) + F.when(F.col(h) < F.col(own["cut"]), 1).otherwise(0)
    every = [words(text), F.col(own["source_size"]), F.col(own["target"]), copies]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(name) for c, name in zip(every, new, strict=True)]), new


def mix_to_targets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, seed: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row).

    A source's words taken come within one row of its target (ties of the whole hash are taken or left together,
    whichever is nearer). Null is a source of its own, the last. Null and empty texts have size 0; a source without words
    takes no rows. Columns of the input with these four names are replaced; others may have any name. No rows: no rows.
    """
    out, _ = with_copies(docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies"), doc_id, text, source, most, seed)
    return out


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs`` and their values, whatever their names.

    Nulls, empty texts and repeated rows as in ``mix_to_targets``; rows of size 0 are taken or left by their hash like
    others. No rows: no rows.
    """
    rows, new = with_copies(docs, doc_id, text, source, most, seed)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.filter(F.col(new[3]) > 0).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(new[3]))).alias(new[0])).select(*names)


def op2(spark, docs: DataFrame) -> DataFrame:
    rows = mix_to_targets(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(lev) OVER () * w) AS target FROM l),
g AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
c AS (SELECT d.*, g.source_size, g.target, g.base, g.target - g.base * g.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS inside
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN upto <= rest OR (upto - inside <= rest AND upto - rest < rest - (upto - inside)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
