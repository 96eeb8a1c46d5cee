"""Queries of joins, inventories, splits and sequences (C, D15-D19, E, G1-G3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relate as R
from ..operators import split as P
from ..operators import auction, graph, similarity
from ..registry import query
from ..sources.tables import table
from .profile import rounded


def docs(spark, d):
    """documents as a file inventory: content hash, data set (source), class (lang)."""
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("md5"))


@query("c1_attribute_join", "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def c1(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query("c2_composite_join", "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey = b.l_partkey AS same_part FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_returnflag = 'A' AND b.l_returnflag = 'N'")
def c2(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a, b = li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'N'").withColumnRenamed("l_partkey", "p")
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", (F.col("l_partkey") == F.col("p")).alias("same_part"))


@query("c3_anti_join", "SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def c3(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("c4_semi_join_union", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def c4(spark, d):
    keys = table(spark, d, "nation").filter("n_regionkey = 1").select("n_nationkey").union(table(spark, d, "supplier").filter("s_acctbal < 0").select("s_nationkey"))
    return table(spark, d, "customer").join(keys, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("c5_set_overlap", "WITH x AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS k FROM orders) SELECT p.s AS a, q.s AS b, count(*) AS shared FROM x p JOIN x q ON p.k = q.k AND p.s < q.s GROUP BY 1, 2")
def c5(spark, d):
    return R.set_overlap(table(spark, d, "orders"), "o_orderstatus", "o_custkey")


SPLIT = """SELECT *, CASE WHEN r <= nv THEN 'val' WHEN r <= nv + nt THEN 'test' ELSE 'train' END AS split FROM (
 SELECT *, CASE WHEN n > 2 THEN greatest(floor(n * 0.15 + 0.5), 1) ELSE 0 END AS nv, CASE WHEN n > 2 THEN greatest(floor(n * 0.15 + 0.5), 1) WHEN n = 2 THEN 1 ELSE 0 END AS nt FROM (
 SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer))"""


def customer_split(spark, d):
    return P.stratified_split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 42)


@query("e9_unit_split", f"SELECT c_custkey, c_mktsegment, split FROM ({SPLIT})")
def e9(spark, d):
    return customer_split(spark, d)


@query("c6_split_leaks", f"WITH s AS (SELECT DISTINCT split, o_orderpriority AS k FROM orders JOIN ({SPLIT}) ON o_custkey = c_custkey) SELECT p.split AS a, q.split AS b, count(*) AS shared FROM s p JOIN s q ON p.k = q.k AND p.split < q.split GROUP BY 1, 2")
def c6(spark, d):
    s = customer_split(spark, d).select(F.col("c_custkey").alias("o_custkey"), "split")
    return R.split_leaks(table(spark, d, "orders").join(s, "o_custkey"), "split", "o_orderpriority")


@query("c7_unambiguous", "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def c7(spark, d):
    return R.unambiguous(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("c8_lookup_default", "SELECT doc_id, coalesce(quality, -1)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def c8(spark, d):
    x = table(spark, d, "documents").select("doc_id")
    return R.lookup(x, "doc_id", table(spark, d, "labels"), "doc_id", "quality", -1, "quality")


@query("c9_union_by_name", "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, NULL AS size FROM customer UNION ALL SELECT p_partkey, NULL, NULL, p_size FROM part")
def c9(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("c10_set_operations", "SELECT 'both' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'left only', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def c10(spark, d):
    c, s, o = (table(spark, d, t) for t in ("customer", "supplier", "orders"))
    cn, sn = c.select(F.col("c_nationkey").cast("long").alias("k")), s.select(F.col("s_nationkey").cast("long").alias("k"))
    only = c.select(F.col("c_custkey").alias("k")).subtract(o.select("o_custkey"))
    tag = lambda name, x: x.select(F.lit(name).alias("op"), "k")
    return tag("both", cn.intersect(sn)).unionAll(tag("left only", only)).unionAll(tag("any", cn.union(sn).distinct()))


EMB = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings"


@query("c11_similar_pairs", f"WITH e AS ({EMB}) SELECT p.vec_id AS a, q.vec_id AS b, round(list_inner_product(p.v, q.v), 6) AS sim FROM e p JOIN e q ON p.vec_id < q.vec_id WHERE list_inner_product(p.v, q.v) >= 0.4")
def c11(spark, d):
    return rounded(similarity.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4), "sim")


@query("c12_nearest", f"WITH e AS ({EMB}), s AS (SELECT p.vec_id AS id, q.vec_id AS other, list_inner_product(p.v, q.v) AS sim FROM e p JOIN e q ON p.vec_id % 20 = 0 AND q.vec_id <> p.vec_id) SELECT id, other, round(sim, 6) AS sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s) WHERE rank <= 3")
def c12(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(similarity.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 3), "sim")


GM = f"WITH e AS ({EMB}), s AS (SELECT p.vec_id AS id, q.vec_id % 7 AS grp, q.vec_id AS nearest, list_inner_product(p.v, q.v) AS sim FROM e p JOIN e q ON p.label = q.label AND p.vec_id <> q.vec_id), g AS (SELECT id, grp, max(sim) AS sim, arg_max(nearest, sim) AS nearest FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS r, lead(sim) OVER w AS second FROM g WINDOW w AS (PARTITION BY id ORDER BY sim DESC, grp)) SELECT id, grp, round(sim, 6) AS sim, round(sim - coalesce(second, 0), 6) AS margin, nearest FROM r WHERE r = 1"


def matched(spark, d):
    e = table(spark, d, "embeddings").withColumn("g", F.col("vec_id") % 7)
    return similarity.group_match(e, e, "vec_id", "embedding", "label", "g")


@query("c13_group_match", GM)
def c13(spark, d):
    return rounded(matched(spark, d), "sim", "margin")


@query("c21_match_accuracy", f"SELECT label, count(*) AS n, round(avg(CASE WHEN m.grp = m.id % 7 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({GM}) m JOIN embeddings ON vec_id = id GROUP BY 1")
def c21(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 7).alias("truth"))
    return rounded(R.match_accuracy(matched(spark, d).join(e, "id"), "grp", "truth", "label"), "accuracy")


@query("d34_precision_coverage", f"WITH m AS (SELECT m.margin AS raw, m.* FROM ({GM.replace('round(sim - coalesce(second, 0), 6)', 'sim - coalesce(second, 0)')}) m), t AS (SELECT i * 0.01 AS margin FROM range(0, 21) r(i)), c AS (SELECT t.margin, count(raw) AS kept, sum(CASE WHEN m.grp = m.id % 7 THEN 1 ELSE 0 END)::BIGINT AS tp FROM t LEFT JOIN m ON m.raw >= t.margin GROUP BY 1), p AS (SELECT margin, kept, CASE WHEN kept > 0 THEN tp * 1.0 / kept END AS precision FROM c) SELECT round(margin, 6)::DOUBLE AS margin, kept, round(precision, 6) AS precision, margin = coalesce((SELECT min(margin) FROM p WHERE precision >= 0.2), (SELECT max(margin) FROM p)) AS chosen FROM p")
def d34(spark, d):
    from ..operators.metrics import precision_coverage

    m = matched(spark, d).withColumn("right", (F.col("grp") == F.col("id") % 7).cast("int"))
    x = precision_coverage(m, "right", "margin", [round(i * 0.01, 2) for i in range(21)], 0.2)
    return rounded(x, "margin", "precision")


@query("c14_mutual_best", f"WITH e AS ({EMB}), s AS (SELECT p.vec_id AS a, q.vec_id AS b, list_inner_product(p.v, q.v) AS score FROM e p JOIN e q ON p.label = q.label AND p.vec_id % 2 = 0 AND q.vec_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rb FROM s) SELECT a, b, round(score, 6) AS score FROM r WHERE ra = 1 AND rb = 1")
def c14(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(similarity.mutual_nearest(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "embedding", "label"), "score")


@query("c14_assignment")
def c14_assign(spark, d):
    e = table(spark, d, "embeddings")
    got = auction.assigned(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "embedding", "label")
    return got.select(F.col("klass").cast("string").alias("block"), "a", "b", "score")


@query("c15_successors", "SELECT a.l_orderkey, a.l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def c15(spark, d):
    return similarity.successors(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query("c19_components", f"WITH RECURSIVE v AS ({EMB}), e AS (SELECT p.vec_id AS u, q.vec_id AS w FROM v p JOIN v q ON p.vec_id <> q.vec_id WHERE list_inner_product(p.v, q.v) >= 0.4), r(node, seen) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.node, e.w FROM r JOIN e ON r.seen = e.u) SELECT node, min(seen) AS component FROM r GROUP BY 1")
def c19(spark, d):
    return graph.connected_components(similarity.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4))


@query("c20_merge_odd_groups", "WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT c_mktsegment, string_agg(c_nationkey::VARCHAR, '+' ORDER BY c_nationkey::VARCHAR) AS merged FROM g WHERE n <> 12 GROUP BY 1) SELECT g.c_mktsegment, c_nationkey, CASE WHEN n <> 12 THEN merged ELSE c_nationkey::VARCHAR END AS merged FROM g LEFT JOIN m USING (c_mktsegment)")
def c20(spark, d):
    return R.merge_odd_groups(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", 12)


@query("d15_pivot_counts", "SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source = 'src2') AS src2 FROM documents GROUP BY 1")
def d15(spark, d):
    return R.pivot_counts(docs(spark, d), "lang", "source", ["src0", "src1", "src2"])


@query("d16_top_values", "SELECT o_orderstatus, o_orderpriority, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS rank FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE rank <= 2")
def d16(spark, d):
    return R.top_values(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", 2)


@query("d17_duplicate_summary", "SELECT sum(n)::BIGINT AS rows, count(*) AS \"unique\", count(*) FILTER (n > 1) AS dup_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_dups, count(*) FILTER (n > 1 AND odd) AS conflicting FROM (SELECT md5(text), count(*) AS n, min(source) <> max(source) AS odd FROM documents GROUP BY 1)")
def d17(spark, d):
    return R.duplicate_summary(docs(spark, d), "md5", "source")


@query("d18_grouped_means", "SELECT source, round(avg(n_chars), 3) AS mean_chars, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 3) AS en_share FROM documents GROUP BY 1")
def d18(spark, d):
    return docs(spark, d).groupBy("source").agg(F.round(F.avg("n_chars"), 3).alias("mean_chars"), F.round(F.avg((F.col("lang") == "en").cast("double")), 3).alias("en_share"))


@query("d19_group_sizes", "SELECT c_mktsegment, count(*) AS n_groups, min(n) AS min, quantile_cont(n, 0.5) AS median, max(n) AS max FROM (SELECT c_mktsegment, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def d19(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return R.group_sizes(rows, "c_mktsegment", "c_custkey")


@query("e1_neighbour_similarity", f"SELECT vec_id, round(list_inner_product(v, n), 6) AS sim FROM (SELECT vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM ({EMB})) WHERE n IS NOT NULL")
def e1(spark, d):
    return rounded(similarity.neighbours(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "sim"), "sim")


@query("e2_neighbour_triple", "SELECT event_id, value, coalesce(lag(value) OVER w, value) AS previous, coalesce(lead(value) OVER w, value) AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def e2(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return similarity.triple(e, "user_id", "o", "value").select("event_id", "value", "previous", "following")


@query("e3_keep_last", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def e3(spark, d):
    return R.keep(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], first=False).select("user_id", "event_type", "event_id")


@query("e4_keep_first", "SELECT md5(text) AS md5, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def e4(spark, d):
    return R.keep(docs(spark, d), ["md5"], ["doc_id"]).select("md5", "doc_id")


@query("e10_row_split", "WITH s AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7|' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, CASE WHEN r <= floor(n * 0.1 + 0.5) THEN 'val' WHEN r <= floor(n * 0.1 + 0.5) + floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM s")
def e10(spark, d):
    return P.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 7, (0.7, 0.1, 0.2)).select("o_orderkey", "split")


FOLDS = "SELECT grp, klass, repeat, ((row_number() OVER (PARTITION BY repeat, klass ORDER BY md5(seed || '|' || grp), grp) - 1 + ('0x' || substr(md5(seed || '|' || klass), 1, 8))::BIGINT % 5) % 5)::INT AS outer_fold FROM (SELECT c_custkey AS grp, c_mktsegment AS klass FROM customer), (VALUES (0, 101), (1, 202), (2, 303)) s(repeat, seed)"


def folds(spark, d):
    return P.group_folds(table(spark, d, "customer"), "c_custkey", "c_mktsegment")


@query("e11_group_folds", f'SELECT grp AS "group", klass, repeat, outer_fold FROM ({FOLDS})')
def e11(spark, d):
    return folds(spark, d)


@query("e12_inner_folds", f"SELECT grp AS \"group\", klass, ((row_number() OVER (PARTITION BY klass ORDER BY md5('7|' || grp), grp) - 1 + ('0x' || substr(md5('7|' || klass), 1, 8))::BIGINT % 3) % 3)::INT AS inner_fold FROM ({FOLDS}) WHERE repeat = 0 AND outer_fold <> 2")
def e12(spark, d):
    return P.inner_folds(folds(spark, d), 0, 2)


@query("c17_fold_parts", f"SELECT 'train' AS part, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT grp FROM ({FOLDS}) WHERE repeat = 1 AND outer_fold = 3) UNION ALL SELECT 'test', o_orderkey FROM orders WHERE o_custkey IN (SELECT grp FROM ({FOLDS}) WHERE repeat = 1 AND outer_fold = 3)")
def c17(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("g"))
    train, test = P.fold_parts(o, "g", folds(spark, d), 1, 3)
    return train.select(F.lit("train").alias("part"), "o_orderkey").unionAll(test.select(F.lit("test").alias("part"), "o_orderkey"))


@query("c18_stamp_folds", f"SELECT o_orderkey, repeat, outer_fold FROM orders JOIN ({FOLDS}) ON o_custkey = grp")
def c18(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("g"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("repeat"))
    return P.stamp_folds(o, "g", folds(spark, d)).select("o_orderkey", "repeat", "outer_fold")


@query("e13_fixed_sample", "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 50")
def e13(spark, d):
    return P.fixed_sample(table(spark, d, "orders"), "o_orderkey", 50, by=["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@query("e14_group_label", "WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY 1, 2) SELECT o_custkey, arg_min(o_orderstatus, o) AS first_label, (array_agg(o_orderstatus ORDER BY n DESC, o_orderstatus))[1] AS majority_label, count(*) > 1 AS mixed FROM c GROUP BY 1")
def e14(spark, d):
    return P.group_label(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("e15_random_label", "SELECT o_orderkey, (('0x' || substr(md5('5|' || coalesce(g::VARCHAR, 'row:' || o_orderkey)), 1, 8))::BIGINT % 4)::INT AS label FROM (SELECT o_orderkey, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS g FROM orders)")
def e15(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("g"))
    return o.select("o_orderkey", P.random_label(o, "g", "o_orderkey", 5, 4).alias("label"))


@query("e16_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def e16(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("d32_majority", "SELECT l_returnflag AS majority FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def d32(spark, d):
    from ..operators.metrics import majority

    return majority(table(spark, d, "lineitem"), "l_returnflag")


@query("d38_relative_by_position", "SELECT turn, round(avg(len * n), 6) AS mean, round(stddev_samp(len * n), 6) AS std, count(*) AS n FROM (SELECT turn, length(text) * 1.0 / sum(length(text)) OVER (PARTITION BY conv_id) AS len, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY 1 HAVING count(*) > 1")
def d38(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id")
    c = table(spark, d, "conversations").withColumn("len", F.length("text"))
    x = c.select("turn", (F.col("len") / F.sum("len").over(w) * F.count(F.lit(1)).over(w)).alias("rel"))
    return rounded(x.groupBy("turn").agg(F.avg("rel").alias("mean"), F.stddev_samp("rel").alias("std"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "mean", "std")


@query("d39_sequence_report", f"SELECT 0::BIGINT AS unparsed, (SELECT count(DISTINCT label) FROM embeddings) AS n_groups, 0::BIGINT AS repeated_places, round(avg(s), 6) AS mean_same, round(quantile_cont(s, 0.01), 6) AS p01_same FROM (SELECT list_inner_product(v, lead(v) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM ({EMB})) WHERE s IS NOT NULL")
def d39(spark, d):
    return rounded(similarity.sequence_report(table(spark, d, "embeddings"), "label", "vec_id", "embedding"), "mean_same", "p01_same")


@query("g1_string_functions", "SELECT doc_id, lower(source) AS low, lpad(doc_id::VARCHAR, 6, '0') AS padded, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short, replace(source, 'src', 's ') AS replaced, contains(text, '|') AS has_bar FROM documents")
def g1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower("source").alias("low"), F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("padded"), S.shorten(F.col("text"), 40).alias("short"), F.replace("source", F.lit("src"), F.lit("s ")).alias("replaced"), F.col("text").contains("|").alias("has_bar"))


@query("g2_content_hash", "SELECT page_id, md5(html) AS md5 FROM pages")
def g2(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5("html").alias("md5"))


@query("g3_hamming", "SELECT page_id, bit_count(xor(('0x' || substr(md5(html), 1, 8))::BIGINT, ('0x' || substr(md5(url), 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(md5(html), 9, 8))::BIGINT, ('0x' || substr(md5(url), 9, 8))::BIGINT)) AS distance FROM pages")
def g3(spark, d):
    return table(spark, d, "pages").select("page_id", S.hamming(F.substring(F.md5("html"), 1, 16), F.substring(F.md5("url"), 1, 16)).alias("distance"))
