"""Queries of profiling and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..operators import clean as C
from ..operators import profile as P
from ..sources.tables import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def each(columns, sql):
    return " UNION ALL ".join(sql.format(c=c) for c in columns)


@query("d1_profile", each(NUM, "SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS non_null, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem"))
def d1(spark, d):
    return rounded(P.describe(table(spark, d, "lineitem"), NUM), "mean", "std", "q25", "q50", "q75")


@query("d2_missing_pct", "SELECT * FROM (" + each(["l_tax", "l_discount", "l_quantity"], "SELECT '{c}' AS column_name, round(avg(CASE WHEN l_linenumber % 7 = 0 AND '{c}' <> 'l_quantity' THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_pct FROM lineitem") + ") WHERE missing_pct > 0")
def d2(spark, d):
    return rounded(P.missing_share(holes(table(spark, d, "lineitem")), ["l_tax", "l_discount", "l_quantity"]), "missing_pct")


def holes(lineitem):
    """lineitem with NULLs in two columns of every seventh line."""
    gap = F.col("l_linenumber") % 7 == 0
    return lineitem.withColumns({c: F.when(~gap, F.col(c)) for c in ("l_tax", "l_discount")})


@query("d3_duplicate_rows", "SELECT concat_ws('|', l_returnflag, l_linestatus, l_linenumber::VARCHAR, l_quantity::VARCHAR) AS label, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber, l_quantity HAVING count(*) > 1")
def d3(spark, d):
    return P.duplicate_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"])


@query("d4_value_counts", "SELECT quality::VARCHAR AS value, CASE quality WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM labels GROUP BY quality")
def d4(spark, d):
    return rounded(P.value_counts(table(spark, d, "labels"), "quality"), "pct")


@query("d5_low_cardinality", "SELECT * FROM (" + each(["o_orderstatus", "o_orderpriority", "o_custkey"], "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM orders") + ") WHERE n_distinct > 1 AND n_distinct <= 10")
def d5(spark, d):
    return P.low_cardinality(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("d6_histogram", "SELECT least(floor((value - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def d6(spark, d):
    return P.histogram(table(spark, d, "events"), "value")


@query("d7_edge_bins", "SELECT CASE WHEN p_size >= 0 AND p_size <= 10 THEN '(0, 10]' WHEN p_size > 10 AND p_size <= 18 THEN '(10, 18]' WHEN p_size > 18 AND p_size <= 25 THEN '(18, 25]' WHEN p_size > 25 AND p_size <= 40 THEN '(25, 40]' END AS bin, count(*) AS n FROM part GROUP BY 1")
def d7(spark, d):
    return P.edge_counts(table(spark, d, "part"), "p_size", [0, 10, 18, 25, 40])


PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]
CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS)


@query("d8_correlation", f"SELECT a, b, round(r, 9) AS r FROM ({CORR})")
def d8(spark, d):
    return rounded(P.correlation_matrix(table(spark, d, "lineitem"), NUM), "r", digits=9)


@query("d9_top_correlations", f"SELECT a, b, round(r, 9) AS r, round(abs(r), 9) AS abs_r FROM ({CORR}) WHERE abs(r) < 1 ORDER BY abs(r) DESC, a, b LIMIT 3")
def d9(spark, d):
    return rounded(P.top_correlations(table(spark, d, "lineitem"), NUM, 3), "r", "abs_r", digits=9)


FACTOR = "SELECT l.*, f.code FROM lineitem l JOIN (SELECT l_returnflag AS v, dense_rank() OVER (ORDER BY min(l_orderkey * 10 + l_linenumber), l_returnflag) - 1 AS code FROM lineitem GROUP BY 1) f ON l.l_returnflag = f.v"


def with_target(spark, d):
    li = table(spark, d, "lineitem").withColumn("__o", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_returnflag")))
    return C.encode(li, "l_returnflag", C.appearance_codes(li, "l_returnflag", "__o")).withColumn("code", F.col("l_returnflag_code"))


@query("d10_target_correlation", f"WITH t AS ({FACTOR}) " + each(NUM, "SELECT '{c}' AS column_name, round(coalesce(corr({c}, code), 0), 9) AS r FROM t"))
def d10(spark, d):
    return rounded(P.target_correlation(with_target(spark, d), NUM, "code"), "r", digits=9)


@query("b12_appearance_codes", "SELECT l_returnflag AS value, (dense_rank() OVER (ORDER BY min(l_orderkey * 10 + l_linenumber), l_returnflag) - 1)::INT AS code FROM lineitem GROUP BY 1")
def b12(spark, d):
    li = table(spark, d, "lineitem").withColumn("__o", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_returnflag")))
    return C.appearance_codes(li, "l_returnflag", "__o")


@query("d11_profile_similarity", f"WITH h AS (SELECT a, b, r FROM ({CORR})), f AS (SELECT * FROM h UNION ALL SELECT b, a, r FROM h) SELECT x.a AS column_name, round(avg(abs(x.r - t.r)), 9) AS distance FROM f x JOIN f t ON t.a = 'l_tax' AND t.b = x.b WHERE x.a <> 'l_tax' AND x.b <> 'l_tax' GROUP BY 1")
def d11(spark, d):
    return rounded(P.profile_similarity(table(spark, d, "lineitem"), NUM[:3], "l_tax"), "distance", digits=9)


@query("d12_regression_line", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*)::BIGINT AS n FROM lineitem")
def d12(spark, d):
    return rounded(rounded(P.regression_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "slope"), "intercept", digits=4)


@query("d13_target_mean", "SELECT l_linenumber, round(avg(x), 6) AS mean, count(*) AS n, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)), 6) AS lo, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)), 6) AS hi FROM (SELECT l_linenumber, l_discount AS x FROM lineitem) GROUP BY 1")
def d13(spark, d):
    return rounded(P.target_mean(table(spark, d, "lineitem"), "l_linenumber", "l_discount"), "mean", "lo", "hi")


@query("d14_box_statistics", "WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1), x AS (SELECT q.*, o_totalprice AS p, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders JOIN q USING (o_orderpriority)) SELECT o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(p) FILTER (inside) AS whisker_lo, max(p) FILTER (inside) AS whisker_hi, count(*) FILTER (NOT inside) AS n_outliers FROM x GROUP BY ALL")
def d14(spark, d):
    return rounded(P.box_statistics(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "q1", "median", "q3")


@query("d44_score_range", "SELECT 'o_totalprice' AS column_name, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 6) AS mean FROM orders")
def d44(spark, d):
    return rounded(P.aggregate_columns(table(spark, d, "orders"), ["o_totalprice"], {"min": F.min, "max": F.max, "mean": F.avg}), "mean")
