"""Queries of cleaning and fitted transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..registry import query
from ..sources.tables import table
from .profile import NUM, each, holes, rounded

HOLES = "(SELECT * REPLACE (CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_discount END AS l_discount) FROM lineitem)"


@query("b1_drop_identifiers", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def b1(spark, d):
    return C.drop_identifiers(table(spark, d, "customer"), ["c_custkey", "c_name", "not_there"])


@query("b2_rename_aliases", "SELECT c_custkey AS patient_id, c_name AS name, c_nationkey AS c_nationkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def b2(spark, d):
    return C.rename_aliases(table(spark, d, "customer"), {"c_custkey": "patient_id", "c_name": "name", "c_acctbal": "balance", "acct_bal": "balance", "c_mktsegment": "segment"})


@query("b3_missing_features", "SELECT feature FROM (VALUES ('k'), ('age'), ('bmi')) t(feature) WHERE feature NOT IN (SELECT unnest(json_keys(props)) FROM events)")
def b3(spark, d):
    return C.missing_keys(table(spark, d, "events"), "props", ["k", "age", "bmi"])


@query("b4_empty_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 7 = 0")
def b4(spark, d):
    return C.split_empty_rows(holes(table(spark, d, "lineitem")), ["l_tax", "l_discount"])[1].select("l_orderkey", "l_linenumber")


@query("b5_surrogate_id", "SELECT CASE WHEN event_id % 5 = 0 THEN substr(md5('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}'), 1, 12) ELSE event_id::VARCHAR END AS id, event_type, user_id FROM events")
def b5(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("id"), "event_type", "user_id")
    return C.surrogate_id(e, "id")


@query("b6_impose_features", "SELECT p_size, 0 AS p_weight, p_retailprice FROM part")
def b6(spark, d):
    return C.impose_features(table(spark, d, "part"), ["p_size", "p_weight", "p_retailprice"])


@query("b7_coerce_numeric", "SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE k::DOUBLE END AS k, event_type FROM (SELECT event_id, event_type, (props->>'k')::INT AS k FROM events)")
def b7(spark, d):
    k = F.get_json_object("props", "$.k")
    e = table(spark, d, "events").select("event_id", F.when(k.cast("int") % 10 == 0, "unknown").otherwise(k).alias("k"), "event_type")
    return C.coerce_numeric(e, ["k", "event_type"])


@query("b8_binary_columns", "SELECT * FROM (VALUES ('quality', 'binary'), ('toxic', 'binary'), ('doc_id', 'other')) t(column_name, kind)")
def b8(spark, d):
    return C.binary_columns(table(spark, d, "labels"), ["quality", "toxic", "doc_id"])


@query("b9_min_max_fit", "WITH t AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0) " + each(NUM, "SELECT '{c}' AS column_name, min({c}) AS lo, max({c}) AS hi, min({c}) <> max({c}) AS scaled FROM t"))
def b9(spark, d):
    p = C.FitParams().fit_ranges(table(spark, d, "lineitem").filter("l_orderkey % 5 <> 0"), NUM)
    return spark.createDataFrame([(c, *v) for c, v in p.ranges.items()], "column_name string, lo double, hi double, scaled boolean")


@query(
    "b10_min_max_apply",
    f"WITH t AS (SELECT min(l_tax) AS a, max(l_tax) AS b, min(l_quantity) AS e, max(l_quantity) AS f FROM {HOLES} WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, round((coalesce(l_tax, a) - a) / (b - a), 9) AS l_tax, round((l_quantity - e) / (f - e), 9) AS l_quantity FROM {HOLES}, t",
)
def b10(spark, d):
    li = holes(table(spark, d, "lineitem"))
    p = C.FitParams.from_json(C.FitParams().fit_ranges(li.filter("l_orderkey % 5 <> 0"), ["l_tax", "l_quantity"]).to_json())
    return rounded(p.scale_ranges(li).select("l_orderkey", "l_linenumber", "l_tax", "l_quantity"), "l_tax", "l_quantity", digits=9)


@query("b11_sorted_codes", "SELECT o_orderkey, o_orderpriority, coalesce(code, -1)::INT AS o_orderpriority_code FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders) LEFT JOIN (SELECT p, dense_rank() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderkey % 11 <> 0)) ON o_orderpriority = p")
def b11(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return C.encode(o, "o_orderpriority", C.sorted_codes(o, "o_orderpriority"))


@query("b13_label_codes", "SELECT o_orderkey, coalesce(code, 0)::INT AS code FROM orders LEFT JOIN (SELECT p, dense_rank() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS p FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'P')) ON o_orderstatus = p")
def b13(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    codes = C.label_codes(o.filter("o_orderkey % 5 = 0 and o_orderstatus <> 'P'"), "o_orderstatus")
    return C.encode(o, "o_orderstatus", codes, unseen=0).select("o_orderkey", F.col("o_orderstatus_code").alias("code"))


@query("b14_impute", f"WITH m AS (SELECT quantile_cont(l_tax, 0.5) AS t, quantile_cont(l_discount, 0.5) AS x FROM {HOLES} WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, coalesce(l_tax, t) AS l_tax, coalesce(l_discount, x) AS l_discount FROM {HOLES}, m")
def b14(spark, d):
    li = holes(table(spark, d, "lineitem"))
    return C.FitParams().fit_fills(li.filter("l_orderkey % 5 <> 0"), ["l_tax", "l_discount"]).impute(li).select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


BOUNDS = "SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events WHERE event_id % 5 <> 0)"


@query("b15_winsorize", f"SELECT event_id, round(least(greatest(value, lo), hi), 9) AS value FROM events, ({BOUNDS})")
def b15(spark, d):
    e = table(spark, d, "events")
    return rounded(C.FitParams().fit_bounds(e.filter("event_id % 5 <> 0"), ["value"]).winsorize(e).select("event_id", "value"), "value", digits=9)


@query("b15_outlier_counts", f"SELECT 'value' AS column_name, count(*) FILTER (value < lo OR value > hi) AS n_outliers FROM events, ({BOUNDS})")
def b15_counts(spark, d):
    e = table(spark, d, "events")
    return C.FitParams().fit_bounds(e.filter("event_id % 5 <> 0"), ["value"]).outlier_counts(e)


@query("b15_zscore_clip", "SELECT event_id, round(least(greatest(value, m - 3 * s), m + 3 * s), 6) AS value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 5 <> 0)")
def b15_z(spark, d):
    e = table(spark, d, "events")
    return rounded(C.FitParams().fit_bounds(e.filter("event_id % 5 <> 0"), ["value"], method="zscore", width=3.0).winsorize(e).select("event_id", "value"), "value")


@query("b16_features_and_target", "SELECT l_quantity, l_discount, l_tax, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::INT AS target FROM lineitem")
def b16(spark, d):
    li = table(spark, d, "lineitem")
    x = C.encode(li, "l_returnflag", C.sorted_codes(li, "l_returnflag"))
    return C.drop_identifiers(x, ["l_orderkey"]).select("l_quantity", "l_discount", "l_tax", F.col("l_returnflag_code").alias("target"))


@query("b17_standard_scale", "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 5 <> 0)")
def b17(spark, d):
    o = table(spark, d, "orders")
    return rounded(C.FitParams().fit_scales(o.filter("o_orderkey % 5 <> 0"), ["o_totalprice"]).standardise(o).select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("b17_robust_scale", "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS s FROM orders WHERE o_orderkey % 5 <> 0)")
def b17_robust(spark, d):
    o = table(spark, d, "orders")
    return rounded(C.FitParams().fit_scales(o.filter("o_orderkey % 5 <> 0"), ["o_totalprice"], robust=True).standardise(o).select("o_orderkey", "o_totalprice"), "o_totalprice")


def dims(spark, d, n=4):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)])


F_STAT = " UNION ALL ".join(
    f"SELECT 'x{i}' AS feature, round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 6) AS f FROM (SELECT label, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM (SELECT label, embedding[{i + 1}]::DOUBLE AS x FROM embeddings) GROUP BY 1)" for i in range(4)
)


@query("b18_anova_f", F_STAT)
def b18(spark, d):
    return rounded(C.anova_f(dims(spark, d), [f"x{i}" for i in range(4)], "label"), "f")


MI = """WITH v AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), r AS (SELECT i, min(x) AS lo, max(x) AS hi FROM v GROUP BY i),
b AS (SELECT i, label, least(floor((x - lo) * 10 / (hi - lo)), 9) AS bin FROM v JOIN r USING (i)), c AS (SELECT i, bin, label, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT i, n, sum(n) OVER (PARTITION BY i) AS a, sum(n) OVER (PARTITION BY i, bin) AS nb, sum(n) OVER (PARTITION BY i, label) AS ny FROM c)
SELECT 'x' || i AS feature, round(sum(n / a * ln(n * a / (nb * ny))), 6) AS mi FROM m GROUP BY i"""


@query("b18_mutual_information", MI)
def b18_mi(spark, d):
    return rounded(C.mutual_information(dims(spark, d, 64), [f"x{i}" for i in range(64)], "label"), "mi")


def psi(n):
    """SQL of the digamma function."""
    x = f"({n} + 6.0)"
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x}**2) + 1 / (120 * {x}**4) - 1 / (252 * {x}**6) + 1 / (240 * {x}**8)" + "".join(f" - 1 / ({n} + {i}.0)" for i in range(6)) + ")"


NEIGHBOURS = f"""WITH v AS (SELECT vec_id AS id, label AS y, 'x' || (unnest(range(0, 64)))::VARCHAR AS f, unnest(embedding)::DOUBLE AS x FROM embeddings),
n AS (SELECT *, count(*) OVER (PARTITION BY f, y) AS ny FROM v), w AS (SELECT *, least(3, ny - 1) AS k FROM n WHERE ny > 1),
r AS (SELECT a.f, a.id, a.x, a.ny, a.k, list_sort(list(abs(b.x - a.x)))[any_value(a.k)] AS r FROM w a JOIN w b ON a.f = b.f AND a.y = b.y AND a.id <> b.id GROUP BY ALL),
m AS (SELECT r.f, r.id, any_value(ny) AS ny, any_value(k) AS k, count(*) FILTER (CASE WHEN r.r > 0 THEN w2.x > r.x - r.r AND w2.x < r.x + r.r ELSE w2.x = r.x END) AS m FROM r JOIN (SELECT f, x FROM w) w2 USING (f) GROUP BY r.f, r.id)
SELECT f AS feature, round(greatest({psi('count(*)')} + avg({psi('k')}) - avg({psi('ny')}) - avg({psi('m')}), 0), 6) AS mi FROM m GROUP BY f"""


@query("b18_neighbour_information", NEIGHBOURS)
def b18_neighbours(spark, d):
    return rounded(C.neighbour_information(dims(spark, d, 64), [f"x{i}" for i in range(64)], "label", "vec_id"), "mi")


@query("b19_finite", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (3, 5) THEN NULL ELSE l_tax END AS l_tax FROM lineitem")
def b19(spark, d):
    li = table(spark, d, "lineitem")
    odd = F.when(F.col("l_linenumber") == 3, float("nan")).when(F.col("l_linenumber") == 5, float("inf")).otherwise(F.col("l_tax"))
    return C.finite(li.withColumn("l_tax", odd), ["l_tax"]).select("l_orderkey", "l_linenumber", "l_tax")


@query("b20_quality_gate", "SELECT page_id, CASE WHEN octet_length(encode(html)) > 5000 THEN 'too large' WHEN NOT regexp_matches(html, '^<!DOCTYPE') THEN 'wrong type' WHEN octet_length(encode(html)) < 1500 THEN 'too small' ELSE 'ok' END AS reason FROM pages")
def b20(spark, d):
    size = F.octet_length("html")
    reason = F.when(size > 5000, "too large").when(~F.col("html").rlike("^<!DOCTYPE"), "wrong type").when(size < 1500, "too small").otherwise("ok")
    return table(spark, d, "pages").select("page_id", reason.alias("reason"))


@query("b21_label_remap", "SELECT vec_id, CASE WHEN label IN (0, 1) THEN 0 WHEN label IN (2, 3, 4) THEN 1 WHEN label < 8 THEN 2 END::INT AS y FROM embeddings")
def b21(spark, d):
    return table(spark, d, "embeddings").select("vec_id", C.remap(F.col("label"), {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2}).cast("int").alias("y"))


PATTERNS = [("anchor", "#[a-z]+$"), ("query", r"\?"), ("mobile", "//m\\."), ("numbered", "/[0-9]+/?$")]


@query("b22_first_pattern", "SELECT page_id, CASE WHEN regexp_matches(url, '#[a-z]+$') THEN 'anchor' WHEN regexp_matches(url, '\\?') THEN 'query' WHEN regexp_matches(url, '//m\\.') THEN 'mobile' WHEN regexp_matches(url, '/[0-9]+/?$') THEN 'numbered' ELSE 'other' END AS kind FROM pages")
def b22(spark, d):
    return table(spark, d, "pages").select("page_id", C.first_pattern(F.col("url"), PATTERNS).alias("kind"))


@query("b23_parse_ids", "SELECT c_custkey, (n % 70)::INT AS subject, (n // 70)::INT AS pos FROM (SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)$', 1)::BIGINT AS n FROM customer)")
def b23(spark, d):
    from ..functions.scalars import parse_subject

    s = parse_subject(F.regexp_replace("c_name", "#0*([0-9]+)$", "$1"), F.lit(70))
    return table(spark, d, "customer").select("c_custkey", s["subject"].alias("subject"), s["pos"].alias("pos"))


@query("b24_format_ids", "SELECT c_custkey, c_mktsegment || '::S' || lpad(coalesce(m, c_custkey % 70)::VARCHAR, 3, '0') AS subject FROM customer LEFT JOIN (SELECT n_nationkey::BIGINT AS f, n_regionkey + 100 AS m FROM nation) ON c_custkey % 70 = f")
def b24(spark, d):
    fix = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("f"), (F.col("n_regionkey") + 100).alias("m"))
    c = table(spark, d, "customer").withColumn("s", F.col("c_custkey") % 70)
    return c.join(fix, F.col("s") == F.col("f"), "left").select("c_custkey", F.format_string("%s::S%03d", "c_mktsegment", F.coalesce("m", "s")).alias("subject"))


@query("b25_strip_prefix", "SELECT page_id, regexp_replace(url, '^https?://(www\\.|m\\.)?', '') AS bare, CASE WHEN regexp_matches(url, '^https') THEN 'secure' ELSE 'plain' END AS provenance FROM pages")
def b25(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://(www\.|m\.)?", "").alias("bare"), F.when(F.col("url").rlike("^https"), "secure").otherwise("plain").alias("provenance"))


@query("b26_position_one_hot", "SELECT l_orderkey, l_linenumber, list_transform(range(0, 8), lambda k: CASE WHEN least(l_linenumber * 7 // 4, 7) = k THEN 1 ELSE 0 END)::VARCHAR AS one_hot FROM lineitem")
def b26(spark, d):
    from ..functions.scalars import position_one_hot

    hot = position_one_hot(F.col("l_linenumber") * 7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("["), F.array_join(F.transform(hot, lambda x: x.cast("string")), ", "), F.lit("]")).alias("one_hot"))


@query("b27_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority NOT LIKE '%LOW%' AND o_orderdate >= TIMESTAMP '1998-01-01'")
def b27(spark, d):
    o = table(spark, d, "orders")
    return o.filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000) & ~F.col("o_orderpriority").contains("LOW") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))).select("o_orderkey")


@query("b28_risk_bands", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'positive' ELSE 'negative' END || CASE WHEN s >= 0.8 THEN '_high' WHEN s >= 0.6 THEN '_moderate' ELSE '_low' END AS band FROM (SELECT *, least(value / 100, 1.0) AS s FROM events)")
def b28(spark, d):
    return table(spark, d, "events").select("event_id", C.risk_band(F.col("event_type") == "error", F.least(F.col("value") / 100, F.lit(1.0))).alias("band"))


@query("d31_class_weights", "SELECT label, n, round(sum(n) OVER () * 1.0 / (count(*) OVER () * n), 9) AS weight FROM (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1)")
def d31(spark, d):
    from ..operators.metrics import class_weights

    return rounded(class_weights(table(spark, d, "embeddings").filter("vec_id % 5 <> 0"), "label"), "weight", digits=9)


@query("g12_try_cast", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE props->>'k' END AS INT) AS k FROM events")
def g12(spark, d):
    k = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", k.try_cast("int").alias("k"))
