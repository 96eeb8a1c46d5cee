"""Operators on small frames: planted truths, hand-computed values and invariants."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import scalars as S
from cohortlens.operators import bootstrap, clean, graph, image, metrics, ml, profile, relate, select, similarity, split
from cohortlens.sources import io
from cohortlens.streaming import incoming


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_profile_of_nulls_and_constants(spark):
    df = frame(spark, [(1.0, None, 2), (2.0, None, 2), (3.0, None, 2), (4.0, None, 2), (100.0, None, 2)], "a double, b double, c int")
    d = {r.column_name: r for r in profile.describe(df, ["a", "b", "c"]).collect()}
    assert (d["a"].q25, d["a"].q50, d["a"].q75, d["b"].non_null, d["c"].std) == (2.0, 3.0, 4.0, 0, 0.0)
    assert profile.correlation_matrix(df, ["a", "c"]).first().r is None
    assert profile.target_correlation(df, ["a", "b"], "c").filter("r <> 0").count() == 0
    assert {r.bin: r.n for r in profile.histogram(df, "a", 20).collect()} == {0: 4, 19: 1}
    assert [r.bin for r in profile.histogram(df, "c", 20).collect()] == [0]
    assert {r.column_name for r in profile.missing_share(df, ["a", "b", "c"]).collect()} == {"b"}
    box = profile.box_statistics(df.withColumn("g", F.lit("x")), "g", "a").first()
    assert (box.whisker_lo, box.whisker_hi, box.n_outliers) == (1.0, 4.0, 1)
    bins = frame(spark, [(0.0,), (10.0,), (10.5,), (99.0,)], "x double").select(profile.edge_bin(F.col("x"), [0, 10, 20]).alias("b")).collect()
    assert [r.b for r in bins] == ["(0, 10]", "(0, 10]", "(10, 20]", None]


def test_rename_and_impose(spark):
    df = frame(spark, [(1, None, "x"), (2, "y", "z")], "PID int, seg string, SEGM string")
    got = clean.rename_aliases(df, {"PID": "id", "SEGM": "seg"})
    assert got.columns == ["id", "seg"] and [r.seg for r in got.collect()] == ["x", "y"]
    assert clean.impose_features(df, ["seg", "age"]).columns == ["seg", "age"]
    assert [r.feature for r in clean.missing_features(df, ["PID", "age"]).collect()] == ["age"]


@pytest.mark.parametrize(("good", "numeric"), [(79, False), (80, True)])
def test_numeric_majority(spark, good, numeric):
    df = frame(spark, [("1.5" if i < good else "n/a",) for i in range(100)], "v string")
    got = clean.coerce_numeric(df, ["v"])
    assert dict(got.dtypes)["v"] == ("double" if numeric else "string")
    if numeric:
        assert got.filter("v is null").count() == 20


def test_fits_never_see_other_rows(spark):
    train = frame(spark, [(float(i), 1 if i == 0 else 0, None) for i in range(10)], "x double, flag int, none double")
    other = frame(spark, [(20.0, 1, None), (None, 0, 3.0)], "x double, flag int, none double")
    p = clean.FitParams().fit_ranges(train, ["x", "none"])
    p = clean.FitParams.from_json(p.to_json())
    assert [r.x for r in p.scale_ranges(other).collect()] == [20 / 9, 0.0]
    assert [r.x for r in p.scale_ranges(other, clip=True).collect()] == [1.0, 0.0]
    assert [r.none for r in p.scale_ranges(other).collect()] == [0.0, 3.0]
    b = clean.FitParams().fit_bounds(train, ["x", "flag"])
    assert "flag" not in b.bounds and [r.flag for r in b.winsorize(other).collect()] == [1, 0]
    assert "flag" in clean.FitParams().fit_bounds(train, ["x", "flag"], skip_binary=False).bounds
    assert [r.x for r in clean.FitParams().fit_fills(train, ["x"]).impute(other).collect()] == [20.0, 4.5]
    s = clean.FitParams().fit_scales(train, ["x"]).standardise(train)
    assert s.agg(F.stddev_pop("x")).first()[0] == pytest.approx(1.0)
    assert {r.column_name: r.kind for r in clean.binary_columns(train, ["x", "flag", "none"]).collect()} == {"x": "other", "flag": "binary", "none": "empty"}


def test_codes_of_unseen_values(spark):
    train = frame(spark, [("b",), ("a",), (None,), ("b",)], "v string")
    got = clean.encode(frame(spark, [("a",), ("zz",), ("b",), (None,)], "v string"), "v", clean.sorted_codes(train, "v"))
    assert {r.v: r.v_code for r in got.collect()} == {"a": 0, "zz": -1, "b": 1, None: -1}
    assert {r.value: r.code for r in clean.label_codes(train, "v").collect()} == {"a": 0, "b": 1, "nan": 2}


def test_rejected_and_made_ids(spark):
    df = frame(spark, [(" ", None), ("7", "x"), (None, " ")], "id string, v string")
    good, bad = clean.split_empty_rows(df, ["v"])
    assert good.count() == 1 and bad.count() == 2
    ids = [r.id for r in clean.surrogate_id(df, "id").collect()]
    assert ids[1] == "7" and all(len(i) == 12 for i in (ids[0], ids[2])) and ids == [r.id for r in clean.surrogate_id(df, "id").collect()]


def test_parse_subject(spark):
    names = ["mildDem0", "mildDem29", "nonDem250", "27 (43)", "28", "0f2c-uuid"]
    per = {"mildDem0": 28, "mildDem29": 28, "nonDem250": 100}
    rows = [(n, per.get(n, 100)) for n in names]
    got = [r.s for r in frame(spark, rows, "n string, p int").select(S.parse_subject(F.col("n"), F.col("p")).alias("s")).collect()]
    assert [tuple(s) if s else None for s in got] == [(0, 0), (1, 1), (50, 2), (42, 27), (0, 28), None]


def test_hamming_softmax_ordinal(spark):
    r = frame(spark, [("f" * 16, "0" * 15 + "f")], "a string, b string").select(S.hamming(F.col("a"), F.col("b")).alias("h")).first()
    assert r.h == 60
    one = spark.range(1)
    p = one.select(S.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p"), S.ordinal_probabilities(F.array(F.lit(0.4), F.lit(0.9))).alias("o"), S.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("m")).first()
    assert p.p == [0.5, 0.5] and sum(p.o) == pytest.approx(1) and p.m == 1
    assert p.o == pytest.approx([0.6, 1e-6, 0.4], abs=1e-5)
    d = one.select(S.decision(F.lit(0.37604)).alias("d")).first().d
    assert (d.predicted, round(d.risk, 5), round(d.margin, 5), d.uncertain) == (0, 0.62396, 0.12396, False)


def test_metrics_by_hand(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 0), (2, 2)]
    cm = metrics.confusion(frame(spark, rows, "y int, pred int"), "y", "pred", range(4))
    assert cm.count() == 16
    m = metrics.classification(cm).first()
    f1 = [2 / 3, 0.5, 2 / 3]
    assert m.accuracy == pytest.approx(5 / 8) and m.macro_f1 == pytest.approx(sum(f1) / 3) and m.balanced_accuracy == pytest.approx((2 / 3 + 1 / 2 + 2 / 3) / 3)
    s = frame(spark, [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)], "y int, s double")
    assert metrics.roc_auc(s, "y", "s").first().auc == pytest.approx((2 + 1.5 + 0.5) / 6)
    assert metrics.roc_auc(s.filter("y = 1"), "y", "s").first().auc is None
    assert metrics.kappa(metrics.confusion(frame(spark, [(1, 1), (1, 1)], "y int, pred int"), "y", "pred", range(3))).first().kappa is None
    c = frame(spark, [(0.0, 1), (0.1, 1), (0.15, 0), (1.0, 1)], "c double, ok int")
    assert {r.bin: r.n for r in metrics.calibration_bins(c, "c", "ok").collect()} == {1: 1, 2: 1, 10: 1}
    sweep = metrics.threshold_sweep(s, "y", "s", [0.2, 0.6]).collect()
    assert {round(r.threshold, 1): (r.tp, r.fp, r.fn) for r in sweep} == {0.2: (2, 1, 1), 0.6: (1, 0, 2)} and [r.best for r in sorted(sweep)] == [True, False]


def test_unit_probabilities(spark):
    rows = [("u", [0.2, 0.8]), ("u", [0.4, 0.6]), ("u", [0.9, 0.1]), ("v", [1.0, 0.0])]
    df = frame(spark, rows, "u string, p array<double>")
    for how in ("mean", "median", "trimmed", "top", "logmean"):
        got = metrics.unit_probabilities(df, "u", "p", how).groupBy("u").agg(F.sum("p").alias("t")).collect()
        assert all(r.t == pytest.approx(1) for r in got) and len(got) == 2
    assert metrics.unit_statistics(df, "u", "p").filter("u = 'v' and k = 0").first().std == 0.0


def test_components_of_planted_groups(spark):
    r = random.Random(2)
    edges, want = [], {}
    for g in range(12):
        ids = r.sample(range(g * 100, g * 100 + 100), 15)
        for a, b in zip(ids, ids[1:], strict=False):
            edges.append((b, a))
        want |= {i: min(ids) for i in ids}
    got = graph.connected_components(frame(spark, edges, "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == want


def test_unit_split_of_small_classes(spark):
    units = [(f"M{i}", "M") for i in range(2)] + [(f"N{i}", "N") for i in range(100)] + [(f"V{i}", "V") for i in range(70)] + [("O0", "O")]
    df = frame(spark, units, "u string, c string")
    a = {r.u: (r.c, r.split) for r in split.stratified_split(df, "u", "c", 1).collect()}
    count = lambda c: tuple(sum(x == (c, s) for x in a.values()) for s in ("train", "val", "test"))
    assert count("N") == (70, 15, 15) and count("M") == (1, 0, 1) and count("O") == (1, 0, 0) and min(count("V")) >= 10
    assert a == {r.u: (r.c, r.split) for r in split.stratified_split(df.repartition(7), "u", "c", 1).collect()}
    assert a != {r.u: (r.c, r.split) for r in split.stratified_split(df, "u", "c", 2).collect()}


def test_group_folds(spark):
    groups = frame(spark, [(i, "abc"[i % 3]) for i in range(61)], "g long, c string")
    f = split.group_folds(groups, "g", "c").cache()
    assert f.groupBy("group", "repeat").count().filter("count <> 1").count() == 0 and f.count() == 183
    sizes = [r["count"] for r in f.groupBy("repeat", "klass", "outer_fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    rows = groups.crossJoin(spark.range(3))
    train, test = split.fold_parts(rows, "g", f, 0, 2)
    assert train.count() + test.count() == rows.count() and train.join(test, "g").count() == 0
    inner = split.inner_folds(f, 0, 2)
    assert inner.join(f.filter("repeat = 0 and outer_fold = 2"), "group").count() == 0


def test_shuffled_labels_fall_to_chance(spark):
    g = np.random.default_rng(5)
    rows = [(i, [float(x) for x in g.normal(size=4) + (i % 2) * 3], float(i % 2)) for i in range(300)]
    df = ml.vectors(frame(spark, rows, "id long, v array<double>, label double"), "v")
    test = F.pmod(split.seeded_int(1, "id"), F.lit(3)) == 0
    real = ml.classifier("naive_bayes").fit(df.filter(~test))
    fake = df.withColumn("label", split.random_label(df, "id", "id", 3, 2).cast("double"))
    null = ml.classifier("naive_bayes").fit(fake.filter(~test))
    assert ml.scored(real, df.filter(test), score="accuracy") > 0.95
    assert abs(ml.scored(null, fake.filter(test), score="accuracy") - 0.5) < 0.2
    knn = ml.knn_classify(df.filter(~test), df.filter(test), "id", "v", "label")
    assert knn.join(df, "id").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.6
    more = ml.smote(df.filter("label = 0 or id % 10 = 1"), "id", "v", "label", 1.0)
    assert {r.label: r["count"] for r in more.groupBy("label").count().collect()} == {0.0: 150, 1.0: 150}


def test_bootstrap(spark):
    r = random.Random(1)
    rows = [(i % 30, i % 3, i % 3 if r.random() < 0.8 else r.randrange(3)) for i in range(300)]
    df = frame(spark, rows, "unit long, y int, pred int")
    d = bootstrap.draws(df, "unit", 8)
    assert {x["sum(weight)"] for x in d.groupBy("b").sum("weight").collect()} == {30}
    i = bootstrap.metric_interval(df, "unit", "y", "pred", "accuracy", 60).first()
    truth = sum(a == b for _, a, b in rows) / 300
    assert i.lo < truth < i.hi
    p = bootstrap.interval(metrics.classification(bootstrap.poisson_counts(df, "unit", "y", "pred", 3, 200), ["b"]), "accuracy").first()
    assert abs(p.lo - i.lo) < 0.04 and abs(p.hi - i.hi) < 0.04
    same = bootstrap.paired_difference(df, df, "unit", "y", "pred", "accuracy", 20).first()
    assert same.mean == 0 and same.p == 1.0 and not same.distinguishable
    worse = df.withColumn("pred", (F.col("pred") + 1) % 3)
    assert bootstrap.paired_difference(df, worse, "unit", "y", "pred", "accuracy", 20).first().distinguishable


def test_relations(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 2), ("b", 2), ("c", 2), (None, 1)], "s string, k int")
    assert {(r.a, r.b): r.shared for r in relate.set_overlap(df, "s", "k").collect()} == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1}
    assert {r.s for r in relate.unambiguous(df.filter("s is not null"), "s", "k").collect()} == {"b", "c"}
    assert relate.duplicate_summary(df, "k", "s").first().asDict() == {"rows": 6, "unique": 2, "dup_groups": 2, "rows_in_dups": 6, "conflicting": 1}
    e = select.ensemble(frame(spark, [(1, [0.0, 1.0]), (1, [1.0, 0.0])], "id int, p array<double>"), ["id"], "p").first()
    assert e.p == [0.5, 0.5]


def png(a: np.ndarray) -> bytes:
    """A grey PNG."""
    h, w = a.shape
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + a[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def ellipse(h=60, w=80, grey=40):
    y, x = np.mgrid[:h, :w]
    return np.where(((y - h / 2) / (h / 3)) ** 2 + ((x - w / 2) / (w / 4)) ** 2 < 1, 200, grey).astype(np.uint8)


def test_images(spark, tmp_path):
    (tmp_path / "train" / "Mild").mkdir(parents=True)
    (tmp_path / "train" / "Mild" / "good.png").write_bytes(png(ellipse()))
    (tmp_path / "train" / "Mild" / "bad.png").write_bytes(b"not an image")
    (tmp_path / "train" / "Mild" / "note.txt").write_bytes(b"-")
    files = io.scan_files(spark, str(tmp_path)).collect()
    assert {(f.stem, f.class_name, f.split) for f in files} == {("good", "Mild", "train"), ("bad", "Mild", "train")}
    good, bad = io.decode_images(spark, str(tmp_path / "train" / "Mild"))
    assert bad.filter("origin like '%bad.png'").count() == 1
    table = image.grey_table(good)
    d = image.describe(table).first()
    assert (d.height, d.width) == (60, 80) and len(d.dhash) == 16 and d.frac_black == 0
    s = image.standardised(table, 32).first()
    a = np.frombuffer(s.data, np.uint8).reshape(32, 32)
    assert a[0, 0] == 0 and a[16, 16] > 100
    assert image.feature_vectors(table, 4).first().vec == pytest.approx((image.resized(ellipse(), 4, 4) / 255).ravel().tolist(), abs=1e-6)
    twice = [sorted((r.id, r.data) for r in image.augmented(table, 2).collect()) for _ in range(2)]
    assert twice[0] == twice[1] and len(twice[0]) == 2 and twice[0][0][1] != twice[0][1][1]
    assert image.standardise(np.full((40, 40), 90, np.uint8), 16) is None
    flat = frame(spark, [([5.0, 5.0],), ([1.0, 3.0],)], "v array<double>").select(image.normalised(F.col("v")).alias("n")).collect()
    assert [r.n for r in flat] == [[0.0, 0.0], [0.0, 1.0]]
    assert image.resized(np.full((5, 7), 9.0), 3, 2) == pytest.approx(9.0)


def test_csv_and_json_rejects(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\nnope,y\n3,z\n")
    good, bad = io.read_csv_checked(spark, str(tmp_path / "x.csv"), T.StructType.fromDDL("a int, b string"))
    assert good.count() == 2 and [r.text for r in bad.collect()] == ["nope,y"]
    df = frame(spark, [(1, '{"k": 1}'), (2, '[{"k": 2}, {"k": 3}]'), (3, "[]"), (4, ""), (5, "7"), (6, None)], "id int, j string")
    good, bad = io.parse_json(df, "j", "k:int")
    assert sorted((r.id, r.k) for r in good.collect()) == [(1, 1), (2, 2), (2, 3)]
    assert sorted(r.id for r in bad.collect()) == [3, 4, 5, 6]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = T.StructType.fromDDL("ID string, V double")
    frame(spark, [("a", 1.0), (None, 2.0)], "ID string, V double").write.json(src)
    s = lambda: incoming.incoming(spark, src, schema, {"ID": "id", "V": "value"}, "id")
    incoming.run_now(s(), out, check)
    incoming.run_now(s(), out, check)
    assert spark.read.parquet(out).count() == 2
    frame(spark, [("b", 3.0)], "ID string, V double").write.mode("append").json(src)
    incoming.run_now(s(), out, check)
    got = {r.value: r.id for r in spark.read.parquet(out).collect()}
    assert got[1.0] == "a" and got[3.0] == "b" and len(got[2.0]) == 12


def test_registry_and_remaining(spark, tmp_path):
    runs = frame(spark, [("m", 1, [1, 2])], "method string, extra int, config array<int>")
    fields = ["time", "method", "config", "note"]
    io.append_registry(runs, str(tmp_path / "r"), fields)
    r = io.append_registry(runs, str(tmp_path / "r"), fields).collect()
    assert len(r) == 2 and r[0].config == "[1,2]" and r[0].note is None
    todo = frame(spark, [("m",), ("n",)], "method string")
    assert [x.method for x in io.remaining(todo, runs, ["method"]).collect()] == ["n"]
    assert io.evaluate_once(runs, todo, ["method"], force=True).count() == 2


def test_entry_has_twins_for_real_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 19
    assert math.isclose(entry.entry(spark).agg(F.max("f1")).first()[0], entry.entry(spark).filter("best").first().f1)


def test_images_become_objects_a_few_at_a_time(spark, monkeypatch):
    from cohortlens.operators import image

    rows = [(str(i), 4, 4, bytes(range(i % 200, i % 200 + 16))) for i in range(1000)]
    df = spark.createDataFrame(rows, image.PIXELS).coalesce(1)

    def sizes(frames):
        for f in frames:
            yield f.assign(height=len(f))

    got = image.by_pieces(df, sizes, image.PIXELS).collect()
    assert [(r.id, r.width, bytes(r.data)) for r in got] == [(r[0], 4, r[3]) for r in rows]
    assert max(r.height for r in got) == image.PIECE < 1000
    assert image.by_pieces(df.filter("false"), sizes, image.PIXELS).count() == 0
