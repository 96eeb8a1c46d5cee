"""Searches through the metric index and assignments by auction, against brute force."""

import time
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import auction, metric_index, similarity


def frame(spark, v, *more, schema="k int"):
    rows = [(i, [float(x) for x in v[i]], *(m[i] for m in more)) for i in range(len(v))]
    return spark.createDataFrame(rows, f"id long, v array<double>{', ' + schema if more else ''}").repartition(3)


def clustered(n=400, dims=8, groups=20, seed=0):
    g = np.random.default_rng(seed)
    c = g.normal(size=(groups, dims))
    return c[g.integers(0, groups, n)] + g.normal(scale=0.05, size=(n, dims))


def angles(v):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return (u @ u.T).round(12)


@pytest.fixture(params=[7, 1024])
def block(request, monkeypatch):
    monkeypatch.setattr(metric_index, "BLOCK", request.param)


def test_similar_pairs(spark, block):
    v = clustered()
    v[50:90] = v[50] * 2  # many equal rows
    v[9] = 0
    s = angles(v)
    got = similarity.similar_pairs(frame(spark, v), "id", "v", 0.6).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= 0.6}
    assert all(abs(r.sim - s[r.a, r.b]) < 1e-9 for r in got)
    assert similarity.similar_pairs(frame(spark, v).filter("false"), "id", "v", 0.6).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l1", "l2"])
@pytest.mark.parametrize("k", [1, 3, 12])
def test_nearest(spark, metric, k):
    v = clustered(300, seed=k)
    v[50:90] = v[50]
    s = angles(v) if metric == "cosine" else -np.stack([np.linalg.norm(v - x, ord=1 if metric == "l1" else 2, axis=1) for x in v]).round(12)
    df = frame(spark, v)
    got = similarity.nearest(df.filter("id % 3 = 0"), df, "id", "v", k, metric).collect()
    want = {i: sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:k] for i in range(0, 300, 3)}
    for i in want:
        mine = sorted((r.rank, r.other, r.sim) for r in got if r.id == i)
        assert [r[0] for r in mine] == list(range(1, k + 1))
        assert np.allclose([r[2] for r in mine], [s[i, j] for j in want[i]], atol=1e-9)
        if metric == "cosine":
            assert [r[1] for r in mine] == want[i]


def test_few_rows_and_rows_without_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0])], "id long, v array<double>")
    got = similarity.nearest(df, df, "id", "v", 5).collect()
    assert sorted((r.id, r.other) for r in got) == [(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2)]
    assert similarity.nearest(df, df.filter("false"), "id", "v", 5).count() == 0
    with pytest.raises(ValueError):
        similarity.nearest(df, df, "id", "v", 5, "other")


def test_bounds_leave_most_cells_shut(spark):
    """Clustered rows: under a tenth of the pairs of a row and a cell are opened, by a threshold as for the nearest."""
    v = clustered(3000, 16, 60)
    df = frame(spark, v)
    index = metric_index.build(df, "id", "v")
    rows = index.rows.select("id", "v")
    every = 3000 * len(index.centres)
    assert index.count.sum() == 3000 and len(index.centres) >= 40
    assert 0 < metric_index.opened(metric_index.visits(rows, index, float(np.arccos(0.95)))) < every / 10
    near = similarity.nearest(df, df, "id", "v", 3).groupBy("id").agg(F.min("sim").alias("sim")).select("id", F.acos("sim").alias("reach"))
    assert 0 < metric_index.opened(metric_index.visits(rows.join(near, "id"), index, "reach")) < every / 10


def test_group_match(spark, block):
    v, g = clustered(200, 6, 12, 5), np.random.default_rng(1)
    klass, grp = g.integers(0, 3, 200).tolist(), g.integers(0, 9, 200).tolist()
    klass[7] = None
    df = frame(spark, v, klass, grp, schema="k int, g int")
    s = angles(v)
    got = {r.id: r for r in similarity.group_match(df, df, "id", "v", "k", "g", around=8).collect()}
    for i in range(200):
        best = {}
        for j in range(200):
            if j != i and klass[j] is not None and klass[i] == klass[j]:
                best[grp[j]] = max(best.get(grp[j], (-2, 0)), (s[i, j], -j))
        order = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))
        if klass[i] is None:
            assert i not in got
            continue
        assert (got[i].grp, got[i].nearest) == (order[0][0], -order[0][1][1])
        assert got[i].margin == pytest.approx(order[0][1][0] - (order[1][1][0] if len(order) > 1 else 0))


def test_mutual_nearest(spark, block):
    g = np.random.default_rng(4)
    v = g.normal(size=(60, 6))
    v[40:44] = v[10]
    s = angles(v)
    df = frame(spark, v, [i // 2 % 3 for i in range(60)])
    near = lambda i: min((j for j in range(60) if j % 2 != i % 2 and j // 2 % 3 == i // 2 % 3), key=lambda j: (-s[i, j], j))
    got = similarity.mutual_nearest(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), "id", "v", "k")
    assert sorted((r.a, r.b) for r in got.collect()) == [(i, near(i)) for i in range(0, 60, 2) if near(near(i)) == i]


def best_sum(cost, alone):
    """The best sum over all assignments, each row alone or with a partner, by trying all."""
    n, m = cost.shape
    padded = np.full((n, m + n), 0.0)
    padded[:, :m] = np.maximum(cost - alone, 0)
    return max(sum(padded[i, p[i]] for i in range(n)) for p in permutations(range(m + n), n)) if n else 0


@pytest.mark.parametrize("bidders", [2, 4096])
def test_auction_is_best_by_brute_force_and_by_its_prices(spark, monkeypatch, bidders):
    monkeypatch.setattr(auction, "BIDDERS", bidders)
    g = np.random.default_rng(bidders)
    cost = g.uniform(-1.5, 1, (4, 4)).round(3)
    cost[:, 0] += 1  # all want the same
    edges = spark.createDataFrame([(i, 10 + j, float(cost[i, j])) for i in range(4) for j in range(4)] + [(None, 10, 5.0), (0, 10, -9.0)], "a long, b long, score double")
    pairs, prices = auction.auction(edges)
    got = pairs.collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    assert sum(r.score + 1 for r in got) == pytest.approx(best_sum(cost, -1), abs=4e-4)
    assert -1e-9 <= auction.gap(edges.filter("a is not null"), prices, pairs) <= 4e-4
    assert auction.auction(edges.filter("false"))[0].count() == 0


def test_auction_of_many_in_rounds(spark, monkeypatch):
    """Bidders in several tasks, few edges each: the prices prove the sum, in as many rounds as tasks have to hear of each other."""
    monkeypatch.setattr(auction, "BIDDERS", 30)
    g = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b), float(x)) for a in range(60) for b, x in zip(g.choice(50, 5, replace=False), g.random(5), strict=True)], "a long, b long, score double")
    pairs, prices = auction.auction(edges, eps=1e-4)
    assert pairs.count() == pairs.select("a").distinct().count() == pairs.select("b").distinct().count() > 40
    assert -1e-9 <= auction.gap(edges, prices, pairs) <= 60 * 1e-4


def test_planted_assignment_of_a_whole_class(spark):
    """Heads and tails of planted sequences meet wherever their ids are, and the smaller side of each class is used up."""
    g = np.random.default_rng(1)
    heads = g.normal(size=(30, 16))
    order = g.permutation(30)
    tails = heads[order] + g.normal(scale=0.2, size=(30, 16))
    df = frame(spark, np.concatenate([heads, tails]), [i % 2 for i in range(30)] + [int(order[j]) % 2 for j in range(30)])
    for k in (2, 32):
        got = auction.assigned(df.filter("id < 30"), df.filter("id >= 30"), "id", "v", "k", k).collect()
        assert {(r.a, r.b) for r in got} == {(int(order[j]), 30 + j) for j in range(30)}
    near = df.withColumn("v", F.array(*[F.col("v")[i] for i in range(2)]))  # little to tell rows apart by
    got = auction.assigned(near.filter("id < 20"), near.filter("id >= 30"), "id", "v", "k", 2).collect()
    assert len(got) == len({r.a for r in got}) == len({r.b for r in got}) == 20


def test_rows_are_sent_once_for_each_part_of_the_other_side(spark, monkeypatch):
    """All rows open all of 100 cells: what meets in tiles is a few times the rows, not a hundred times, and every pair meets once."""
    monkeypatch.setattr(metric_index, "BLOCK", 16)
    df = frame(spark, np.random.default_rng(0).normal(size=(600, 4)))
    index = metric_index.build(df, "id", "v", n_centres=100)
    come = metric_index.stored(metric_index.visits(index.rows.select("id", "v"), index), "visits")
    assert metric_index.opened(come) == 600 * (index.count > 0).sum() > 600 * 50

    def sizes(x, y, *_):
        return pa.table({"x": [len(x)], "y": [len(y)]})

    r = metric_index.meet(come, index, sizes, "x long, y long").agg(F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("y"))).first()
    assert max(r[0], r[1]) <= 600 * 8 and r[2] == 600 * 600


@pytest.mark.parametrize("metric", ["cosine", "l1", "l2"])
def test_what_single_precision_finds_holds_all_that_count(metric):
    g = np.random.default_rng(2)
    for x, y in [(g.normal(size=(40, 16)), g.normal(size=(50, 16)) + 1e4), (np.zeros((3, 4)), np.ones((5, 4))), (g.normal(size=(4, 4)) * 1e300, g.normal(size=(4, 4)))]:
        if metric == "cosine":
            x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
        with np.errstate(over="ignore"):
            s = metric_index.closeness(x, y, metric)
            least = np.sort(s, axis=1)[:, -2]
            found = set(zip(*metric_index.likely(x, y, metric, least), strict=True))
        assert set(zip(*np.nonzero(s >= least[:, None]), strict=True)) <= found


def test_an_auction_by_blocks_is_one_round(spark, monkeypatch):
    """Blocks that compete for nothing of each other's are settled where their bidders meet, however many blocks there are."""
    monkeypatch.setattr(auction, "BIDDERS", 16)
    g = np.random.default_rng(5)
    rows = [(k, 100 * k + a, 100 * k + b, float(x)) for k in range(6) for a in range(14) for b, x in enumerate(g.random(12))]
    edges = spark.createDataFrame(rows, "klass int, a long, b long, score double")
    rounds, write = [], auction.stored
    monkeypatch.setattr(auction, "stored", lambda d, name: rounds.append(name) or write(d, name))
    pairs, prices = auction.auction(edges, block="klass")
    assert rounds.count("prices") == 1
    assert pairs.count() == 6 * 12 and -1e-9 <= auction.gap(edges, prices, pairs) <= 6 * 14 * 1e-4


@pytest.mark.parametrize("n, m", [(5, 3), (3, 5), (4, 4), (6, 1)])
def test_a_whole_block_is_best_by_brute_force_and_by_its_prices(n, m, monkeypatch):
    """One by one and all at once; where bidders are more than objects, and where objects are."""
    g = np.random.default_rng(10 * n + m)
    for few in (0, 12):
        monkeypatch.setattr(auction, "FEW", few)
        for _ in range(20):
            worth = np.where(g.random((n, m)) < 0.7, g.choice([0.0, 0.5, 0.5001, g.random(), 2.0], (n, m)), np.nan)
            worth[0, 0] = 1.5
            i, j = np.nonzero(~np.isnan(worth))
            owner, thing, price = auction.settled(i + 100, j + 200, worth[i, j], 1e-4)
            owner, thing = owner - 100, thing - 200
            assert len(set(owner)) == len(set(thing)) == len(owner)
            total = worth[owner, thing].sum()
            assert total == pytest.approx(best_sum(np.nan_to_num(worth, nan=-1), 0), abs=1e-4 * len(owner) + 1e-9)
            prices = np.zeros(m)
            prices[thing] = price
            bound = np.maximum(0, np.nanmax(np.c_[np.zeros(n), worth - prices], axis=1)).sum() + prices.sum()
            assert -1e-9 <= bound - total <= 1e-4 * len(owner) + 1e-9


def test_bidders_too_many_go_without_after_few_bids(monkeypatch):
    """60 bidders for 50 objects that are worth the same to all: prices rise to the worth, not in steps of ``eps``; what isn't a finite number is no edge."""
    bids, side = [], auction.Side.bid
    monkeypatch.setattr(auction.Side, "bid", lambda self, price, owner, own, waiting, eps: bids.append(price.sum()) or side(self, price, owner, own, waiting, eps))
    i, j = (x.ravel() for x in np.indices((60, 50)))
    at = time.monotonic()
    owner, thing, price = auction.settled(i, j, np.ones(3000), 1e-7)
    assert len(owner) == len(set(owner)) == len(set(thing)) == 50 and np.abs(price - 1).max() <= 1e-7
    assert len(bids) == 2 * len(list(auction.steps(1.0, 1e-7))) and time.monotonic() - at < 20
    assert list(auction.steps(0.0, 1e-4)) == [1e-4] and list(auction.steps(1e15, 1e-4))[-1] == pytest.approx(1e3)


def test_a_class_of_thousands_is_one_round(spark, monkeypatch):
    """5,000 bidders of one class for 4,900 objects: one task settles them, in one round, and uses up the objects; edges that aren't numbers count for nothing."""
    g = np.random.default_rng(6)
    a, b = np.repeat(np.arange(5000), 8), g.integers(0, 4900, 40_000)
    a, b = np.r_[a, np.arange(4900), 7, 8], np.r_[b, np.arange(4900), 3, 4]
    x = np.r_[g.random(44_900), np.nan, np.inf]
    edges = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "score": x})).withColumn("klass", F.lit(1)).localCheckpoint()
    rounds, write = [], auction.stored
    monkeypatch.setattr(auction, "stored", lambda d, name: rounds.append(name) or write(d, name))
    pairs, prices = auction.auction(edges, block="klass")
    assert rounds.count("prices") == 1 and pairs.count() == pairs.select("b").distinct().count() == 4900
    assert -1e-9 <= auction.gap(edges.filter("score < 2"), prices, pairs) <= 4900 * 1e-4


def test_small_and_large_classes_of_one_auction(spark, monkeypatch):
    """A class that fits a task and one that is dealt to several: both are the best by brute force, and no pair crosses."""
    monkeypatch.setattr(auction, "BIDDERS", 3)
    g = np.random.default_rng(8)
    sizes = {1: (3, 2), 2: (5, 4)}
    worth = {k: g.integers(0, 10, s).astype(float) for k, s in sizes.items()}
    edges = spark.createDataFrame([(k, 10 * k + i, 10 * k + j, float(w[i, j]) - 1) for k, w in worth.items() for i in range(len(w)) for j in range(w.shape[1])], "klass int, a long, b long, score double")
    pairs = auction.auction(edges, eps=0.15, block="klass")[0].collect()
    assert {r.a // 10 - r.b // 10 for r in pairs} == {0}
    assert len({r.a for r in pairs}) == len({r.b for r in pairs}) == len(pairs) == 6
    for k, w in worth.items():  # whole numbers: what is within less than 1 of the best is the best
        assert sum(r.score + 1 for r in pairs if r.a // 10 == k) == pytest.approx(best_sum(w, 0))
