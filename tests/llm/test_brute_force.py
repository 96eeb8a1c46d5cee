"""The classifier recomputed in plain Python and NumPy, and the pipeline's stages chained by brute force, on sf0.001."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_operators import brute_components

import corpus_pipeline
from cohortlens.llm import mixing, quality
from cohortlens.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def plain_features(text):
    """Indicator numbers of a text, from the module's description of them."""
    b = (text or "").encode()
    b += b"\0" * (3 - len(b))
    grams = Counter(b[i] | b[i + 1] << 8 | b[i + 2] << 16 for i in range(len(b) - 2))
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    same = sum(x == y for x, y in zip(w, w[1:], strict=False))
    codes = set(grams)
    for k, least in enumerate(quality.FREQUENT):
        codes |= {g + ((k + 1) << 24) for g, n in grams.items() if n / (len(b) - 2) >= least}
    codes |= {(k + 9) << 24 for k, least in enumerate(quality.REPEATED) if same > least * len(w)}
    return sorted({(c * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - quality.BITS) for c in codes})


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))


@pytest.fixture(scope="module")
def told(spark, model):
    """Rows that may be learnt from (id, label, indicators), plain ratios, and plain scores of all documents."""
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = [(i, labels[i], plain_features(docs[i])) for i in sorted(labels.keys() & docs.keys())]
    counts = np.ones((2, quality.DIM))
    for _, y, x in rows:
        counts[int(y == 1), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def score(text):
        x = plain_features(text)
        margin = model["weight"][x] @ ratio[x] / max(1e-9, np.linalg.norm(ratio[x])) + model["bias"]
        return 1 / (1 + np.exp(-(model["slope"] * margin + model["offset"])))

    return rows, ratio, {i: score(t) for i, t in docs.items()}


def test_ratios_and_scores(spark, model, told):
    rows, ratio, scores = told
    assert len({y for _, y, _ in rows}) == 2
    assert np.allclose(model["ratio"], ratio, atol=1e-9)
    got = {r.doc_id: r for r in quality.op3(spark, table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert got.keys() == scores.keys()
    for i, r in got.items():
        assert abs(r.score - scores[i]) < 1e-9 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_weights_are_an_optimum(model, told):
    """The hinge loss with its penalty is within 2 % of the best, found by another descent on the Gram matrix; the sigmoid's slope of loss is zero."""
    rows, ratio, _ = told
    apart = np.array([zlib.crc32(f"fit:{i}".encode()) % 4 == 0 for i, _, _ in rows])
    good = np.array([y == 1 for _, y, _ in rows])
    cost = np.where(good, 1.0, min(4.0, max(1.0, good.sum() / (~good).sum())))[~apart]
    used = sorted({j for _, _, x in rows for j in x})
    at = {j: k for k, j in enumerate(used)}
    v = np.zeros((len(rows), len(used)))
    for k, (_, _, x) in enumerate(rows):
        v[k, [at[j] for j in x]] = ratio[x] / max(1e-9, np.linalg.norm(ratio[x]))
    y, fit = np.where(good, 1.0, -1.0)[~apart], v[~apart]
    gram = (fit @ fit.T + 1) * y[:, None] * y
    alpha = np.zeros(len(y))
    for _ in range(3000):
        for i in range(len(y)):
            alpha[i] = min(max(alpha[i] + (1 - gram[i] @ alpha) / gram[i, i], 0.0), cost[i])
    best = alpha.sum() - 0.5 * alpha @ gram @ alpha  # the dual's value bounds the loss from below
    w, b = model["weight"], model["bias"]
    loss = 0.5 * (w @ w + b * b) + cost @ np.maximum(0, 1 - y * (fit @ w[used] + b))
    assert best - 1e-6 <= loss <= 1.02 * best
    test = apart if len(set(good[apart])) == 2 else ~apart
    margin, want = v[test] @ w[used] + b, np.where(good[test], 1 - 1e-3, 1e-3)
    off = 1 / (1 + np.exp(-(model["slope"] * margin + model["offset"]))) - want
    assert abs(off.sum() + 1e-2 * model["offset"]) < 1e-6
    assert abs(off @ margin + 1e-2 * (model["slope"] - 2)) < 1e-6


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_by_brute_force(spark, told):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: stored(stages[name](spark, df, SF), "stage")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())

    docs = step("quality", docs)
    left = {i for i, s in told[2].items() if s >= 0.3}
    assert ids(docs) == Counter(left)

    docs = step("near_duplicates", docs)
    left = {i for i, _, c in brute_components([(i, rows[i].text) for i in sorted(left)]) if i == c}
    assert ids(docs) == Counter(left)

    docs = step("decontamination", docs)
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    left = {i for i in left if not any(tuple(w[k : k + n]) in windows for w in [words(rows[i].text)] for n in sizes for k in range(len(w) - n + 1))}
    assert ids(docs) == Counter(left)

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    taken = con.execute(f"SELECT doc_id, taken // size FROM ({mixing.ORACLE}) WHERE size > 0").fetchall()
    docs = step("mixing", docs)
    assert Counter({i: n for i, n in ids(docs).items() if rows[i].text.strip()}) == Counter({i: n for i, n in taken if n})

    out = step("sharding", docs)
    got = out.collect()
    names = docs.columns
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(tuple(r[c] for c in names) for r in docs.collect())
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in {r.shard for r in got}}
    assert all(v == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(corpus_pipeline.N_SHARDS))
    full = [len(slots.get(s, [])) for s in range(corpus_pipeline.N_SHARDS)]
    assert max(full) - min(full) <= 1
