"""Hard negatives, packing and the filter audit against brute force, on nulls, ties, repeats, long texts, clashing names and empty tables."""

import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import common, filter_audit, hard_negatives, packing, secret_scan, sharding, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def mined(rows, n_pos=5, n_neg=5):
    """Brute force over (id, label, integers)."""
    out = []
    for a, la, qa in rows:
        if a % 100:
            continue
        s = sorted(((-sum(x * y for x, y in zip(qa, q, strict=False)), i, la == lab) for i, lab, q in rows if i != a))
        for p, pid, same in [x for x in s if x[2]][:n_pos]:
            near = [(n, i) for n, i, same in s if not same and 80 * -p <= 100 * -n <= 100 * -p][:n_neg]
            out += [(a, pid, r + 1, i, -p, -n) for r, (n, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "size", "blocks"), [(64, 0.2, (4096, 4096)), (13, 0.4, (7, 2)), (3, 5e4, (50, 3))])
def test_hard_negatives(spark, monkeypatch, dims, size, blocks):
    monkeypatch.setattr(hard_negatives, "BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[1])
    r = np.random.default_rng(dims)
    base = r.normal(0, size, (30, dims)).astype(np.float32)
    v = base[r.integers(0, 30, 400)] + r.normal(0, size / 9, (400, dims)).astype(np.float32)
    v[50:120] = v[50]  # one vector that many rows share
    labels = r.integers(0, 4, 400)
    labels[:200] = 3  # one label of half the rows
    rows = [(i * 5, v[i].tolist(), int(labels[i])) for i in range(400)]
    odd = [(None, v[0].tolist(), 1), (7001, None, 1), (7002, v[0].tolist(), None), (7003, [None] * dims, 1), (7004, [math.nan] * dims, 1), (7005, [math.inf] + [0.0] * (dims - 1), 1), (7006, [], 2), (100, v[20].tolist(), int(labels[20])), (100, v[20].tolist(), int(labels[20]))]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumns({"q": F.lit(1), "anchor": F.lit("x"), "i": F.lit(2)}).repartition(5)
    whole = [(i, lab, [math.floor(256 * x) for x in e]) for i, e, lab in rows] + [(7006, 2, [])]
    assert max(abs(x) for _, _, q in whole for x in q) < hard_negatives.MOST
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    assert got == mined(whole) and len(got) > 100
    shifted = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, q) for i, lab, q in whole]
    assert sorted(tuple(x) for x in hard_negatives.op11(spark, df).collect()) == mined(shifted)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.op11(spark, none).count() == 0
    alone = spark.createDataFrame([(100, [0.5], 1), (101, [0.5], 2)], none.schema)  # an anchor without a positive
    assert hard_negatives.op11(spark, alone).count() == 0


def test_scores_by_subset_sums():
    r = np.random.default_rng(1)
    for dims, most in ((1, 3), (8, 1 << 20), (17, 300), (64, 256)):
        a, b = r.integers(-most, most + 1, (70, dims)), r.integers(-most, most + 1, (600, dims))
        got = hard_negatives.scores(hard_negatives.subset_sums(a, np.int64), hard_negatives.planes(b, most.bit_length() + 1))
        assert (got == b @ a.T).all()


def test_ids_are_the_tokenizers(spark):
    t, code = Tokenizer.from_file(PATH), packing.Coder(PATH)
    assert code.ranked
    r, letters = random.Random(3), [*" \n\t\r\x0b\x1c\x85 　 ​'sre.,$19aéÄ漢😀\x01\x00²½٣_-ɐꟊ𐞀", "  ", "\n\n", "'ll", "'s", " \n", "word", "<|endoftext|>"]
    for _ in range(20_000):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(code(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def check_packing(rows, texts, capacity):
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        at = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
            want[i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == want
    by = defaultdict(list)
    for x in rows:
        by[x.sequence_id].append((x.offset, x.length))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces[:-1], pieces[1:], strict=True)) and sum(n for _, n in pieces) <= capacity
    return len(by), -(-sum(x.length for x in rows) // capacity)


def test_packing(spark):
    r = random.Random(8)
    texts = [(i, " ".join(r.choice(["word", "été", "longer.", "x1", "漢字"]) for _ in range(int(r.lognormvariate(4, 1.2))))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, "a <|endoftext|> b"), (303, "long " * 5000), (304, "\n\n\n \t x"), (5, "another text of an id"), (None, "no id"), *[(400, "same text")] * 50]
    df = spark.createDataFrame([(i, t, 1, "o", 2) for i, t in texts], "doc_id long, text string, piece int, offset string, length int").repartition(7)
    rows = packing.op12(spark, df).collect()
    n, least = check_packing(rows, texts, 1024)
    assert n <= least + 2
    whole = packing.packed(df, PATH, capacity=64)
    n, least = check_packing(whole.withColumn("ids_crc32", F.crc32("ids")).collect(), texts, 64)
    assert n <= 1.01 * least + 2
    seq = packing.sequences(whole).collect()
    assert len(seq) == n and all(len(x.ids) <= 256 for x in seq) and sum(len(x.ids) for x in seq) == 4 * whole.agg(F.sum("length")).first()[0]
    assert packing.op12(spark, df.limit(0)).count() == 0
    odd = packing.placed(spark.createDataFrame([(3, "a", 1.0)], "length long, part string, nth double"), 8).first()
    assert (odd.part, odd.nth, odd.offset) == ("a", 1.0, 0)


def test_patterns_fill_sequences_and_repeats_fit():
    table = packing.patterns(np.arange(1, 33), 32)
    assert Counter(tuple(x) for x in table) == Counter({tuple(sorted((a, b, 32 - a - b), reverse=True)): 1 for a in range(33) for b in range(33 - a) if a <= b <= 32 - a - b})
    counts = np.zeros(33, np.int64)
    counts[[20, 12, 16, 10, 6]] = 500, 500, 300, 200, 200  # 20 + 12, 16 + 16, 16 + 10 + 6: no sequence need be short
    fitted = packing.repeats(packing.patterns(np.flatnonzero(counts), 32), counts)
    used = np.bincount(packing.patterns(np.flatnonzero(counts), 32).ravel(), np.repeat(fitted, 3), 33)
    assert np.abs(used[1:] - counts[1:]).max() < 5
    r = np.random.default_rng(0)
    for middle in (10, 80, 400):
        counts = np.bincount(np.clip(r.lognormal(np.log(middle), 1, 3000).astype(int), 1, 1024), minlength=1025)
        found, held = packing.plan(counts), np.zeros(1025, np.int64)
        for lengths, times in found:
            assert sum(lengths) <= 1024 and times > 0
            np.add.at(held, lengths, times)
        assert (held == counts).all()
        least = max(-(-(counts * np.arange(1025)).sum() // 1024), counts[513:].sum())
        assert sum(k for _, k in found) <= 1.02 * least + 1


def failing(text, copy):
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text).split(" ") if w]
    return "".join(f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), copy), strict=True) if x)


def audited(rows, labels):
    """Brute force over (doc_id, text, lang)."""
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = [(lang or "", failing(t or "", i is not None and i > least[t or ""]), i in good, i in toxic) for i, t, lang in rows]
    out = {}
    for part in {d[0] for d in docs}:
        shapley, steps = Counter(), {}
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            every = list(left)
            for s, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                steps[order, s] = (len(kept), len(gone), sum(f in d[1] for d in every) - len(gone), sum(d[1] == f for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[f] += len(gone)
                left = kept
        out |= {(part, o, s): (*v, shapley[o[s - 1]]) for (o, s), v in steps.items()}
    return out


@pytest.mark.parametrize("part_bytes", [16 << 20, 600])
def test_filter_audit(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(filter_audit, "PART", part_bytes)
    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "bb", "Ccc", "dé", "e|", "漢", f"n{r.randint(0, 400)}"]) for _ in range(r.choice([0, 3, 150, 260]))) for _ in range(80)]
    texts += [None, "", "same start of a text " * 20 + "A", "same start of a text " * 20 + "B", "same start of a text " * 20, "a b c " * 100, "ÄÖÜ " * 300, "\t\n ", "x" * 100_000]
    rows = [(i, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts)] + [(200 + i, texts[i % 89], "en") for i in range(120)]
    rows += [(3, texts[3], "en"), (3, texts[3], "de"), (None, texts[5], "en"), (None, texts[5], "fr"), (None, None, None), (7, texts[9], "en")] + [(1000 + i, "hot text of many copies", "en") for i in range(150)]
    r.shuffle(rows)
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    df = spark.createDataFrame([(i, t, p, 1, 2, "x") for i, t, p in rows], "doc_id long, text string, lang string, mask int, n int, part string").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masks = filter_audit.masks(df, part_bytes=part_bytes)
    got = masks.groupBy("part", "mask").agg(F.sum("n")).collect()
    assert sum(x[2] for x in got) == len(rows)
    found = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in filter_audit.op13(spark, df, marks).collect()}
    assert found == audited(rows, labels)
    assert filter_audit.op13(spark, df.limit(0), marks).count() == 0


def test_tries_hold_whole_texts(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 14))).encode() for _ in range(3000)]
    trie, seen = filter_audit.Trie(), Counter(texts)
    for t in texts:
        node = trie.at(t)
        node[1] = (node[1] or 0) + 1
    assert dict(trie.terminals()) == seen


def test_copies_of_one_text_are_dealt_out(spark, monkeypatch):
    """Groups over a part, of one text and of texts with one start, and tries that are emptied on the way."""
    monkeypatch.setattr(filter_audit, "HELD", 3000)
    long = "one beginning for all of these " * 6
    rows = [(i, "the hot text", "en") for i in range(300)] + [(1000 + i, f"{long}{i % 40}", "en") for i in range(120)] + [(2000 + i, f"t{i}", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    monkeypatch.setattr(filter_audit.inserted, "__defaults__", (3000,))
    n = Counter()
    for x in filter_audit.masks(df, part_bytes=500).collect():
        n[x.part, x.mask & filter_audit.COPY > 0] += x.n
    assert n == {("en", True): 299 + 80, ("en", False): 41, ("de", False): 50}


def test_shards_do_not_follow_from_the_session(spark):
    """Other numbers of shuffle partitions: the same shards and slots."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    earlier, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 8, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got += [{r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(rows, 5, bucket_bytes=b).collect()} for b in (4 << 20, 4096)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", earlier)
    assert got[0] == got[2] == got[4] and got[1] == got[3] == got[5]


def test_files_of_shards_and_archives_are_released(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    before = len(common.written(spark))
    assert sharding.op1(spark, docs).count() == warc.op4(spark, pages).count() == 1
    mine = common.written(spark)[before:]
    assert any("shards" in p for p in mine) and all(os.path.exists(p.removeprefix("file://")) for p in mine if "shards" in p)
    common.release(spark, mine)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in mine) and len(common.written(spark)) == before


def test_many_secrets_in_one_long_text():
    """Places in code points are looked up in one count, so 80,000 secrets of a text take seconds."""
    text = "é token=abcdef123456 " * 80_000
    spans = secret_scan.find(text.encode(), secret_scan.prefilter())
    began = time.perf_counter()
    told = secret_scan.in_code_points(text.encode(), spans)
    assert len(told) == 80_000 and time.perf_counter() - began < 5
    assert told[-1] == {"kind": "assign", "start": 21 * 79_999 + 2, "end": 21 * 79_999 + 20} and text[told[-1]["start"] : told[-1]["end"]] == "token=abcdef123456"
