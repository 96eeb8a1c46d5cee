"""Long texts and hot anchors: the same results, at a cost in proportion."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, pii


def told(items, texts):
    a = decontamination.automaton(items, 10)
    return [(n, None if hit is None else hit.tolist(), names) for n, hit, names in (decontamination.scan(t, a) for t in texts)]


def brute(items, text):
    w, hit, names = decontamination.words(text), set(), set()
    for name, t in items:
        v = decontamination.words(t)
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(w), [i in hit for i in range(len(w))] if hit else None, names


@pytest.mark.parametrize("few", [0, 2, 10**9])
def test_windows_of_anchors_that_many_items_share(monkeypatch, few):
    monkeypatch.setattr(decontamination, "FEW", few)
    g = random.Random(few)
    for _ in range(30):
        vocabulary = ["a", "b", "what", "é"][: g.randint(1, 4)]
        draw = lambda n: " ".join(g.choice(vocabulary) for _ in range(n)).encode()
        items = [(str(i), draw(g.choice([0, 3, 5, 9, 10, 11, 17, 30]))) for i in range(12)]
        texts = [draw(g.choice([0, 4, 9, 10, 40, 80])) for _ in range(6)] + [b"x " + t + b", y" for _, t in items]
        assert told(items, texts) == [brute(items, t) for t in texts]


def test_cost_of_a_template_does_not_grow_with_its_items():
    took = []
    for n in (2000, 16000):
        items = [(str(i), f"what is the name of the river {i} that flows past town number {i}".encode()) for i in range(n)]
        a = decontamination.automaton(items, 10)
        text = " ".join(f"what is the name of the river {i} that flows" for i in range(2000)).encode()
        began = time.perf_counter()
        k, hit, names = decontamination.scan(text, a)
        took.append(time.perf_counter() - began)
        assert hit is not None and len(names) == 2000
    assert took[1] < 3 * took[0] + 0.2


@pytest.mark.parametrize("most", [False, True])
def test_sums_before(spark, most):
    g = random.Random(1)
    rows = [(n, [g.randint(0, 9) for _ in range(n)]) for n in (0, 1, 2, 127, 128, 129, 256, 257, 1000)]
    for n, got, v in ((r.n, r.b, dict(rows)[r.n]) for r in spark.createDataFrame(rows, "n int, v array<int>").select("n", pii.before(F.col("v"), most).alias("b")).collect()):
        assert got == [(max if most else sum)([0, *v[:i]]) for i in range(n)]


def test_places_in_chunks(spark):
    g = random.Random(2)
    t = "".join(g.choice("ab\n\r é😀") for _ in range(5000))
    rows = [(t, a, b) for a, b in [(0, 0), (0, 5), (1023, 1025), (1024, 1024), (1024, 2048), (100, 4900), (4990, 5100), (5000, 5061), (0, 5000)]]
    for r in spark.createDataFrame(rows, "t string, a int, b int").select("a", "b", pii.cut_from(pii.chunks(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == t[r.a : r.b]


def test_many_addresses_in_one_text(spark):
    took = []
    for n in (5000, 10_000, 20_000):
        text = " ".join(f"é😀 mail{i}@example.org or 10.0.{i % 300}.1;" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        r = pii.sanitised(pii.personal_data(df)).first()
        took.append(time.perf_counter() - began)
        want = sorted([(m.start(), m.end()) for m in re.finditer(r"mail\d+@example\.org", text)] + [(m.start(), m.end()) for m in re.finditer(r"10\.0\.(\d+)\.1", text) if int(m[1]) < 256])
        assert [(s.start, s.end) for s in r.base] == want
        kept, at = [], 0
        for a, b in want:
            kept += [text[at:a], "<email>" if text[a] == "m" else "<ip>"]
            at = b
        assert r.text == "".join(kept) + text[at:]
    print(took)
    assert took[2] < 3 * took[1]
