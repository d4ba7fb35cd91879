"""Hard negatives: exact packed products, and the operator against brute force."""

import math
import random

import numpy as np
import pytest
from parapet.llm import negatives
from parapet.llm.kronecker import Packed
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<double>, row string, score string, d string, v string, positives string, a string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in rows], SCHEMA)


def whole(x):
    return int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256)


def brute(rows, step=100, k=5, n=10):
    good = []
    for i, (key, label, x) in enumerate(rows):
        if key is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        good.append((i, key, (label + 1) % 10 if key % 7 == 0 else label, [whole(c) for c in x]))
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1)
    out = []
    for i, key, label, v in good:
        if key % step:
            continue
        met = [(-dot(v, w), other, j, tag) for j, other, tag, w in good if j != i and len(w) == len(v)]
        for ps, pid, _, _ in sorted(m for m in met if m[3] == label)[:k]:
            found = sorted((ns, nid) for ns, nid, _, tag in met if tag != label and 30 * -ps <= 100 * -ns <= 90 * -ps)[:n]
            out += [(key, pid, rank, nid, -ps, -ns) for rank, (ns, nid) in enumerate(found, 1)]
    return sorted(out)


def got(spark, rows, step=100):
    out = negatives.mine(table(spark, rows), F.col("vec_id") % step == 0, label=negatives.moved_label())
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("bits", [3, 9, 14, 26, 30, 45, 70, 200])
def test_products(bits):
    """Fields of 32, 64 and more bits give the plain products; scores beyond a long are cut."""
    rng = random.Random(bits)
    draw = lambda: rng.choice([0, 1, -1, 1 << bits, -(1 << bits), rng.randint(-(1 << bits), 1 << bits)])
    for n, d in ((1, 1), (5, 3), (40, 17)):
        rows = [[draw() for _ in range(d)] for _ in range(n)]
        vector = [draw() for _ in range(d)]
        kind = object if bits > 40 else np.int64
        packed = Packed(np.array(rows, kind), sum(map(abs, vector)))
        want = [min(max(sum(a * b for a, b in zip(r, vector)), -(1 << 63)), (1 << 63) - 1) for r in rows]
        assert packed.products(vector).tolist() == want


def test_widths():
    assert [Packed(np.array([[m]]), 1).width for m in (1, (1 << 31) - 1, 1 << 31, 1 << 62)] == [32, 32, 64, 64]
    assert Packed(np.array([[-5], [7]]), 3).bias == 5


def test_best():
    scores = np.array([3, -(1 << 63), 9, 3, 9, (1 << 63) - 1])
    assert negatives.best(scores, 4).tolist() == [5, 2, 4, 0] and negatives.best(scores, 99).tolist() == [5, 2, 4, 0, 3, 1]


@pytest.mark.parametrize("cells", [None, 64])
def test_brute_force(spark, monkeypatch, cells):
    """Whole tiles, and tiles of a few rows with most rows in one label."""
    if cells:
        monkeypatch.setattr(negatives, "ANCHOR_CELLS", cells)
        monkeypatch.setattr(negatives, "CANDIDATE_CELLS", 4 * cells)
    rng = random.Random(9)
    rows = [(i, 3 if rng.random() < 0.6 else rng.randrange(10), [rng.gauss(0.1, 0.3) for _ in range(8)]) for i in range(400)]
    want = brute(rows, 20)
    assert got(spark, rows, 20) == want and len(want) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100 * i, i % 3, [0.5, 0.25 * i]) for i in range(6)] + [(7 * i + 1, i % 4, [0.3, 0.2 * (i % 5)]) for i in range(40)]
    rows += [(100, 1, [0.5, 0.25]), (100, 1, [0.5, 0.25]), (100, 2, [1.0, 0.0]), (-100, 1, [0.4, 0.4]), (9, 1, [0.5, 0.25]), (9, 1, [0.5, 0.25])]
    rows += [(None, 1, [1.0, 1.0]), (200, None, [1.0, 1.0]), (300, 1, None), (300, 1, [nan, 1.0]), (300, 1, [1.0, inf]), (300, 1, [None, 1.0])]
    rows += [(400, 1, []), (2, 1, []), (3, 2, []), (500, 1, [1.0]), (500, 1, [0.0, 0.0]), (600, 2, [-1.0, -1.0])]
    random.Random(1).shuffle(rows)
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


@pytest.mark.parametrize("size", [100.0, 1e5, 1e9, 1e30, 1e307])
def test_large_components(spark, size):
    rng = random.Random(4)
    rows = [(i * 10, i % 3, [rng.uniform(-1, 1) * size, rng.uniform(0, 1) * size]) for i in range(60)]
    assert got(spark, rows) == brute(rows)
