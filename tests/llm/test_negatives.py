"""Hard negatives against a sort of all rows by score."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import negatives


def by_hand(rows, is_anchor):
    clean = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        clean.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, label, v in clean:
        if not is_anchor(a):
            continue
        others = sorted(((-dot(v, w), i, m) for i, m, w in clean if i != a))
        for s, p, m in [o for o in others if o[2] == label][:5]:
            hard = [o for o in others if o[2] != label and -50 * s <= -100 * o[0] <= -95 * s][:3]
            out += [(a, p, k + 1, o[1], -s, -o[0]) for k, o in enumerate(hard)]
    return sorted(out)


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 2
    return [(int(i), int(rng.integers(0, 4)), [float(x) for x in centres[rng.integers(0, 6)] + rng.normal(size=d) * rng.choice([0.2, 1.0])]) for i in rng.permutation(n)]


def mined(spark, rows, every):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, score int").repartition(4)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0).collect()))


def test_equal_to_sorting_all_rows(spark, monkeypatch):
    for name, value in (("GROUP", 16), ("BLOCK", 64), ("DEALT", 150), ("PER_PIVOT", 4)):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(500, 6, 1)
    rows += [(1000 + k, 1 + k % 2, [0.5] * 6) for k in range(120)]  # one vector, many times, of two labels
    rows += [(2000, None, [1.0] * 6), (2001, 1, None), (2002, 1, [1.0, None] + [0.0] * 4), (2003, 1, [float("nan")] * 6), (2004, 1, [float("inf")] * 6), (2005, 2, [1.5, 2.0]), (2006, 2, []), (2010, 2, [0.0] * 6)]
    assert mined(spark, rows, 10) == by_hand(rows, lambda a: a % 10 == 0)


def test_rings_are_left_out_where_vectors_have_structure(spark, monkeypatch):
    rows = [(k, k % 8 // 2, [float(10 * (c == k % 8)) + random.Random(k).random() for c in range(8)]) for k in range(640)]
    asked = []
    monkeypatch.setattr(negatives.Space, "asked", lambda self, x, low, high, real=negatives.Space.asked: asked.append(1) or real(self, x, low, high))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    space = negatives.space_of(negatives.quantised(df), F.col("vec_id") % 20 == 0)
    x = space.matrix([[256.0 * v for v in r[2]] for r in rows])
    cell, ring = space.place(x)
    space.rings = np.unique(ring)
    scores = x[:1] @ x.T
    low = np.sort(scores[0])[-20]
    need = space.asked(x[:1], np.array([low]), np.array([np.inf]))
    assert set(ring[scores[0] >= low]) <= set(need) and len(need) < len(space.rings)


@pytest.mark.parametrize("rows", [[], [(50, 1, [1.0])], [(50, 1, [1.0]), (51, 2, [0.7])], [(50, 1, [3e6, 1.0]), (100, 1, [3e6, 2.0]), (51, 2, [2.5e6, 1.0]), (52, 2, [2.5e6, 1.0])]])
def test_few_rows_and_large_numbers(spark, rows):
    assert mined(spark, rows, 50) == by_hand(rows, lambda a: a % 50 == 0)


def test_products_beyond_64_bits_end_the_job(spark):
    with pytest.raises(Exception, match="too large|overflow|convert"):
        mined(spark, [(50, 1, [1e12]), (100, 1, [1e12])], 50)
