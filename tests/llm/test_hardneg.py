import random

import numpy as np
from pyspark.sql import functions as F

from rollbook.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, ints string, cells int, score int"
NAN, INF = float("nan"), float("inf")


def brute(rows, anchor, cells=None):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(256.0 * float(np.float32(x)))) for x in v]
        if i not in held or (label, ints) < held[i]:
            held[i] = (label, ints)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in filter(anchor, held):
        label, v = held[a]
        scored = sorted((-dot(v, w), i, other == label) for i, (other, w) in held.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fits = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, rank + 1, i, -s, -t) for rank, (t, i, _) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA).repartition(3)
    found = hardneg.hard_negatives(df, anchor=F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect())


def vectors(n, seed=0, d=8):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(i, [x + rng.gauss(0, 0.4) for x in middle[i % 4]], rng.choice([i % 4, 1, 2])) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(1500)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert run(spark, rows) == want
    assert run(spark, rows, cells=2) == want  # bounds as loose as can be


def test_odd_rows(spark):
    common = [1.0] * 8
    rows = vectors(60, 1) + [(100 + i, common, i % 2) for i in range(300)]  # one vector a few hundred times, ties of scores and bounds
    rows += [(20, None, 1), (30, [1.0, None], 1), (31, [NAN, 1.0], 2), (32, [INF, 1.0], 2), (33, [], 1), (None, common, 1), (610, common, None), (40, common, 3), (40, common, 3), (620, [0.5] * 3, 1), (630, [-1.0] * 12, 0)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_tables_with_little_in_them(spark):
    assert run(spark, []) == [] == run(spark, [(10, None, 1)])
    assert run(spark, [(10, [], 1), (11, [], 1), (12, [], 2)]) == brute([(10, [], 1), (11, [], 1), (12, [], 2)], lambda i: i % 10 == 0)
    one = [(10, [1.0, 2.0], 1), (11, [1.0, 2.0], 1), (12, [1.0, 1.99], 2)]
    assert run(spark, one) == brute(one, lambda i: i % 10 == 0) != []
    assert run(spark, [x for x in one if x[0] != 10]) == []
    assert run(spark, [x for x in one if x[2] == 1]) == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v, q = rng.integers(-300, 300, (500, 6)), rng.integers(-300, 300, (20, 6))
    of = hardneg.Cells(v.min(0), v.max(0), 16)
    low, high = of.bounds(((v - of.low) // of.width), q)
    exact = v @ q.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).max() > 0
