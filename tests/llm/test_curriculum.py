import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollbook.llm import curriculum


def filled(sizes, total, most):
    """By the contract's own steps: share by weight, stop at the most, share the excess again."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(keys)}
    target, left = dict.fromkeys(keys, 0.0), total
    while left > 1e-9:
        room = [s for s in keys if target[s] < most * sizes[s] - 1e-9]
        if not room:
            break
        whole, given = sum(weight[s] for s in room), 0.0
        for s in room:
            more = min(left * weight[s] / whole, most * sizes[s] - target[s])
            target[s] += more
            given += more
        left -= given
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


ROWS = [(i, " ".join(["w"] * (1 + i * 7 % 40)), s) for i, s in enumerate(["a"] * 60 + ["b"] * 5 + ["c"] * 30 + ["d", "é", None, None, "d"])]
ROWS += [(200, None, "a"), (201, "", "a"), (202, " \t\n", "b"), (203, "x y \x0b z", "c"), (5, "again w", "a"), (5, "again w", "a"), (None, "no id here", "a"), (300, "long " * 3000, "c"), (301, None, "only nulls")]
SCHEMA = "doc_id long, text string, source string, size string, key int, place int, position double, `a.b` int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1, 2, 0.5, 3) for r in rows], SCHEMA).repartition(parts)


def test_targets_and_whole_documents(spark):
    got = curriculum.mix(frame(spark, ROWS)).collect()
    first = [r for r in got if r.repeat == 0]
    assert sorted((str(r.doc_id), r["size"]) for r in first) == sorted((str(i), words(t)) for i, t, _ in ROWS)
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += words(t)
    want = filled(sizes, 1.5 * sum(sizes.values()), 2)
    source = {i: s for i, _, s in ROWS}
    taken, times = defaultdict(int), defaultdict(list)
    for r in first:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-9
    assert sum(r.words for r in got) == sum(taken.values())
    # position by position: what a source has given so far is the integral of its density
    whole = sum(want.values())
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    at = {s: (i + 0.5) / len(keys) for i, s in enumerate(keys)}
    mean = sum(want[s] * at[s] for s in keys) / whole
    for s in keys:
        lean, given = mean - at[s], 0
        mine = sorted((r for r in got if r.words and source[r.doc_id] == s), key=lambda r: r.position)
        for r in mine:
            t = r.position
            assert 0 <= t <= 1 and math.isclose(want[s] * ((1 + lean) * t - lean * t * t), given, abs_tol=1e-5 * max(1, want[s]))
            given += r.words
    order = [r.position for r in got if r.position is not None]
    assert order == sorted(order)
    assert all((r.position is None) == (r.words == 0) for r in got)


def test_reruns_agree_and_empty_tables(spark):
    rows = lambda parts: sorted(map(str, curriculum.mix(frame(spark, ROWS, parts)).collect()))
    assert rows(1) == rows(7)
    assert curriculum.mix(frame(spark, ROWS).limit(0)).count() == 0
    nothing = curriculum.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r.target, r.taken, r.position) for r in nothing] == [(0, 0.0, 0, None)] * 2
    one = curriculum.mix(frame(spark, [(1, "a b c", None)])).collect()
    assert sorted((r.repeat, r.words, r.taken) for r in one) == [(0, 3, 5), (1, 2, 5)]  # 4.5 words, half rounded up


def test_a_schedule_of_one_s_own(spark):
    """A source that is asked for in the second half alone has no document before it."""
    def late(planned):
        knots = lambda *p: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x).alias("share")) for t, x in p])
        return planned.withColumn("knots", F.when(F.col("place") == 1, knots((0.0, 0.0), (0.5, 0.0), (1.0, 2.0))).otherwise(knots((0.0, 1.0), (0.5, 1.0), (1.0, 0.0))))

    rows = [(i, "w " * 9, "ab"[i % 2]) for i in range(80)]
    got = [r for r in curriculum.mix(frame(spark, rows), schedule=late).collect() if r.words]
    b = [r.position for r in got if r.doc_id % 2]
    assert min(b) == pytest.approx(0.5) and max(b) < 1 and 0 in [r.position for r in got if r.doc_id % 2 == 0]
    assert sorted(b) == pytest.approx([0.5 + 0.5 * math.sqrt(i / (sum(r.words for r in got if r.doc_id % 2) / 9)) for i in range(len(b))], abs=1e-3)
