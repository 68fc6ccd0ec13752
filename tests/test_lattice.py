import pytest
from pyspark.sql import functions as F

from rollbook.operators import geometry, lattice


def arrays(spark, values, f, kind="array<double>"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.o for r in df.select("i", f(F.col("x")).alias("o")).orderBy("i").collect()]


def test_gaps_are_filled_by_multiples(spark):
    even = [10.0 * i for i in range(8)]
    one = [x for x in even if x != 30.0]
    two = [x for x in even if x not in (30.0, 40.0)]
    off = [0.0, 10.0, 16.2, 30.0, 40.0]  # a centre that stands off, none lost
    assert arrays(spark, [even, one, two, off, [1.0, 2.0, 9.0], [], [5.0] * 5], lattice.filled) == [even, even, two, off, [1.0, 2.0, 9.0], [], [5.0] * 5]
    assert arrays(spark, [two, one], lambda x: lattice.filled(x, most=3)) == [even, even]


def test_uneven_ends_go_and_inner_gaps_stay(spark):
    even = [10.0 * i for i in range(6)]
    inner = [0.0, 10.0, 16.0, 30.0, 40.0, 50.0]
    assert arrays(spark, [[-40.0, *even], [*even, 63.9, 78.0], [-14.0, *even, 90.0], inner, [0.0, 9.0, 30.0]], lattice.trimmed) == [even, even, even, inner, [0.0, 9.0, 30.0]]


def test_core_is_the_longest_run(spark):
    marks = lambda *xs: [(float(x), "m") for x in xs]
    kind = "array<struct<x: double, mark: string>>"
    got = arrays(spark, [marks(1, 40, 50, 60, 70), marks(0, 10, 20, 60, 70, 80), marks(3, 90), marks(4, 4, 4), marks(0, 10, 29, 38, 48)], lattice.core, kind)
    assert [[m.x for m in r] for r in got] == [[40, 50, 60, 70], [0, 10, 20], [3, 90], [4, 4, 4], [0, 10, 29, 38, 48] if 19 <= 1.9 * 10 else []]


def test_letters_stand_where_their_widths_put_them(spark):
    df = spark.createDataFrame([("○ ×○45", 100.0, 45.0), ("○", 7.0, 8.0), ("", 1.0, 1.0), ("𠮷a", 0.0, 15.0)], "s string, x double, w double")
    place = lambda **how: [[(m.x, m.mark) for m in r.o] for r in df.select(lattice.placed_letters(F.col("s"), F.col("x"), F.col("w"), **how).alias("o")).collect()]
    got = place()
    assert got[0] == [(105.0, "○"), (112.5, " "), (120.0, "×"), (130.0, "○"), (137.5, "4"), (142.5, "5")]
    assert got[1] == [(11.0, "○")] and got[2] == [] and got[3] == [(5.0, "𠮷"), (12.5, "a")]
    assert place(half=1.0, spaced=False)[0] == [(104.5, "○"), (113.5, "×"), (122.5, "○"), (131.5, "4"), (140.5, "5")]


@pytest.mark.parametrize(("text", "marks"), [("○ ○　× 45", "○○×"), ("第○号議案", ""), ("議案 ○", "○"), ("45", ""), ("", ""), ("○5○", "○"), ("動○議", "")])
def test_trailing_marks(spark, text, marks):
    assert "".join(arrays(spark, [text], lambda c: lattice.trailing_marks(c, "○×"), "string")[0]) == marks


def test_a_row_that_does_not_fill_the_columns_is_unread(spark):
    """Four rows of twelve; one lacks a mark, one has all but set a column off, one has a stray: no vote is ever shifted."""
    def row(y, xs, mark="○"):
        return [("d", 1, mark, x - 4.0, float(y), 8.0, 8.0) for x in xs]

    even = [100.0 + 12 * i for i in range(12)]
    items = row(700, even) + row(680, even, "×") + row(660, even[:-1]) + row(640, [*even[:5], *[x + 9 for x in even[5:]]]) + row(620, [20.0, *even]) + row(600, even[:4])
    items += [("d", 2, "○", 1.0, 1.0, 8.0, 8.0), ("e", 1, "○○○○○○○○○○ 10", 100.0, 10.0, 110.0, 8.0)]
    df = spark.createDataFrame(items, "doc string, page int, str string, x double, y double, w double, h double").repartition(3)
    got = {}
    for r in lattice.vote_cells(df, "○×").collect():
        got.setdefault((r.doc, r.page, r.row), {})[r.col] = r.mark
    assert {k: "".join(v[i][0] for i in range(len(v))) for k, v in got.items()} == {("d", 1, 0): "○" * 12, ("d", 1, 1): "×" * 12, ("d", 1, 2): "不" * 12, ("d", 1, 3): "不" * 12, ("d", 1, 4): "○" * 12, ("e", 1, 0): "○" * 10}
    assert lattice.vote_cells(df.limit(0), "○×").count() == 0


def test_joined_marks_go_to_the_columns_they_span(spark):
    items = spark.createDataFrame([("d", 1, "○ ○", 740.0, 0.0, 13.8, 8.0), ("d", 1, "○○○", 740.0, 1.0, 13.8, 8.0), ("d", 1, "議長", 740.0, 2.0, 13.8, 8.0), ("d", 1, "●", 740.0, 3.0, 8.0, 8.0), ("x", 1, "○○", 740.0, 4.0, 13.8, 8.0)], "doc string, page int, str string, x double, y double, w double, h double")
    columns = spark.createDataFrame([("d", 1, x) for x in (730.8, 740.2, 749.4, 758.6)], "doc string, page int, x double")
    got = sorted((r.y, r.x, r.str, round(r.w, 1)) for r in lattice.split_over(items, columns, ["○", "●"]).collect())
    assert got == [(0.0, 740.2, "○", 6.9), (0.0, 749.4, "○", 6.9), (1.0, 740.0, "○○○", 13.8), (2.0, 740.0, "議長", 13.8), (3.0, 740.0, "●", 8.0), (4.0, 740.0, "○○", 13.8)]


def test_rotation_and_its_inverse(spark):
    df = spark.createDataFrame([(t, 10.0, 20.0, 30.0, 5.0) for t in (0, 90, 180, 270, 45, -90)], "t int, x double, y double, w double, h double")
    there = geometry.page_rotation(F.col("t"), F.lit(600.0), F.lit(800.0))
    box = geometry.turned_box(there, *[F.col(c) for c in "xywh"])
    got = {r.t: tuple(r.b) if r.b and r.b.x is not None else None for r in df.select("t", box.alias("b")).collect()}
    assert got == {0: (10, 20, 30, 5), 90: (20, 560, 5, 30), 180: (560, 775, 30, 5), 270: (775, 10, 5, 30), -90: (775, 10, 5, 30), 45: None}
    four = geometry.product(F.array(*[geometry.matrix(0, -1, 1, 0, 0, 600)] * 4))
    m = df.limit(1).select(four.alias("m")).first().m
    assert tuple(m) == (1, 0, 0, 1, 0, 0)
    lines = spark.createDataFrame([("d", 1, 10.0, 0.0, 50.0)], "doc string, page int, x double, y0 double, y1 double"), spark.createDataFrame([("d", 1, 20.0, 0.0, 9.0)], "doc string, page int, y double, x0 double, x1 double")
    up, level = geometry.turned_lines(*lines, geometry.matrix(0, -1, 1, 0, 0, 600))
    assert [tuple(r)[2:] for r in up.collect()] == [(20.0, 591.0, 600.0)] and [tuple(r)[2:] for r in level.collect()] == [(590.0, 0.0, 50.0)]


def test_segments_of_near_lines_are_one(spark):
    lines = spark.createDataFrame([("d", 1, 10.4, 0.0, 5.0), ("d", 1, 11.4, 4.0, 9.0), ("d", 1, 30.0, 0.0, 5.0), ("d", 1, 10.5, 20.0, 30.0)], "doc string, page int, x double, y0 double, y1 double")
    got = sorted(tuple(r)[2:] for r in geometry.merged_segments(lines, at="x", low="y0", high="y1").collect())
    assert got == [(10.5, 20.0, 30.0), (pytest.approx(10.9), 0.0, 9.0), (30.0, 0.0, 5.0)]


def test_columns_given_by_page_are_not_dealt_out_and_gathered_again(spark):
    items = spark.createDataFrame([(1, 1, "○●", 10.0, 10.0), (1, 1, "○○", 40.0, 0.0), (2, 1, "○○", 10.0, 10.0)], "doc int, page int, str string, x double, w double")
    xs = spark.createDataFrame([(1, 1, [10.0, 20.0, 40.0])], "doc int, page int, xs array<double>")
    one = lattice.split_over(items, xs, ["○", "●"])
    other = lattice.split_over(items, xs.select("doc", "page", F.explode("xs").alias("x")), ["○", "●"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.count() == 4
    assert "collect_list" not in one._jdf.queryExecution().executedPlan().toString()


def test_a_page_is_read_after_one_shuffle(spark):
    from rollbook.plans import matrices

    plan = matrices._matrix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


def test_a_mark_without_a_place_leaves_the_others_their_columns(spark):
    items = [("d", 1, "○", 100.0 + 12 * i, y, 8.0, 8.0) for y in (700.0, 680.0) for i in range(10)]
    items += [("d", 1, "○", x, 660.0, 8.0, 8.0) for x in [None, *[112.0 + 12 * i for i in range(9)]]]
    df = spark.createDataFrame([*items, (None, 1, "○○○○○○○○○○", 100.0, 10.0, 120.0, 8.0)], "doc string, page int, str string, x double, y double, w double, h double")
    got = {}
    for r in lattice.vote_cells(df, "○×").collect():
        got.setdefault((r.doc, r.row), []).append(r.mark)
    assert got == {("d", 0): ["○"] * 10, ("d", 1): ["○"] * 10, ("d", 2): ["不明"] * 10}
