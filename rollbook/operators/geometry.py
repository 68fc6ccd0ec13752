"""Vote tables from page geometry: positioned texts and ruled lines to cells.

Inputs are landed tables of items (doc, page, str, x, y, w, h), vertical lines
(doc, page, x, y0, y1) and horizontal lines (doc, page, y, x0, x1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1.5  # coordinates closer than this are one line
EDGE = 1.0  # texts nearer than this to a border are in no band
PAGE = ("doc", "page")


def cluster(values: Column, eps: float = EPS) -> Column:
    """Sorted values with near neighbours merged: each joins the last centre within ``eps``, which becomes the mean of the two."""
    def step(out: Column, v: Column) -> Column:
        last = F.element_at(out, -1)
        near = (F.size(out) > 0) & (F.abs(F.coalesce(F.when(F.size(out) > 0, last), F.lit(0.0)) - v) <= eps)
        return F.when(near, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array((last + v) / 2))).otherwise(F.array_append(out, v))

    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)


def bands(bounds: Column) -> Column:
    """Neighbouring bounds as (band, low, high)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(1))), lambda i: F.struct((i - 1).alias("band"), F.get(bounds, i - 1).alias("low"), F.get(bounds, i).alias("high")))


def band_index(bounds: Sequence[float], value: Column, edge: float = EDGE) -> Column:
    """The band of ``bounds`` that holds a value, null for none and for one nearer than ``edge`` to a border."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(bounds) - 1)):
        low, high = sorted(bounds[i : i + 2])
        out = F.when((value > low + edge) & (value < high - edge), i).otherwise(out)
    return out


def nearest(values: DataFrame, anchors: DataFrame, *, by: Sequence[str], item: str, at: str, anchor: str, anchor_at: str) -> DataFrame:
    """The nearest anchor of each item; null where two are equally near."""
    pairs = values.join(anchors, list(by)).withColumn("_far", F.abs(F.col(at) - F.col(anchor_at)))
    least = pairs.withColumn("_least", F.min("_far").over(Window.partitionBy(*by, item))).where("_far = _least")
    return least.groupBy(*by, item).agg(F.when(F.countDistinct(anchor) == 1, F.min(anchor)).alias(anchor))


def grid(vlines: DataFrame, hlines: DataFrame, eps: float = EPS) -> DataFrame:
    """Column bounds (left to right) and row bounds (top to bottom; y grows upwards) of each page."""
    xs = vlines.groupBy(*PAGE).agg(cluster(F.collect_list("x"), eps).alias("xs"))
    ys = hlines.groupBy(*PAGE).agg(F.reverse(cluster(F.collect_list("y"), eps)).alias("ys"))
    return xs.join(ys, list(PAGE))


def merged_segments(lines: DataFrame, *, at: str, low: str, high: str, eps: float = EPS) -> DataFrame:
    """Overlapping segments of one line as one segment: lines of a page of which each is within ``eps`` of the next are one line, at their mean."""
    page = Window.partitionBy(*PAGE).orderBy(at)
    apart = F.coalesce(F.col(at) - F.lag(at).over(page) > eps, F.lit(True)).cast("int")
    told = lines.withColumn("_apart", apart).withColumn("_line", F.sum("_apart").over(page))
    by = Window.partitionBy(*PAGE, "_line").orderBy(low, high)
    reach = F.max(high).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = told.withColumn("_new", F.coalesce(F.col(low) > reach + eps, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(by))
    return new.groupBy(*PAGE, "_line", "_run").agg(F.avg(at).alias(at), F.min(low).alias(low), F.max(high).alias(high)).drop("_line", "_run")


def text_in_order(order: Sequence[Column]) -> Column:
    """The texts of a group put together in the given order, whatever order the rows came in."""
    keyed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("str").alias("s"))))
    return F.array_join(F.transform(keyed, lambda x: x["s"]), "")


def cells(items: DataFrame, grids: DataFrame, edge: float = EDGE) -> DataFrame:
    """The text of each grid cell: items whose centre lies in its row and column band."""
    columns = grids.select(*PAGE, F.inline(bands(F.col("xs")))).toDF(*PAGE, "col", "x0", "x1")
    rows = grids.select(*PAGE, F.inline(bands(F.col("ys")))).toDF(*PAGE, "row", "y1", "y0")
    placed = items.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    inside = placed.join(columns, list(PAGE)).where((F.col("cx") > F.col("x0") + edge) & (F.col("cx") < F.col("x1") - edge))
    inside = inside.join(rows, list(PAGE)).where((F.col("cy") > F.col("y0") + edge) & (F.col("cy") < F.col("y1") - edge))
    return inside.groupBy(*PAGE, "row", "col").agg(text_in_order([-F.col("y"), F.col("x")]).alias("text"))


def vertical_text(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Letters set one below the other as one text; a gap of over one and a half letters is a space."""
    order = Window.partitionBy(*by).orderBy(F.desc("y"), "x")
    gap = F.lag("y").over(order) - F.col("y")
    step = F.greatest(F.col("h"), F.lag("h").over(order), F.lit(1.0))
    spaced = items.withColumn("str", F.when(gap > step * 1.5, F.concat(F.lit(" "), F.col("str"))).otherwise(F.col("str")))
    return spaced.groupBy(*by).agg(F.trim(text_in_order([-F.col("y"), F.col("x")])).alias("text"))


def vote_table(items: DataFrame, vlines: DataFrame, hlines: DataFrame, legend: DataFrame, *, title_col: int = 0, header_row: int = 0) -> DataFrame:
    """Votes of ruled pages: members in the header row, titles in the first column, a mark in each other cell.

    Rows: doc, page, row, title, name, raw and mapped (null for a mark that
    the ``legend``, raw to mapped, lacks; the mark itself is never dropped).
    """
    found = cells(items, grid(vlines, hlines))
    names = found.where(F.col("row") == header_row).select(*PAGE, "col", F.col("text").alias("name"))
    titles = found.where((F.col("col") == title_col) & (F.col("row") != header_row)).select(*PAGE, "row", F.col("text").alias("title"))
    marks = found.where((F.col("col") != title_col) & (F.col("row") != header_row)).select(*PAGE, "row", "col", F.col("text").alias("raw"))
    votes = marks.join(names, [*PAGE, "col"]).join(titles, [*PAGE, "row"])
    return votes.join(legend.select("raw", "mapped"), "raw", "left").select(*PAGE, "row", "title", "name", "raw", "mapped")


def affine(a: float, b: float, c: float, d: float, e: float, f: float, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the matrix (a b c d e f)."""
    return x * a + y * c + e, x * b + y * d + f


def matrix(*six: Column | float) -> Column:
    """The matrix (a b c d e f) as a struct: x' = ax + cy + e, y' = bx + dy + f."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip("abcdef", six, strict=True)])


def product(matrices: Column) -> Column:
    """An array of matrices as one: the first is applied first. None is the identity."""
    def then(m: Column, n: Column) -> Column:
        return matrix(
            m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
            m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"])

    return F.aggregate(matrices, matrix(1, 0, 0, 1, 0, 0), then)


def turned_box(m: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The upright box around a box's four corners under a matrix: a struct of x, y, w and h."""
    corners = [(p * m["a"] + q * m["c"] + m["e"], p * m["b"] + q * m["d"] + m["f"]) for p in (x, x + w) for q in (y, y + h)]
    across, along = zip(*corners, strict=True)
    left, low = F.least(*across), F.least(*along)
    return F.struct(left.alias("x"), low.alias("y"), (F.greatest(*across) - left).alias("w"), (F.greatest(*along) - low).alias("h"))


def page_rotation(degrees: Column, width: Column, height: Column) -> Column:
    """What turns a page of a size, shown turned clockwise by quarters, upright with its corner at 0; null for anything but quarters."""
    turn = F.pmod(degrees, F.lit(360))
    return (
        F.when(turn == 0, matrix(1, 0, 0, 1, 0, 0)).when(turn == 90, matrix(F.lit(0), F.lit(-1), F.lit(1), F.lit(0), F.lit(0), width))
        .when(turn == 180, matrix(F.lit(-1), F.lit(0), F.lit(0), F.lit(-1), width, height)).when(turn == 270, matrix(F.lit(0), F.lit(1), F.lit(-1), F.lit(0), height, F.lit(0)))
    )


def turned_lines(vlines: DataFrame, hlines: DataFrame, m: Column) -> tuple[DataFrame, DataFrame]:
    """Ruled lines under a matrix of quarter turns and shifts: upright ones and level ones anew, each with its ends in order. ``m`` may use columns of both tables."""
    box = turned_box(m, F.col("_x"), F.col("_y"), F.col("_w"), F.col("_h"))
    zero = F.lit(0.0)
    up = vlines.withColumns({"_x": F.col("x"), "_y": F.least("y0", "y1"), "_w": zero, "_h": F.abs(F.col("y1") - F.col("y0"))})
    level = hlines.withColumns({"_x": F.least("x0", "x1"), "_y": F.col("y"), "_w": F.abs(F.col("x1") - F.col("x0")), "_h": zero})
    every = up.select(*PAGE, box.alias("b")).unionByName(level.select(*PAGE, box.alias("b"))).select(*PAGE, "b.*")
    stands = F.col("h") >= F.col("w")
    return every.where(stands).select(*PAGE, "x", F.col("y").alias("y0"), (F.col("y") + F.col("h")).alias("y1")), every.where(~stands).select(*PAGE, "y", F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"))
