"""Vote tables without ruled lines: marks set in rows at even steps, repaired and laid onto columns.

Items are landed as (doc, page, str, x, y, w, h). A column stands for each
member and is known by its even step alone; a row that does not fill the
columns one by one is left unread as a whole, never shifted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.operators.geometry import PAGE

# The mark of a cell that could not be read, and how far apart in steps neighbours of a row may stand.
UNREAD = "不明"
SPACE = "\\s\\u3000"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gaps(xs: Column) -> Column:
    """Differences of neighbours; none for fewer than two values."""
    return F.transform(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, i: x - F.get(xs, i))


def step(xs: Column) -> Column:
    """The median difference of neighbours, of two in the middle the greater; null for fewer than two values."""
    return _median(gaps(xs))


def _median(gaps: Column) -> Column:
    return _let(F.sort_array(gaps), lambda g: F.get(g, F.floor(F.size(g) / 2).cast("int")))


def filled(xs: Column, *, most: int = 2, off: float = 0.25, least: int = 4) -> Column:
    """Ascending centres with those put back that a gap of 2 to ``most`` steps leaves out, evenly between its ends.

    A gap counts as k steps if it differs from them by less than ``off`` of a
    step. Fewer than ``least`` centres are left as they are: they show no step.
    """
    def kept(xs: Column, x: Column, i: Column, s: Column) -> Column:
        gap = F.get(xs, i + 1) - x
        k = F.round(gap / s).cast("int")
        lost = gap.isNotNull() & (k >= 2) & (k <= most) & (F.abs(gap / s - k) < off)
        between = F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda j: x + gap * j / k)
        return F.concat(F.array(x), F.when(lost, between).otherwise(F.array().cast("array<double>")))

    def mended(xs: Column) -> Column:
        return _let(step(xs), lambda s: F.when(s > 0, F.flatten(F.transform(xs, lambda x, i: kept(xs, x, i, s)))).otherwise(xs))

    return _let(xs, lambda v: F.when(F.size(v) < least, v).otherwise(mended(v)))


def trimmed(xs: Column, *, off: float = 0.25, least: int = 4) -> Column:
    """Ascending centres without those at either end whose gap is more than ``off`` of a step away from it, the worse end first; inner gaps are left alone."""
    def state(xs: Column, done: bool) -> Column:
        return F.struct(xs.alias("xs"), F.lit(done).alias("done"))

    def once(now: Column) -> Column:
        def ends(s: Column) -> Column:
            n = F.size(now)
            first, last = (F.abs(F.get(now, a) - F.get(now, b) - s) / s for a, b in ((F.lit(1), F.lit(0)), (n - 1, n - 2)))
            cut = F.when(first > last, F.slice(now, F.lit(2), n - 1)).otherwise(F.slice(now, F.lit(1), n - 1))
            return F.when((n >= least) & (s > 0) & ((first > off) | (last > off)), state(cut, False)).otherwise(state(now, True))

        return _let(step(now), ends)

    # where nothing was cut, nothing more will be: the rest of the turns are not worked out
    def turn(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(once(s["xs"]))

    return _let(xs, lambda v: F.when(F.size(v) < least, v).otherwise(F.aggregate(v, state(v, False), turn, lambda s: s["xs"])))


def core(marks: Column, *, at: str = "x", apart: float = 1.9) -> Column:
    """The longest run of marks (structs, ascending in ``at``) whose neighbours stand at most ``apart`` steps apart; of two the first.

    Fewer than three marks, and such as stand in one place, are one run.
    """
    def longest(marks: Column, xs: Column, s: Column) -> Column:
        breaks = F.filter(F.sequence(F.lit(1), F.size(marks) - 1), lambda i: F.get(xs, i) - F.get(xs, i - 1) > s * apart)

        def runs(cut: Column) -> Column:
            return F.zip_with(F.concat(F.array(F.lit(0)), cut), F.concat(cut, F.array(F.size(marks))), lambda a, b: F.struct((b - a).alias("n"), (-a).alias("before")))

        return _let(F.array_max(_let(breaks, runs)), lambda r: F.slice(marks, 1 - r["before"], r["n"]))

    def of(v: Column) -> Column:
        # most rows have no break at all
        return _let(F.transform(v, lambda m: m[at]), lambda xs: _let(gaps(xs), lambda g: _let(_median(g), lambda s: F.when((s > 0) & (F.array_max(g) > s * apart), longest(v, xs, s)).otherwise(v))))

    return _let(marks, lambda v: F.when(F.size(v) < 3, v).otherwise(of(v)))


def letters(text: Column) -> Column:
    """The letters of a text, by code points; none for an empty one."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.array().cast("array<string>"))


def placed_letters(text: Column, x: Column, w: Column, *, half: float = 0.5, spaced: bool = True) -> Column:
    """Each letter of an item with the x of its middle, by the widths of the letters before it.

    A letter of ASCII takes ``half`` of the width of any other. Without
    ``spaced``, white space takes none and is no letter. An item of one letter
    has its middle where the item has.
    """
    every = letters(text) if spaced else F.filter(letters(text), lambda c: ~c.rlike(f"^[{SPACE}]$"))

    none = F.array().cast("array<struct<x: double, mark: string>>")

    def place(cs: Column, widths: Column) -> Column:
        def middles(before: Column) -> Column:
            whole = F.element_at(before, -1)
            return F.transform(cs, lambda c, i: F.struct((x + w * (F.get(before, i) + F.get(widths, i) / 2) / whole).alias("x"), c.alias("mark")))

        return _let(F.aggregate(widths, F.array(F.lit(0.0)), lambda s, u: F.array_append(s, F.element_at(s, -1) + u)), middles)

    def of(cs: Column) -> Column:
        # what takes one byte is ASCII
        return F.when(F.size(cs) > 0, _let(F.transform(cs, lambda c: F.when(F.octet_length(c) == 1, half).otherwise(1.0)), lambda widths: place(cs, widths))).otherwise(none)

    one = F.array(F.struct((x + w / 2).alias("x"), text.alias("mark")))
    return F.when(F.length(text) == 1, one if spaced else F.filter(one, lambda m: ~m["mark"].rlike(f"^[{SPACE}]$"))).otherwise(_let(every, of))


def trailing_marks(text: Column, marks: str) -> Column:
    """The marks with which an item ends, white space and a number after them left out; a text that ends in anything else has none."""
    tail = F.regexp_extract(text, f"([{SPACE}{marks}]*)[0-9{SPACE}]*$", 1)
    return F.filter(letters(tail), lambda c: ~c.rlike(f"^[{SPACE}]$"))


def marks_of(items: DataFrame, marks: str, *, half: float = 0.5) -> DataFrame:
    """The marks at the end of each item that has any: doc, page, cy, h and marks (x, mark).

    Only letters behind the last that is neither mark, white space nor digit
    count, so a word that holds a mark's letter gives none.
    """
    tail = f"([{SPACE}{marks}]*)[0-9{SPACE}]*$"
    found = items.where(F.regexp_extract("str", tail, 1).rlike(f"[^{SPACE}]")).withColumn("_head", F.length("str") - F.length(F.regexp_extract("str", tail, 0)))
    every = found.select(*PAGE, (F.col("y") + F.col("h") / 2).alias("cy"), "h", F.slice(placed_letters(F.col("str"), F.col("x"), F.col("w"), half=half), F.col("_head") + 1, F.length("str")).alias("_l"))
    return every.select(*PAGE, "cy", "h", F.filter("_l", lambda m: m["mark"].rlike(f"^[{marks}]$")).alias("marks"))


def rows_of(marks: DataFrame, *, least: int = 10, near: float = 0.5) -> DataFrame:
    """Marks of one height put together: doc, page and its rows (topmost first), each an array of marks (x, mark; left to right).

    From the top down, a mark joins the row above while it is no farther from
    the row's first mark than ``near`` of the taller one's height. Rows of
    fewer than ``least`` marks are none.
    """
    # marks of one height are gathered first, so that the fold over a page goes by heights
    heights = marks.groupBy(*PAGE, "cy").agg(F.max("h").alias("h"), F.sort_array(F.flatten(F.collect_list("marks"))).alias("marks"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("cy")).alias("down"), "h", "marks")))

    def band(rows: Column, b: Column) -> Column:
        last, n = F.try_element_at(rows, F.lit(-1)), F.size(rows)
        same = F.coalesce(F.abs(last["down"] - b["down"]) <= F.greatest(last["h"], b["h"], F.lit(1.0)) * near, F.lit(False))
        grown = F.struct(last["down"].alias("down"), last["h"].alias("h"), F.concat(last["marks"], b["marks"]).alias("marks"))
        return F.when(same, F.array_append(F.slice(rows, F.lit(1), n - 1), grown)).otherwise(F.array_append(rows, b))

    bands = heights.groupBy(*PAGE).agg(order.alias("_b")).withColumn("_b", F.aggregate("_b", F.slice("_b", F.lit(1), F.lit(0)), band))
    return bands.select(*PAGE, F.transform(F.filter("_b", lambda b: F.size(b["marks"]) >= least), lambda b: F.sort_array(b["marks"])).alias("rows"))


def centres_of(rows: Column) -> Column:
    """The columns of a page's rows, from those that most agree on how many marks they hold (of two counts the greater); a centre is the mean of its marks."""
    def centres(agreed: Column, n: Column) -> Column:
        def over(value: Callable[[Column], Column]) -> Column:
            return F.aggregate(agreed, F.array_repeat(F.lit(0.0), n), lambda sums, r: F.zip_with(sums, r, lambda s, m: s + value(m["x"])))

        # a mark without a place counts for no mean
        placeless = F.exists(agreed, lambda r: F.exists(r, lambda m: m["x"].isNull()))
        counts = F.when(placeless, over(lambda x: x.isNotNull().cast("double"))).otherwise(F.array_repeat(F.size(agreed).cast("double"), n))
        return F.zip_with(over(lambda x: F.coalesce(x, F.lit(0.0))), counts, lambda s, k: F.when(k > 0, s / k))

    def most(sizes: Column) -> Column:
        counts = F.transform(F.array_distinct(sizes), lambda n: F.struct(F.size(F.filter(sizes, lambda s: s == n)).alias("rows"), n.alias("n")))
        return F.coalesce(F.array_max(counts)["n"], F.lit(0))

    count = _let(F.transform(rows, lambda r: F.size(r)), most)
    return _let(count, lambda n: centres(F.filter(rows, lambda r: F.size(r) == n), n))


def borders_of(centres: Column) -> Column:
    """Left borders of columns, and the right one of the last: halfway between neighbours, half a mean step outside at both ends."""
    n = F.size(centres)
    first, last = F.get(centres, F.lit(0)), F.get(centres, n - 1)
    half = F.when(n > 1, (last - first) / F.greatest(n - 1, F.lit(1)) / 2).otherwise(float("inf"))
    inner = F.transform(F.slice(centres, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, i: (F.get(centres, i) + x) / 2)
    return F.when(n > 0, F.concat(F.array(first - half), inner, F.array(last + half)))


def cells_of(marks: Column, borders: Column) -> Column:
    """The k-th mark of a row for the k-th column, if the row has as many as there are columns and each stands in its own; else the whole row is unread."""
    n = F.size(borders) - 1
    own = F.transform(marks, lambda m, i: (m["x"] >= F.get(borders, i)) & (m["x"] < F.get(borders, i + 1)))
    fits = (F.size(marks) == n) & F.forall(own, lambda ok: ok)
    return F.when(fits, F.transform(marks, lambda m: m["mark"])).otherwise(F.array_repeat(F.lit(UNREAD), n))


def vote_cells(items: DataFrame, marks: str, *, least: int = 10, half: float = 0.5, apart: float = 1.9) -> DataFrame:
    """Votes of pages without lines: the marks of each row by column, left to right, strays beside a row left out.

    ``marks`` are the letters that count as one, as they stand in a class of a
    pattern. A page without a row of at least ``least`` marks gives nothing.
    """
    pages = rows_of(marks_of(items.dropna(subset=list(PAGE)), marks, half=half), least=least)
    # a page is read within its row: what its columns are, and its rows by them
    def read(rows: Column) -> Column:
        return _let(borders_of(centres_of(rows)), lambda borders: F.transform(rows, lambda r: cells_of(r, borders)))

    rows = pages.select(*PAGE, F.posexplode(_let(F.transform("rows", lambda r: core(r, apart=apart)), read)).alias("row", "_cells"))
    return rows.select(*PAGE, "row", F.posexplode("_cells").alias("col", "mark"))


def split_over(items: DataFrame, columns: DataFrame, marks: Sequence[str], *, reach: float = 4.0) -> DataFrame:
    """Items that are several ``marks`` and nothing else, dealt to the columns (doc, page, x) they span, one each; if the numbers differ, an item stays whole.

    The item's columns are kept; ``str``, ``x`` and ``w`` change in what is dealt.
    Where ``columns`` have a page's places in one array already (doc, page,
    xs; ascending), they are taken as they are.
    """
    bare = F.regexp_replace("str", f"[{SPACE}]+", "")
    several = (F.length(bare) >= 2) & bare.rlike(f"^[{''.join(marks)}]+$")
    centres = columns.withColumnRenamed("xs", "_xs") if "xs" in columns.columns else columns.groupBy(*PAGE).agg(F.sort_array(F.collect_list("x")).alias("_xs"))
    met = items.join(centres, list(PAGE), "left").withColumn("_in", F.filter(F.coalesce("_xs", F.array().cast("array<double>")), lambda c: (c >= F.col("x") - reach) & (c <= F.col("x") + F.col("w") + reach)))
    deal = several & (F.size("_in") == F.length(bare))
    parts = F.when(deal, F.zip_with("_in", letters(bare), lambda c, m: F.struct(m.alias("str"), c.cast("double").alias("x"), (F.col("w") / F.size("_in")).cast("double").alias("w")))).otherwise(F.array(F.struct("str", F.col("x").cast("double").alias("x"), F.col("w").cast("double").alias("w"))))
    return met.withColumn("_part", F.explode(parts)).withColumns({c: F.col(f"_part.{c}") for c in ("str", "x", "w")}).drop("_xs", "_in", "_part")
