"""Landed HTML pages as tables of cells, links and headings; layouts are read from those with joins and windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollbook.functions.text import squash
from rollbook.sources.elements import built, elements_of, pieces_of
from rollbook.sources.shapes import KEPT, LONG, Places, marks, picked, values_of

PARTS = "kind string, tbl int, line int, cell int, text string, href string"
KINDS = {"td": "cell", "th": "cell", "a": "link", "title": "title", "h1": "h1", "h2": "h2", "h3": "h3"}


def _parts(rows: list[list]) -> list[tuple]:
    out: list[tuple] = []
    around: list[tuple[int, list[int]]] = []  # tables around a place: where each ends; its number, row and cell
    outer, table = [-1, -1, -1], -1
    for at, stop, _, _, tag, _, _, link, _ in rows:
        while around and around[-1][0] <= at:
            around.pop()
        place = around[-1][1] if around else outer
        if tag == "table":
            table += 1
            around.append((stop, [table, -1, -1]))
        elif tag == "tr":
            place[1:] = place[1] + 1, -1
        elif tag in ("td", "th"):
            place[2] += 1
        if tag in KINDS:
            text = "".join("\n" if r[4] == "br" else r[8] or "" for r in rows[at + 1 : stop])
            out.append((KINDS[tag], *(place if KINDS[tag] in ("cell", "link") else (None, None, None)), text, link if tag == "a" else None))
    return out


@lru_cache(maxsize=KEPT)
def _plan(shape: str) -> tuple | None:
    """Of pages whose tags do this: how many parts they have, their kinds, tables, rows and cells, the texts to put together, and which values are the parts' texts and links; None if elements stand too deep."""
    does = shape.split("<")
    n = len(does) + 1  # values: the texts, and the links of its a
    links = iter(marks(n + shape.count("a"))[n:])
    tags = [(d, d.lstrip("/"), None, None, next(links) if d == "a" else None) if d else (None,) * 5 for d in does]
    lead, *texts = marks(n)
    try:
        kinds, tables, lines, cells, text, href = zip(*_parts(built(lead, tags, texts)), strict=True)
    except OverflowError:
        return None
    except ValueError:
        return 0, (), (), (), (), [], None, None
    places = Places(n + does.count("a"))
    text, href = [places.of(t) for t in text], [places.of(t) for t in href]
    return len(kinds), kinds, tables, lines, cells, places.joins(), picked(text), picked(href)


def _told(page: str | None, columns: list[list]) -> int:
    """Parts of a page, added to the columns; their number."""
    found = pieces_of(page or "")
    if found and 0 < len(found[1]) <= LONG:
        lead, tags, texts = found
        plan = _plan("<".join([t[0] or "" for t in tags]))
        if plan:
            n, kinds, tables, lines, cells, joins, text, href = plan
            if n:
                values = values_of((lead, *texts), "&" in page)
                values += [t[4] for t in tags if t[0] == "a"]
                values += ["".join(join(values)) for join in joins]
                values.append(None)
                for column, part in zip(columns, (kinds, tables, lines, cells, text(values), href(values)), strict=True):
                    column += part
            return n
    parts = _parts(elements_of(page))
    for column, part in zip(columns, zip(*parts, strict=True), strict=False):
        column += part
    return len(parts)


def parts_of(page: str | None) -> list[tuple]:
    """Cells (with their table, row and place), links and headings of a page, in the order in which they begin; left open, they end where the next may begin."""
    columns: list[list] = [[] for _ in range(6)]
    _told(page, columns)
    return [*zip(*columns, strict=True)]


def page_parts(pages: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """One row for each cell, link and heading of each page; ``pos`` is their order. A page without any has no rows."""
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), *T.StructType.fromDDL(f"pos int, {PARTS}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                ids, texts = (batch.column(i).slice(start, 512) for i in (0, 1))
                columns: list[list] = [[] for _ in range(6)]
                counts = np.array([_told(page, columns) for page in texts.to_pylist()])
                if counts.any():
                    pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    found = [ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))).cast(arrow.field(0).type), pa.array(pos, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*found, *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:], strict=True)]], schema=arrow)

    found = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("page")).mapInArrow(run, schema)
    return found.withColumn("text", squash(F.col("text")))


def labelled_values(parts: DataFrame) -> DataFrame:
    """Pairs of a cell and the cell right of it: what a label's value is."""
    cells = parts.where("kind = 'cell'")
    nxt = F.lead("text").over(Window.partitionBy("id", "tbl", "line").orderBy("cell"))
    return cells.withColumn("value", nxt).where(F.col("value").isNotNull()).select("id", "tbl", "line", F.col("text").alias("label"), "value")


def table_rows(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least as many cells as ``columns``, one column for each."""
    cells = parts.where("kind = 'cell'").groupBy("id", "tbl", "line").agg(F.array_sort(F.collect_list(F.struct("cell", "text"))).alias("c"))
    return cells.where(F.size("c") >= len(columns)).select("id", "tbl", "line", *[F.col("c")[i]["text"].alias(n) for i, n in enumerate(columns)])


def paired_rows(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Each odd row of a table with a value of the row below it."""
    by = Window.partitionBy("id", "tbl").orderBy("line")
    return rows.withColumns({out: F.lead(value).over(by), "_n": F.row_number().over(by)}).where("_n % 2 = 1").drop("_n")


def require_rows(found: DataFrame, pages: DataFrame, *, id_col: str) -> DataFrame:
    """Pages that gave nothing: their layout has changed and they must not pass for empty ones."""
    return pages.select(F.col(id_col).alias("entity")).join(found.select(F.col("id").alias("entity")).distinct(), "entity", "left_anti").withColumn("detail", F.lit("no rows"))
