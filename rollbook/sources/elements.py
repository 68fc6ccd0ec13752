"""Landed HTML as a stream of elements and texts, from which layouts are read with windows and joins.

Each page gives one row for every element and text, in order: ``at`` is its
place, ``stop`` the place at which it ends, ``parent`` the place of the element
around it, ``next`` that of the next element with the same parent. What an element holds are the rows from ``at`` to ``stop``, so a
question about a page is a question about intervals, and no row repeats what
another has.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = "at int, stop int, parent int, next int, tag string, cls string, key string, link string, text string"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style"}
SCOPES = ("table", "td", "th", "caption")  # what an end tag inside does not reach out of
LISTS = ("ul", "ol", "dl")
CELLS = ("td", "th", "caption")
ROWS = ("tr", "thead", "tbody", "tfoot")
HEADS = tuple(f"h{i}" for i in range(1, 7))
BLOCKS = {"p", "div", "table", "form", "section", "article", "hr", *LISTS, *HEADS}
# an opening tag ends an open element of these kinds of the same list or cell
FOLLOWS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "a": ("a",), "option": ("option",), **{h: HEADS for h in HEADS}}
AROUND = SCOPES + LISTS  # what an opening tag inside ends nothing outside of
TABLED = {*CELLS, *ROWS}
FOLLOWING = {*TABLED, *BLOCKS, *FOLLOWS}  # tags that may end others
# Pages made of these alone are cut by one pattern; any other is read by the library's parser, which tells the same of them.
PIECES = re.compile(r"<(/?[a-zA-Z][^<>]*|!--(?!-?>)(?:[^-]++|-(?!-))*+--|![dD][oO][cC][tT][yY][pP][eE][^<>]*)>([^<]*)")
COMMENT = re.compile(r"<!--(?!-?>)(?:[^-]++|-(?!-))*+-->")
TURNS = re.compile(r"[^<>]*+(?:<[^<>]*+>[^<>]*+)*+")  # no bracket but those of tags
END = re.compile(r"/([a-zA-Z][a-zA-Z0-9]*)[ \t\r\n\f]*")
VALUE = r"""(?:"[^"<>]*"|'[^'<>]*'|[^ \t\r\n\f"'=`<>]*[^ \t\r\n\f"'=`<>/])"""
ATTRIBUTE = re.compile(rf"[ \t\r\n\f]+([a-zA-Z_][-\w]*)(?:=({VALUE}))?", re.ASCII)
START = re.compile(rf"([a-zA-Z][a-zA-Z0-9]*)((?:{ATTRIBUTE.pattern})*+)[ \t\r\n\f]*/?", re.ASCII)
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}  # what stands inside may be read otherwise
DEEP, MANY = 64, 20000  # depth of open elements, and answers of the rules, that are remembered


@lru_cache(maxsize=8192)
def tag_of(piece: str) -> tuple | None:
    """(what it does, tag, cls, key, link) of a tag, without its brackets; all None for what is none, None for what is not plain. A tag opens by its name and ends by the name after a slash."""
    if piece[:1] == "!":
        return (None,) * 5 if PIECES.fullmatch(f"<{piece}>") else None
    if piece[:1] == "/":
        end = END.fullmatch(piece)
        return end and ("/" + end[1].lower(), end[1].lower(), None, None, None)
    start = START.fullmatch(piece)
    if not start:
        return None
    tag, attributes = start.groups()[:2]
    if not attributes:
        return tag.lower(), tag.lower(), "", None, None
    has = {}
    for name, value in ATTRIBUTE.findall(attributes):
        if piece[-1] == "/" and value and value[0] not in "'\"":
            return None  # the slash may be the value's
        if value:
            value = value[1:-1] if value[0] in "'\"" else value
            has[name.lower()] = unescape(value) if "&" in value else value
        else:
            has[name.lower()] = None
    return tag.lower(), tag.lower(), " ".join((has.get("class") or "").split()), has.get("id"), has.get("href") or has.get("src")


def cut(page: str) -> tuple[str, list[str], list[str]] | None:
    """The text before a page's first tag, its tags without their brackets, and the text behind each; None where something else stands between."""
    bare = COMMENT.sub("<!---->", page) if "<!--" in page else page
    if TURNS.fullmatch(bare):
        parts = bare.replace(">", "<").split("<")
        return parts[0], parts[1::2], parts[2::2]
    lead = page.find("<")
    if lead < 0:
        return page, [], []
    found = PIECES.findall(page, lead)
    pieces, texts = [p for p, _ in found], [t for _, t in found]
    return (page[:lead], pieces, texts) if lead + sum(map(len, pieces)) + sum(map(len, texts)) + 2 * len(pieces) == len(page) else None


def pieces_of(page: str) -> tuple[str, list[tuple], list[str]] | None:
    """The text before the first tag of a plain page, what each tag says, and the text behind each; None for a page that is not plain."""
    found = cut(page)
    if found is None:
        return None
    lead, pieces, texts = found
    tags = [*map(tag_of, pieces)]
    if None in tags:
        return None
    if not RAW.isdisjoint([t[0] for t in tags]):
        for i, t in enumerate(tags):
            if t[0] in RAW and (pieces[i][-1] == "/" or "&" in texts[i] or i + 1 == len(tags) or tags[i + 1][0] != "/" + t[0]):
                return None
    return lead, tags, texts


class _Scan(HTMLParser):
    """Elements and texts of a page. Open elements end with their parent or with what may not stand inside them; each is opened and ended once."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []  # rows of the open elements
        self.depths: dict[str, list[int]] = defaultdict(list)  # places in ``open`` by tag
        self.silent = 0
        self.latest: dict[int, int] = {}  # the latest element in each parent; -1 is the page

    def last(self, tags: tuple[str, ...]) -> int:
        found, depths = -1, self.depths
        for t in tags:
            of = depths.get(t)
            if of and of[-1] > found:
                found = of[-1]
        return found

    def close_to(self, depth: int) -> None:
        rows, opened, depths, stop = self.rows, self.open, self.depths, len(self.rows)
        while len(opened) > depth:
            row = rows[opened.pop()]
            row[1] = stop
            tag = row[4]
            depths[tag].pop()
            if tag in SILENT:
                self.silent -= 1

    def follow(self, tag: str) -> None:
        if tag in TABLED:
            table = self.last(("table",))
            for ended in (CELLS, ("tr",) if tag == "tr" else ROWS if tag in ROWS else ()):
                while (found := self.last(ended)) > table:
                    self.close_to(found)
        for ended in (FOLLOWS.get(tag, ()), ("p",) if tag in BLOCKS else ()):
            found = self.last(ended)
            if found >= 0 and found > self.last(AROUND):
                self.close_to(found)

    def begin(self, tag: str, cls: str, key: str | None, link: str | None) -> None:
        if tag in FOLLOWING:
            self.follow(tag)
        rows, opened = self.rows, self.open
        at, parent = len(rows), opened[-1] if opened else -1
        before = self.latest.get(parent)
        if before is not None:
            rows[before][3] = at
        self.latest[parent] = at
        rows.append([at, at + 1, parent if opened else None, None, tag, cls, key, link, None])
        if tag not in VOID:
            self.depths[tag].append(len(opened))
            opened.append(at)
            if tag in SILENT:
                self.silent += 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        has = dict(attrs)
        self.begin(tag, " ".join((has.get("class") or "").split()), has.get("id"), has.get("href") or has.get("src"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        bound = -1 if tag == "table" else self.last(("table",)) if tag in CELLS or tag in ROWS else self.last(SCOPES)
        if self.depths[tag] and self.depths[tag][-1] > bound:
            self.close_to(self.depths[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.silent:
            rows, opened = self.rows, self.open
            rows.append([len(rows), len(rows) + 1, opened[-1] if opened else None, None, None, None, None, None, data])


class _Open(dict):
    """Tags of the open elements, and what the rules of ``_Scan`` answer there to each tag that comes: how many stay open, whether it begins an element, whether that stays open, and what is open then.

    Pages have few such states and meet them over and over: each answer is
    worked out once. Depths beyond ``DEEP`` are not remembered, and all is
    forgotten after ``MANY`` answers.
    """

    __slots__ = ("silent", "tags")
    known: ClassVar[dict[tuple[str, ...], _Open]] = {}
    told: ClassVar[int] = 0

    def __init__(self, tags: tuple[str, ...]) -> None:
        self.tags, self.silent = tags, not SILENT.isdisjoint(tags)

    @classmethod
    def of(cls, tags: tuple[str, ...]) -> _Open:
        if cls.told > MANY:
            cls.known, cls.told = {}, 0
        return cls.known.get(tags) or cls.known.setdefault(tags, cls(tags))

    def __missing__(self, does: str) -> tuple[int, bool, bool, _Open]:
        scan, begins, tag = _Scan(), does[0] != "/", does.lstrip("/")
        for i, t in enumerate(self.tags):
            scan.rows.append([i, None, None, None, t])
            scan.open.append(i)
            scan.depths[t].append(i)
        if not begins:
            scan.handle_endtag(tag)
        elif tag in FOLLOWING:
            scan.follow(tag)
        keep, stays = len(scan.open), begins and tag not in VOID
        if keep + stays > DEEP:
            raise OverflowError
        _Open.told += 1
        self[does] = answer = keep, begins, stays, _Open.of((*self.tags[:keep], tag) if stays else self.tags[:keep])
        return answer


def built(lead: str, tags: list[tuple], texts: Sequence[str]) -> list[list]:
    """The rows that ``_Scan`` makes of a plain page's pieces."""
    here = _Open.of(())
    rows: list[list] = [[0, 1, None, None, None, None, None, None, unescape(lead)]] if lead else []
    opened: list[list] = []
    latest: list[list | None] = [None]  # the latest element in the page and in each open one
    at, depth, parent = len(rows), 0, None
    for (does, tag, cls, key, link), text in zip(tags, texts, strict=True):
        if does:
            keep, begins, stays, here = here[does]
            if keep < depth:
                for row in opened[keep:]:
                    row[1] = at
                del opened[keep:], latest[keep + 1 :]
                depth, parent = keep, opened[-1][0] if keep else None
            if begins:
                row = [at, at + 1, parent, None, tag, cls, key, link, None]
                if latest[-1]:
                    latest[-1][3] = at
                latest[-1] = row
                rows.append(row)
                if stays:
                    opened.append(row)
                    latest.append(None)
                    depth, parent = depth + 1, at
                at += 1
        if text and not here.silent:
            rows.append([at, at + 1, parent, None, None, None, None, None, unescape(text) if "&" in text else text])
            at += 1
    for row in opened:
        row[1] = at
    return rows


def elements_of(page: str | None) -> list[list]:
    plain = pieces_of(page or "")
    if plain:
        try:
            return built(*plain)
        except OverflowError:
            pass
    scan = _Scan()
    if plain is None:
        scan.feed(page)
        scan.close()
    else:
        lead, tags, texts = plain
        for (does, tag, *has), text in zip([(None,) * 5, *tags], (lead, *texts), strict=True):
            if does and does[0] != "/":
                scan.begin(tag, *has)
            elif does:
                scan.handle_endtag(tag)
            if text:
                scan.handle_data(unescape(text))
    scan.close_to(0)
    return scan.rows


def elements(pages: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """The elements and texts of each page, with the page's ``id``. A null or empty page has none; text of scripts and styles is left out."""
    id_type = pages.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                rows = [(i, *row) for i, page in zip(part["id"], part["page"], strict=True) for row in elements_of(page)]
                yield pd.DataFrame(rows, columns=["id", *names]).astype({c: "Int32" for c in ("at", "stop", "parent", "next")})

    return pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("page")).mapInPandas(run, f"id {id_type}, {FIELDS}")


def is_a(tag: str | None = None, cls: str | None = None) -> Column:
    """Elements with a tag, a class, or both."""
    has = F.col("tag") == tag if tag else F.col("tag").isNotNull()
    return has & F.concat(F.lit(" "), F.col("cls"), F.lit(" ")).contains(f" {cls} ") if cls else has


def last_of(picked: Column, *more: Column) -> Column:
    """The last element so far that a condition picks (at, stop, next and ``more`` of its own columns); what it does not hold any more is told by ``stop``."""
    so_far = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(picked, F.struct("at", "stop", "next", *more)), ignorenulls=True).over(so_far)


def inside(element: Column) -> Column:
    """Whether a row is, or stands in, an element given by ``last_of``."""
    return F.coalesce(F.col("at") < element["stop"], F.lit(False))


def within(nodes: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """``nodes`` with, for each name, the place of the element that a row stands in (or is); null outside.

    Elements picked by one condition do not hold one another: a row belongs to
    the last that begins before it, if that has not ended.
    """
    held = nodes.withColumns({f"_{name}": last_of(picked) for name, picked in marks.items()})
    return held.withColumns({name: F.when(inside(F.col(f"_{name}")), F.col(f"_{name}.at")) for name in marks}).drop(*[f"_{name}" for name in marks])


def text_in_order(where: Column | None = None) -> Column:
    """The texts of a group of rows, in their order on the page, put together."""
    there = F.col("text").isNotNull() if where is None else F.col("text").isNotNull() & where
    pieces = F.sort_array(F.collect_list(F.when(there, F.struct("at", "text"))))
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def texts(nodes: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """id, field, at and text of each element that a field's condition picks, empty ones too."""
    found = within(nodes, fields)
    each = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("own")) for name in fields])
    rows = found.select("id", "at", "text", F.explode(F.filter(each, lambda x: x["own"].isNotNull())).alias("f"))
    return rows.groupBy("id", F.col("f.field").alias("field"), F.col("f.own").alias("own")).agg(text_in_order().alias("text")).withColumnRenamed("own", "at")
