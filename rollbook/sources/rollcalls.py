"""Roll-call pages to calls, groups and votes: two layouts, read from the stream of a page's elements.

What a page does not say plainly is refused, with the reason, as a whole: no
part of a page whose numbers do not agree passes for its votes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollbook.sources.elements import RAW, built, cut, elements_of, pieces_of, tag_of
from rollbook.sources.shapes import KEPT, LONG, MARK, Places, marks, picked, values_of

# The words that the pages use.
YES, NO, ABSENT = "賛成", "反対", "投票なし"
TOTAL, YES_COUNT, NO_COUNT = "投票総数", "賛成票", "反対票"
TITLE, STANDING = "案件名", "起立採決"
BOX = "ContentsBox"
MARKED = ("pros", "cons", "novote", "names")  # classes of a member's parts
PAGE_FIELDS = """layout string, boxed boolean, day string, title string, totals string, marked string, labels array<struct<text: string, value: string>>, bolds array<string>,
  groups array<struct<head: int, text: string, listed: boolean, tally: string, members: array<struct<at: int, pros: string, cons: string, novote: string, names: string, pro: string, con: string, in_order: boolean>>>>"""

# In the order in which a page is refused for them.
REASONS = ("no date", "no title", "no totals", "heading unreadable", "no list of votes", "tally unreadable", "cells out of order", "vote unreadable", "size differs", "no groups")


@dataclass
class RollCalls:
    """``calls``: id, layout, date, title, total, yes, no. ``groups``: id, at, group, size, yes, no, and the call's date, title and total (``voted``). ``votes``: id, at, group, name, value. ``refused``: id, reason, and the note of ``standing``. ``standing``: id, note."""

    calls: DataFrame
    groups: DataFrame
    votes: DataFrame
    refused: DataFrame
    standing: DataFrame


SPACES = re.compile("[ \t-\r\u00a0\u3000\ufeff]+")  # as ``squash`` has them


@lru_cache(maxsize=16384)
def _squashed(text: str | None) -> str | None:
    """``squash`` of a text when it is read: pages have few different ones, and rules ask for them several times."""
    return None if text is None else SPACES.sub(" ", text).strip(" ")


def _number_after(text: Column, word: str) -> Column:
    """The number behind a word; null for none, and for one too long to be a count."""
    return F.regexp_extract(text, f"{word}\\s*(\\d+)", 1).try_cast("int")


def _date_in(text: Column) -> Column:
    """The first day written in numerals as an ISO date; null for none."""
    part = lambda i: F.regexp_extract(text, "(\\d{4})年\\s*(\\d{1,2})月\\s*(\\d{1,2})日", i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def _heading(text: Column) -> tuple[Column, Column]:
    """A group's name and size from its heading; where it is none, the size is null."""
    part = lambda i: F.regexp_extract(text, "^(.+?)\\s*[(（]\\s*(\\d+)\\s*名\\s*[)）]$", i)
    return F.trim(part(1)), part(2).try_cast("int")


class _Page:
    """The fields of one page: the texts of the elements that mean something in its layout.

    Of each kind the last element so far counts, until it ends; elements of
    several kinds collect the same text. ``old`` pages have tables with
    captions and no dated heading. Where a page has an element for its
    contents, nothing outside it counts.
    """

    def __init__(self, rows: Iterable[Sequence]) -> None:
        kept, box, self.boxed = [], 0, False
        for row in rows:
            if row[6] == BOX:
                box, self.boxed = row[1], True
            kept.append((row, row[0] < box))
        self.rows = [r for r, inside in kept if inside or not self.boxed]
        self.old = not any(r[4] == "h2" and "kaiji_nichiji" in r[5].split() for r in self.rows) and any(r[4] == "caption" and "party" in r[5].split() for r in self.rows)
        self.last: dict[str, tuple[int, int, dict]] = {}  # by kind: where the element begins and ends, and its field
        self.first: dict[str, list[str]] = {}  # texts of the first element of a kind
        self.labels: list[dict] = []
        self.bolds: list[list[str]] = []
        self.groups: dict[int, dict] = {}
        self.cells: dict[int, list[dict]] = {}
        self.page: list[str] = []

    def inside(self, kind: str, at: int) -> bool:
        return kind in self.last and at < self.last[kind][1]

    def open(self, kind: str, row: Sequence, **has) -> dict:
        field = {"at": row[0], "next": row[3], "text": [], **has}
        self.last[kind] = row[0], row[1], field
        return field

    def read(self) -> dict | None:
        if not self.rows:
            return None
        for row in self.rows:
            if row[4]:
                self.element(row, row[5].split())
            elif row[8]:
                self.text(row[0], row[8])
        self.three()
        join, told = "".join, self.first
        for g in self.groups.values():
            g |= {"text": join(g["text"]), "tally": None if g["tally"] is None else join(g["tally"]), "members": [{k: join(v) if isinstance(v, list) else v for k, v in m.items()} for m in g["members"]]}
        return {
            "layout": "old" if self.old else "new", "boxed": self.boxed, "day": join(self.page) if self.old else join(told["day"]) if "day" in told else None,
            **{k: join(told[k]) if k in told else None for k in ("title", "totals", "marked")},
            "labels": [{"text": join(f["text"]), "value": join(f["value"]) if f["value"] is not None else None} for f in self.labels], "bolds": [join(b) for b in self.bolds], "groups": list(self.groups.values()),
        }

    def element(self, row: Sequence, cls: list[str]) -> None:
        at, tag, new = row[0], row[4], not self.old
        if tag == "dl":
            for name, kind in (("ankenmei", "matter"), ("sanpilist", "list")):
                if name in cls:
                    self.open(kind, row)
        elif tag == "li" and "giin" in cls:
            self.open("item", row)
        elif tag in ("table", "tr", "br"):
            self.open(tag, row)
        elif tag == "th":
            field = self.open("label", row, value=None)
            if self.old:
                self.labels.append(field)
        elif tag == "b":
            self.bolds.append(self.open("bold", row)["text"])
        if tag == "h4" and "party" in cls:
            field = self.open("heading", row)
            if new:
                self.groups[at] = {"head": at, "text": field["text"], "listed": False, "tally": None, "members": []}
        elif tag == "caption" and "party" in cls:
            field = self.open("caption", row, ends=self.last["table"][1] if "table" in self.last else at)
            if self.old:
                field["past"] = []
                self.groups[at] = {"head": at, "text": field["text"], "listed": True, "tally": field["past"], "members": []}
        if new:
            self.of_new(row, tag, cls)
        else:
            self.of_old(row, tag, cls)

    def of_new(self, row: Sequence, tag: str, cls: list[str]) -> None:
        at = row[0]
        listed, item = self.inside("list", at), self.inside("item", at)
        group = self.groups[self.last["heading"][0]] if listed and "heading" in self.last and self.last["list"][0] == self.last["heading"][2]["next"] else None
        if group:
            group["listed"] = True
        if tag == "li" and "giin" in cls and group:
            self.member(group, at)
        mark = next((k for k in MARKED if k in cls), None) if item else None
        for kind, holds in (("day", tag == "h2" and "kaiji_nichiji" in cls), ("title", tag == "dd" and self.inside("matter", at)), ("totals", tag == "h3" and "tohyosousu" in cls), ("tally", tag == "dt" and listed), ("mark", mark), ("marked", tag == "p" and "kiritsu" in cls)):
            if holds:
                text = self.open("own", row)["text"]
                if kind == "tally":
                    if group and group["tally"] is None:
                        group["tally"] = text
                elif kind == "mark":
                    if group:
                        member = self.member(group, self.last["item"][0])
                        if member[mark] is None:
                            member[mark] = text
                else:
                    self.first.setdefault(kind, text)
                return

    def member(self, group: dict, at: int) -> dict:
        if not group["members"] or group["members"][-1]["at"] != at:
            group["members"].append({"at": at, **dict.fromkeys(MARKED), "pro": None, "con": None, "in_order": True})
        return group["members"][-1]

    def of_old(self, row: Sequence, tag: str, cls: list[str]) -> None:
        at = row[0]
        if tag == "p" and "kiritsu" in cls:
            self.first.setdefault("marked", self.open("own", row)["text"])
        if tag == "td" and self.inside("tr", at):
            caption = self.last.get("caption")
            head = caption[0] if caption and at < caption[2]["ends"] else None
            field = self.open("cell", row, cls=cls, head=head, image=None)
            if head is not None:
                self.cells.setdefault(self.last["tr"][0], []).append(field)
        if "label" in self.last and at == self.last["label"][2]["next"]:
            self.last["label"][2]["value"] = self.open("value", row)["text"]
        if tag == "img" and self.inside("cell", at) and self.last["cell"][2]["image"] is None:
            self.last["cell"][2]["image"] = row[7] or ""

    def text(self, at: int, text: str) -> None:
        if self.old:
            self.page.append(text)
        for kind in ("own", "bold", "label", "cell", "value") if self.old else ("own", "bold", "heading"):
            if self.inside(kind, at):
                self.last[kind][2]["text"].append(text)
        if self.old and self.inside("caption", at):
            at_break = self.last["br"][0] if "br" in self.last else -1
            self.last["caption"][2]["past" if at_break > self.last["caption"][0] else "text"].append(text)

    def three(self) -> None:
        """Members of old pages: three cells each, in rows that name one."""
        for cells in self.cells.values():
            if any("nam" in c["cls"] for c in cells):
                for i in range(0, len(cells) - 2, 3):
                    pro, con, nam = cells[i : i + 3]
                    if pro["head"] == con["head"] == nam["head"]:
                        in_order = all(k in c["cls"] for k, c in (("pro", pro), ("con", con), ("nam", nam)))
                        self.groups[nam["head"]]["members"].append({"at": pro["at"], "pros": pro["text"], "cons": con["text"], "novote": None, "names": nam["text"], "pro": pro["image"], "con": con["image"], "in_order": in_order})


def _judged(read: DataFrame) -> DataFrame:
    """Pages as read with what they say and the first reason to refuse them: one row for each, all within the row."""
    said = lambda x, word: F.coalesce(x, F.lit("")) == word
    packed = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit(""))

    def member(m: Column, old: Column) -> Column:
        yes_new, no_new, absent = said(m["pros"], YES), said(m["cons"], NO), packed(m["novote"]) == ABSENT
        new = F.when(yes_new & ~no_new & ~absent, YES).when(no_new & ~yes_new & ~absent, NO).when(absent & ~yes_new & ~no_new, ABSENT)
        yes, no = F.coalesce(F.lower(m["pro"]).contains("sansei"), F.lit(False)), F.coalesce(F.lower(m["con"]).contains("hantai"), F.lit(False))
        blank = m["pro"].isNull() & m["con"].isNull() & said(m["pros"], "") & said(m["cons"], "")
        tables = F.when(yes & no, F.lit(None)).when(yes, YES).when(no, NO).when(blank, ABSENT)
        return F.struct(m["at"].alias("at"), F.coalesce(m["names"], F.lit("")).alias("name"), F.when(old, tables).otherwise(new).alias("value"), m["in_order"].alias("in_order"))

    def group(g: Column, old: Column) -> Column:
        name, size = _heading(g["text"])
        members = F.filter(F.transform(g["members"], lambda m: member(m, old)), lambda m: ~old | (m["name"] != "") | ~m["in_order"])
        return F.struct(g["head"].alias("at"), name.alias("group"), size.alias("size"), g["listed"].alias("listed"), _number_after(g["tally"], YES_COUNT).alias("yes"), _number_after(g["tally"], NO_COUNT).alias("no"), members.alias("members"))

    old = F.col("layout") == "old"
    label = F.get(F.filter("labels", lambda x: packed(x["text"]).startswith(TITLE)), F.lit(0))
    totals = F.when(old, F.get(F.filter("bolds", lambda x: x.contains(TOTAL)), F.lit(0))).otherwise(F.col("totals"))
    bold = F.get(F.filter("bolds", lambda x: x.contains(STANDING)), F.lit(0))
    title = F.when(old, label["value"]).otherwise(F.col("title"))
    # one row each: a generator, past which no filter moves, so that all is worked out once
    told = F.struct(
        _date_in(F.col("day")).alias("date"), F.nullif(F.replace(title, F.lit(" "), F.lit("　")), F.lit("")).alias("title"), *[_number_after(totals, word).alias(n) for n, word in (("total", TOTAL), ("yes", YES_COUNT), ("no", NO_COUNT))],
        F.when(F.col("boxed"), F.coalesce(F.when(F.col("marked").contains(STANDING), F.col("marked")), bold)).alias("note"), F.transform("groups", lambda g: group(g, old)).alias("groups"))
    numbers = read.select("id", "layout", F.explode(F.array(told)).alias("told")).select("id", "layout", "told.*")
    some = lambda holds: F.exists("groups", holds)
    holds = dict(zip(REASONS, (
        F.col("date").isNull(), F.col("title").isNull(), F.col("total").isNull() | F.col("yes").isNull() | F.col("no").isNull(),
        some(lambda g: g["size"].isNull()), some(lambda g: ~g["listed"]), some(lambda g: g["yes"].isNull() | g["no"].isNull()),
        some(lambda g: F.exists(g["members"], lambda m: ~m["in_order"])), some(lambda g: F.exists(g["members"], lambda m: m["value"].isNull())),
        some(lambda g: g["size"] != F.size(g["members"])), F.size("groups") == 0,
    ), strict=True))
    return numbers.withColumn("reason", F.coalesce(*[F.when(c, what) for what, c in holds.items()]))


TEXTS = ("day", "title", "totals", "marked", "label", "value", "bold", "heading", "tally", *MARKED, "pro", "con")
LINKS = ("pro", "con")  # the other texts are squashed
REST = ("layout", "boxed", "labels", "bolds", "groups", "listed", "members", "in_order")  # lists by their lengths
PICTURE = ("img", "IMG")


def _texts(f: dict) -> list[list[str | None]]:
    """What a page's fields have for each of ``TEXTS``."""
    labels, groups = f["labels"], f["groups"]
    members = [m for g in groups for m in g["members"]]
    return [
        *[[f[k]] for k in TEXTS[:4]], [x["text"] for x in labels], [x["value"] for x in labels], f["bolds"], [g["text"] for g in groups], [g["tally"] for g in groups],
        *[[m[k] for m in members] for k in TEXTS[9:]],
    ]


def _rest(f: dict) -> list[list]:
    """What a page's fields have for each of ``REST``."""
    groups = f["groups"]
    return [[f["layout"]], [f["boxed"]], [len(f["labels"])], [len(f["bolds"])], [len(groups)], [g["listed"] for g in groups], [len(g["members"]) for g in groups], [m["in_order"] for g in groups for m in g["members"]]]


@dataclass
class _Plan:
    """How to read pages of one shape: which texts make each of ``TEXTS``, what each of ``REST`` is, and after how many elements and which text its groups and members stand."""

    raw: list[int]  # texts that may hold no reference, and those that count for nothing
    silent: list[int]
    cells: dict[int, int]  # pieces that begin a cell, and the value that is its picture
    joins: list[Callable]
    texts: list[Callable]
    rest: list[list]
    heads: tuple[list[int], Callable]
    ats: tuple[list[int], Callable]


@lru_cache(maxsize=KEPT)
def _plan(shape: str) -> _Plan | None:
    """A plan for pages with these tags, if any can be told; a picture may stand at the beginning of each cell, as old votes differ in nothing else."""
    found = pieces_of(shape)
    if not found:
        return None
    tags, n = found[1], len(found[1]) + 1
    cells = {k: n + i for i, k in enumerate([k for k, t in enumerate(tags) if t[0] == "td"])}
    mark = marks(n + len(cells))
    pieces, behind = [], []
    for k, t in enumerate(tags):
        pieces.append(t)
        if k in cells:
            pieces.append(("img", "img", "", None, mark[cells[k]]))
            behind.append("")
        behind.append(mark[k + 1])
    try:
        rows = built(mark[0], pieces, behind)
    except OverflowError:
        return None
    pictures = set(mark[n:])
    page = _Page(rows)
    if not any(r[4] for r in page.rows) or (page.old and any(r[4] == "img" and r[7] not in pictures for r in page.rows)):
        return None
    fields = page.read()
    places = Places(len(mark))
    texts = [[places.of(t) for t in column] for column in _texts(fields)]
    spots, there, elements = {}, [], 0
    for row in rows:
        if row[8]:
            there.append(ord(row[8]) - MARK)
        elif row[7] not in pictures:
            spots[row[0]] = elements, there[-1]
            elements += 1

    def spotted(ats: list[int]) -> tuple[list[int], Callable]:
        return [spots[at][0] for at in ats], picked([spots[at][1] for at in ats])

    groups = fields["groups"]
    return _Plan(
        [k + 1 for k, t in enumerate(tags) if t[0] in RAW], sorted({*range(n)} - {*there}), cells, places.joins(), [picked(t) for t in texts], _rest(fields),
        spotted([g["head"] for g in groups]), spotted([m["at"] for g in groups for m in g["members"]]))


def _pictures(pieces: list[str], texts: list[str]) -> list[tuple[int, str]]:
    """Takes the pictures at the beginning of cells out of a page's pieces; each with the place of its cell."""
    out, found = [], []
    for p in {*pieces}:
        if p[:3] in PICTURE and (told := tag_of(p)) and told[:4] == ("img", "img", "", None):
            i = -1
            for _ in range(pieces.count(p)):
                i = pieces.index(p, i + 1)
                found.append((i, told[4] or ""))
    for i, link in sorted(found, reverse=True):
        if i and not texts[i - 1] and (cell := tag_of(pieces[i - 1])) and cell[0] == "td":
            out.append((i - 1, link))
            texts[i - 1] = texts[i]
            del pieces[i], texts[i]
    return [(at - before, link) for before, (at, link) in enumerate(reversed(out))]


class _Fields:
    """The fields of many pages, one column for each part of ``PAGE_FIELDS``."""

    def __init__(self) -> None:
        self.texts: list[list[str | None]] = [[] for _ in TEXTS]
        self.rest: list[list] = [[] for _ in REST]
        self.heads: list[int] = []
        self.ats: list[int] = []

    def add(self, page: str | None, rows_of: Callable[[object], Iterable[Sequence]]) -> bool:
        """Takes a page; whether it has any element or text."""
        found = cut(page or "") if rows_of is elements_of else None
        if found and 0 < len(found[1]) <= LONG and self.planned(page, *found):
            return True
        f = _Page(rows_of(page)).read()
        if f is None:
            return False
        for column, part in zip(self.texts + self.rest, _texts(f) + _rest(f), strict=True):
            column += part
        self.heads += [g["head"] for g in f["groups"]]
        self.ats += [m["at"] for g in f["groups"] for m in g["members"]]
        return True

    def planned(self, page: str, lead: str, pieces: list[str], texts: list[str]) -> bool:
        pictures = _pictures(pieces, texts) if "<img" in page or "<IMG" in page else []
        plan = _plan(f"<{'><'.join(pieces)}>")
        escaped = "&" in page
        if not plan or (escaped and any("&" in texts[i - 1] for i in plan.raw)):
            return False
        values = values_of((lead, *texts), escaped)
        for i in plan.silent:
            values[i] = ""
        weights = [*map(bool, values)]
        values += [None] * len(plan.cells)
        for at, link in pictures:
            weights[at + 1] += 1
            values[plan.cells[at]] = link
        values += ["".join(join(values)) for join in plan.joins]
        values.append(None)
        for column, pick in zip(self.texts, plan.texts, strict=True):
            column += pick(values)
        for column, part in zip(self.rest, plan.rest, strict=True):
            column += part
        before = [*accumulate(weights)]
        for column, (elements, pick) in ((self.heads, plan.heads), (self.ats, plan.ats)):
            column += map(add, elements, pick(before))
        return True

    def batch(self, ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
        texts = {k: c if k in LINKS else [*map(_squashed, c)] for k, c in zip(TEXTS, self.texts, strict=True)}
        rest = dict(zip(REST, self.rest, strict=True))
        type_of = {f.name: f.type for f in schema}

        def struct(kind: pa.StructType, columns: list) -> pa.Array:
            return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=[*kind])

        def lists(kind: pa.ListType, sizes: list[int], columns: list) -> pa.Array:
            values = struct(kind.value_type, columns) if pa.types.is_struct(kind.value_type) else pa.array(*columns, kind.value_type)
            return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values, type=kind)

        group = type_of["groups"].value_type
        members = lists(group.field("members").type, rest["members"], [self.ats, *[texts[k] for k in TEXTS[9:]], rest["in_order"]])
        columns = {
            "id": ids, "layout": rest["layout"], "boxed": rest["boxed"], **{k: texts[k] for k in TEXTS[:4]}, "labels": lists(type_of["labels"], rest["labels"], [texts["label"], texts["value"]]),
            "bolds": lists(type_of["bolds"], rest["bolds"], [texts["bold"]]), "groups": lists(type_of["groups"], rest["groups"], [self.heads, texts["heading"], rest["listed"], texts["tally"], members]),
        }
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((columns[f.name], f) for f in schema)], schema=schema)


def _read(pages: DataFrame, rows_of: Callable[[object], Iterable[Sequence]]) -> DataFrame:
    """Fields of each page (id, page); ``rows_of`` gives a page's elements in order. A page without any is left out."""
    schema = T.StructType([T.StructField("id", pages.schema["id"].dataType), *T.StructType.fromDDL(PAGE_FIELDS).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                fields = _Fields()
                there = [fields.add(page, rows_of) for page in part["page"].to_pylist()]
                yield fields.batch(part["id"].filter(pa.array(there)).cast(arrow.field(0).type), arrow)

    return pages.mapInArrow(run, schema)


def roll_calls_of_pages(pages: DataFrame, *, id_col: str, html_col: str) -> RollCalls:
    """``roll_calls`` of landed pages: each is cut and read where it is, without its elements being written or shuffled."""
    return _told(_read(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("page")), elements_of))


def roll_calls(nodes: DataFrame) -> RollCalls:
    """Calls, groups and votes of the pages in ``nodes`` (see ``elements``), and the pages refused.

    A page is refused for the first of ``REASONS`` that holds: the date, title
    or totals are not there; a group's heading or tally can't be read; its list
    is not the next element; a vote is none of the three, or two; a group's
    size is not the number of its votes; or there are no groups. Pages with a
    standing vote are told apart in ``standing`` and refused too. A page
    without elements is in no table. Everything is told within a page's row.
    """
    whole = F.sort_array(F.collect_list(F.struct("at", "stop", "parent", "next", "tag", "cls", "key", "link", "text")))
    return _told(_read(nodes.groupBy("id").agg(whole.alias("page")), lambda page: [tuple(row.values()) for row in page]))


def _told(read: DataFrame) -> RollCalls:
    judged = _judged(read)
    taken = judged.where("reason IS NULL")
    head = ["id", "layout", "date", "title", "total", "yes", "no"]
    groups = taken.select(*head[:5], F.explode("groups").alias("g")).select("id", "date", "title", F.col("total").alias("voted"), "g.at", "g.group", "g.size", "g.yes", "g.no", "g.members")
    return RollCalls(
        taken.select(*head), groups.drop("members"), groups.select("id", "group", F.explode("members").alias("m")).select("id", "m.at", "group", "m.name", "m.value"),
        judged.where("reason IS NOT NULL").select("id", "reason", "note"), judged.where("note IS NOT NULL").select("id", "note"),
    )
