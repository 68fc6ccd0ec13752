import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rollbook.sources import pages, rollcalls
from rollbook.sources.elements import MANY, _Open, _Scan, elements, elements_of, is_a, pieces_of, texts

BOX = "<html><body><div id=\"ContentsBox\">{}</div></body></html>"
HEAD = '<h2 class="kaiji_nichiji">第221回国会<br>2026年 6月 5日<br>投票結果</h2>'
MATTER = '<dl class="ankenmei"><dt>案件名：</dt><dd>日程第１　 試験案件</dd></dl>'
TOTALS = '<h3 class="tohyosousu">投票総数　2<br><span>賛成票　1　　　反対票　1</span></h3>'


def li(value, name):
    if value == "投票なし":
        return f'<li class="giin"><span class="novote"><span class="fhalf">投票</span>\n<span class="shalf">なし</span></span><span class="names">{name}</span></li>'
    return f'<li class="giin"><span class="pros">{"賛成" if value == "賛成" else ""}</span><span class="cons">{"反対" if value == "反対" else ""}</span><span class="names">{name}</span></li>'


def group(name, size, yes, no, items):
    return f'<h4 class="party">{name}( {size}名)</h4>\n<dl class="sanpilist"><dt class="party">賛成票 {yes} 反対票 {no}</dt><dd><ul>{items}</ul></dd></dl>'


def old(name, size, rows, tally="賛成票 1 <br>反対票 1"):
    return f'<TABLE><CAPTION class="party">{name}（{size}名）<BR>{tally}</CAPTION><TR><TH>賛成<TH>反対<TH>氏名{rows}</TABLE>'


def cells(pro, con, name):
    return f'<TD class="pro">{pro}<TD class="con">{con}</TD><TD class="nam">{name}'


YES, NO = '<IMG src="/img/sansei.jpg">', '<img src="x/HANTAI.jpg">'
TWO = li("賛成", "青木　　一彦") + li("反対", "蓮舫")
OLD_HEAD = "<style >b{}</STYLE><TT>第200回国会<BR>2019年 12月 6日<BR>投票結果</TT><TABLE><TR><TH>案件名：<TD>日程　第１</TABLE><B>投票総数 2 賛成票 1 反対票 1</B>"
PAGES = {
    "new": HEAD + MATTER + TOTALS + group("甲・乙", 3, 1, 1, TWO + li("投票なし", "阿達 　 雅志")) + group("丙", 1, 0, 0, li("投票なし", "三原じゅん子")),
    "old": OLD_HEAD + old("立憲", 3, "<TR>" + cells(YES, "", "足立　　敏之") + cells("　", NO, "蓮舫") + cells("", "", "") + "<TR>" + cells("", " ", "こやり 隆史") + "<TD>余<TR><TD><TD><TD>"),
    "no date": MATTER + TOTALS + group("甲", 2, 1, 1, TWO),
    "no title": HEAD + TOTALS + group("甲", 2, 1, 1, TWO),
    "no totals": HEAD + MATTER + group("甲", 2, 1, 1, TWO),
    "heading unreadable": HEAD + MATTER + TOTALS + '<h4 class="party">甲</h4><dl class="sanpilist"><dt>賛成票 1 反対票 1</dt></dl>',
    "no list of votes": HEAD + MATTER + TOTALS + '<h4 class="party">甲(2名)</h4><p>x</p><dl class="sanpilist"><dt>賛成票 1 反対票 1</dt></dl>',
    "tally unreadable": HEAD + MATTER + TOTALS + group("甲", 2, "", 1, TWO),
    "cells out of order": OLD_HEAD + old("甲", 1, "<TR><TD class=con><TD class=pro><TD class=nam>x"),
    "vote unreadable": HEAD + MATTER + TOTALS + group("甲", 1, 0, 0, li("", "誰か")),
    "size differs": HEAD + MATTER + TOTALS + group("甲", 3, 1, 1, TWO),
    "no groups": HEAD + MATTER + TOTALS,
}


@pytest.fixture(scope="module")
def found(spark):
    made = [(k, BOX.format(v)) for k, v in PAGES.items()] + [
        ("old both", BOX.format(OLD_HEAD + old("甲", 1, "<TR>" + cells(YES, NO, "x")))), ("old no", BOX.format(OLD_HEAD + old("甲", 2, "<TR>" + cells(YES, "", "x")))),
        ("kiritsu", BOX.format(HEAD + "<p class=kiritsu>起立採決により<br> 可決されました")), ("bold", BOX.format("<B>議題</B><B>起立採決により　可決")), ("outside", "<b>起立採決</b>"), ("null", None), ("empty", ""),
        ("unboxed", HEAD + MATTER + TOTALS + group("甲", 2, 1, 1, TWO)),
    ]
    nodes = elements(spark.createDataFrame(made, "page string, html string"), id_col="page", html_col="html").cache()
    return rollcalls.roll_calls(nodes)


def test_votes_of_both_layouts(found):
    votes = sorted((r.id, r.at, r.group, r.name, r.value) for r in found.votes.collect())
    bare = [(i, g, n, v) for i, _, g, n, v in votes]
    assert bare[:4] == [("new", "甲・乙", "青木 一彦", "賛成"), ("new", "甲・乙", "蓮舫", "反対"), ("new", "甲・乙", "阿達 雅志", "投票なし"), ("new", "丙", "三原じゅん子", "投票なし")]
    assert bare[4:7] == [("old", "立憲", "足立 敏之", "賛成"), ("old", "立憲", "蓮舫", "反対"), ("old", "立憲", "こやり 隆史", "投票なし")]
    assert [b[0] for b in bare[7:]] == ["unboxed"] * 2
    assert {(r.id, r.group, r["size"], r.yes, r.no) for r in found.groups.collect()} >= {("new", "甲・乙", 3, 1, 1), ("new", "丙", 1, 0, 0), ("old", "立憲", 3, 1, 1)}
    calls = {r.id: (r.layout, r.date, r.title, r.total, r.yes, r.no) for r in found.calls.collect()}
    assert calls == {"new": ("new", "2026-06-05", "日程第１　試験案件", 2, 1, 1), "old": ("old", "2019-12-06", "日程　第１", 2, 1, 1), "unboxed": ("new", "2026-06-05", "日程第１　試験案件", 2, 1, 1)}


def test_refused_with_the_first_reason(found):
    refused = {r.id: r.reason for r in found.refused.collect()}
    assert {k: v for k, v in refused.items() if k in PAGES} == {k: k for k in PAGES if k not in ("new", "old")}
    assert refused["old both"] == "vote unreadable" and refused["old no"] == "size differs"
    assert refused["kiritsu"] == "no title" and refused["bold"] == "no date" and "null" not in refused and "empty" not in refused


def test_standing_votes(found):
    assert {(r.id, r.note) for r in found.standing.collect()} == {("kiritsu", "起立採決により 可決されました"), ("bold", "起立採決により 可決")}


def test_cells_left_open_and_tables_in_cells():
    cell = lambda *x: ("cell", *x, None)
    assert pages.parts_of("<td>a<td>b<tr><td>c") == [cell(-1, -1, 0, "a"), cell(-1, -1, 1, "b"), cell(-1, 0, 0, "c")]
    got = pages.parts_of("<table><tr><td>a<table><tr><th>x<td>y</table>b<td>c<tbody><tr><td>d</td></tr></table><a href=q>l<a href=r>m")
    assert got[:5] == [cell(0, 0, 0, "axyb"), cell(1, 0, 0, "x"), cell(1, 0, 1, "y"), cell(0, 0, 1, "c"), cell(0, 1, 0, "d")]
    assert [p[4:] for p in got[5:]] == [("l", "q"), ("m", "r")]
    assert pages.parts_of(None) == pages.parts_of("<script>x<td></script>") == []


@pytest.mark.parametrize("shape", ["<a>", "<td>", "<table><tr><td>", "<ul>", "<li>", "<p>", "</b>", "<b></i>", "<dl><dt>", "<ul><td>", "<span class=x>"])
def test_hostile_pages_take_linear_time(shape):
    def took(n):
        began = time.perf_counter()
        elements_of(shape * n)
        return time.perf_counter() - began

    took(100)
    assert took(16000) < max(1.0, 12 * took(4000))


def test_lists_in_lists_and_void_elements(spark):
    page = "<ul><li>a<ul><li>b</ul>c<li>d<img src=z>e<br>f</ul><p>x<p>y<h2>h<h3>i</h3>"
    nodes = elements(spark.createDataFrame([(1, page)], "id int, html string"), id_col="id", html_col="html")
    assert [r.text for r in texts(nodes, {"p": is_a("p")}).orderBy("at").collect()] == ["x", "y"]
    outer = nodes.where(is_a("li")).orderBy("at").select("at", "stop").collect()
    assert outer[0].stop > outer[1].stop and outer[2].at == outer[0].stop
    assert nodes.where(F.col("link") == "z").count() == 1


def by_library(page):
    scan = _Scan()
    scan.feed(page)
    scan.close()
    scan.close_to(0)
    return scan.rows


def test_pages_cut_by_pattern_read_as_by_the_library():
    draw = random.Random(3)
    bits = ["<td class='a  b'>", "</td >", "<TR>", "<table>", "</table>", "<p>", "<li>", "<ul>", "</ul>", "a", "x & y", "&lt", "<a href='q?a=1&amp;b=2'>", "<img src=x/>", "<br/>", "<style>", "</style>", "<script>", "</script>", "<title>", "</title>",
            "<!-- <b> -->", "<!-->", "<!doctype html>", "<", "<a b=\"c>d\">", "<h2>", "<a b c=1 C=2>", "<x-y>", "&#65;"]
    made = ["".join(draw.choices(bits, k=draw.randint(1, 9))) for _ in range(5000)]
    assert all(elements_of(p) == by_library(p) for p in made)
    assert 500 < sum(pieces_of(p) is not None for p in made) < 5000


def test_pages_are_read_in_place(spark):
    """Neither elements nor fields are shuffled or written: a page's answers come from its own row."""
    made = spark.createDataFrame([(k, BOX.format(v)) for k, v in PAGES.items()], "page string, html string")
    got = rollcalls.roll_calls_of_pages(made, id_col="page", html_col="html")
    for df in (got.calls, got.groups, got.votes, got.refused, got.standing):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    by_nodes = rollcalls.roll_calls(elements(made, id_col="page", html_col="html"))
    for one, other in ((got.votes, by_nodes.votes), (got.groups, by_nodes.groups), (got.refused, by_nodes.refused)):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def fields(page, one_by_one):
    read = rollcalls._Fields()
    there = read.add(page, (lambda p: elements_of(p)) if one_by_one else elements_of)
    return there, read.texts, read.rest, read.heads, read.ats


def cut_at_tags(page):
    return re.findall(r"<[^<>]*>|[^<]+", page)


def test_pages_of_one_shape_are_read_by_one_plan():
    draw = random.Random(5)
    cell = lambda: draw.choice([cells(YES, "", "a"), cells("", NO, f"b{draw.random()}"), cells("　", "", "&amp;"), cells("", "", "")])
    made = [BOX.format(OLD_HEAD + old(f"甲{i}", 4, "<TR>" + "".join(cell() for _ in range(4)))) for i in range(300)]
    made += [BOX.format(HEAD + MATTER + TOTALS + group("乙", i, i, i, "".join(li(draw.choice(["賛成", "反対", ""]), str(i)) for _ in range(3)))) for i in range(300)]
    rollcalls._plan.cache_clear()
    got = [fields(p, False) for p in made]
    assert rollcalls._plan.cache_info().misses == 2
    assert got == [fields(p, True) for p in made]


def test_plans_tell_the_same_as_pages_read_one_by_one():
    draw = random.Random(11)
    whole = [BOX.format(v) for v in PAGES.values()] + [*PAGES.values()]
    bits = sorted({b for p in whole for b in cut_at_tags(p)}) + ["<IMG src=a>", "<img src=b>", "<img class=pros src=c>", "<td><img src=q>", "<td><img>", "x&amp;y", "<style>&</style>", "<!-- <b> -->", "<Img src=z>", "<img src=z id=ContentsBox>", "<div id=ContentsBox>", "<", ">"]
    made = [None, "", "a", "<!-- x -->"]
    for _ in range(4000):
        page = cut_at_tags(draw.choice(whole)) if draw.random() < 0.7 else draw.choices(bits, k=draw.randint(1, 30))
        for _ in range(draw.randint(0, 4)):
            i = draw.randrange(len(page) + 1)
            page[i : i + draw.randint(0, 1)] = draw.choices(bits, k=draw.randint(0, 2))
        made.append("".join(page))
    assert all(fields(p, False) == fields(p, True) for p in made)


def test_counts_too_long_for_a_number_are_refused(spark):
    made = [("tally", HEAD + MATTER + TOTALS + group("甲", 2, "9" * 12, 1, TWO)), ("size", HEAD + MATTER + TOTALS + group("甲", "9" * 12, 1, 1, TWO))]
    got = rollcalls.roll_calls_of_pages(spark.createDataFrame(made, "page string, html string"), id_col="page", html_col="html")
    assert {(r.id, r.reason) for r in got.refused.collect()} == {("tally", "tally unreadable"), ("size", "heading unreadable")}


def test_rules_are_remembered_within_bounds():
    page = "".join(f"<x{i}>" for i in range(60)) + "t"
    assert elements_of(page) == by_library(page)
    assert elements_of("<b>" * 3000) == by_library("<b>" * 3000)
    for i in range(30):
        elements_of("".join(f"<y{i}z{j}></y{i}z{j}>" for j in range(800)))
    assert _Open.told <= MANY + 2000 and len(_Open.known) <= MANY + 2000


def test_parts_are_told_by_shape():
    lines = lambda *xs: "<table>" + "".join(f"<tr><td>{x}<td> <a href='/s/{x}'>s{x}&amp;</a><br>x" for x in xs) + "</table>"
    pages._plan.cache_clear()
    got = [pages.parts_of(lines(i, i + 1)) for i in range(200)]
    assert pages._plan.cache_info().misses == 1
    assert got == [pages._parts(elements_of(lines(i, i + 1))) for i in range(200)]
    draw = random.Random(7)
    bits = ["<td>", "</td>", "<tr>", "<table>", "</table>", "<a href=q>", "<a>", "</a>", "<br>", "<h1>", "<h2>", "<title>t</title>", "<title>&amp;</title>", "a", "&lt;b", "<!-- <td> -->", "<", ">", "<th>", "<script>x<td></script>"]
    made = ["".join(draw.choices(bits, k=draw.randint(0, 12))) for _ in range(4000)]
    assert all(pages.parts_of(p) == pages._parts(elements_of(p)) for p in made)
