"""Roll-call pages made of orders and their lines, in both layouts, read back as votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.lattice import _let as let
from rollbook.session import table
from rollbook.sources import pages as html
from rollbook.sources import rollcalls


def _put(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _orders(spark: SparkSession, sf_dir: str, key: str = "l_orderkey") -> DataFrame:
    """A row for each order with its lines in their places: an array, as short as the lines are, of which texts are made without a shuffle of texts."""
    picked = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias(key)).agg(F.sort_array(F.collect_list(picked)).alias("lines"))


def _party(line: Column) -> Column:
    """The group of a line's supplier."""
    return _put("会", (line["l_suppkey"] % 4).cast("string"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: its suppliers' groups, a member for each line, A for, R against, N absent.

    Even orders have the old layout. Pages of low priority tell of a standing
    vote; some have a wrong size, no title or a vote that can't be read.
    """
    key = F.col("o_orderkey")
    orders = _orders(spark, sf_dir, "o_orderkey")
    many = lambda xs, flag: F.size(F.filter(xs, lambda x: x["l_returnflag"] == flag))
    old_layout = key % 2 == 0

    def member(x: Column, bad: Column) -> Column:
        name = _put("S", x["l_suppkey"].cast("string"), "　 \n", "P", x["l_partkey"].cast("string"))
        is_ = lambda flag: x["l_returnflag"] == flag
        new = _put(
            "\n<li class='giin x'><SPAN class=pros>", F.when(is_("A") | bad, "賛成").otherwise(""), "</SPAN><span class=cons>", F.when(is_("R") | bad, "反対").otherwise(""), "</span>",
            F.when(is_("N") & ~bad, "<span class=novote><span>投票</span> <span>なし</span></span>").otherwise(""), "<span class=names>", name, "</span>",
        )
        old = _put("<TD class=pro>", F.when(is_("A") | bad, "<IMG src=/img/sansei.jpg>").otherwise("　"), "<TD class=con>", F.when(is_("R") | bad, "<IMG src=/img/hantai.jpg>").otherwise(""), "</TD><TD class='nam'>", name)
        return F.when(old_layout, old).otherwise(new)

    def block(party: Column, own: Column) -> Column:
        size = (F.size(own) + F.when(key % 13 == 5, 1).otherwise(0)).cast("string")
        yes, no = (many(own, flag).cast("string") for flag in "AR")
        bodies = F.transform(own, lambda x: x["html"])
        new = _put("<h4 class=party>", party, "( ", size, "名)</h4>\n<dl class=sanpilist><dt>賛成票　", yes, "　反対票 ", no, "<dd><ul>", F.array_join(bodies, ""), "</ul></dl>")
        rows = F.array_join(F.transform(bodies, lambda x, i: F.concat(F.when(i % 3 == 0, "<TR>").otherwise(""), x)), "")
        old = _put("<TABLE><CAPTION class=party>", party, "（", size, "名）<BR>賛成票 ", yes, " <BR>反対票　", no, "</CAPTION><TR><TH>賛成<TH>反対<TH>氏名", rows, "<TD class=pro><TD class=con><TD class=nam></TABLE>")
        return F.when(old_layout, old).otherwise(new)

    told = orders.withColumn("lines", F.transform("lines", lambda x, i: F.struct(_party(x).alias("party"), x["l_returnflag"].alias("l_returnflag"), member(x, (key % 19 == 7) & (i == 0)).alias("html"))))
    parties = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["party"])))
    bodies = told.select("o_orderkey", F.array_join(F.transform(parties, lambda p: let(F.filter("lines", lambda x: x["party"] == p), lambda own: block(p, own))), "").alias("body"), many("lines", "A").alias("yes"), many("lines", "R").alias("no"))
    pages = table(spark, sf_dir, "orders").join(bodies, "o_orderkey")
    day = F.date_format("o_orderdate", "yyyy年 M月 d日")
    title = F.when(F.col("o_orderkey") % 17 == 3, "").otherwise(_put("日程第１　 ", F.col("o_custkey").cast("string")))
    totals = _put("投票総数 ", (F.col("yes") + F.col("no")).cast("string"), "<br><span>賛成票　", F.col("yes").cast("string"), "　反対票　", F.col("no").cast("string"), "</span>")
    standing = F.col("o_orderpriority") == "5-LOW"
    page = F.when(standing & (F.col("o_orderkey") % 2 == 1), _put("<div id=ContentsBox><h2 class=kaiji_nichiji>", day, "</h2><p class=kiritsu>起立採決により<br>可決されました<p>以上</div>")).when(standing, _put("<b>投票結果</b><div id='ContentsBox'><TT>", day, "</TT><B>議題</B><B> 起立採決により 否決されました</div>")).when(
        F.col("o_orderkey") % 2 == 1,
        _put("<b>起立採決</b><div id=ContentsBox><!-- <h2> --><h2 class='kaiji_nichiji'>第1回国会<br>", day, "<br>投票結果</h2><dl class=ankenmei><dt>案件名：<dd>", title, "</dl><h3 class=tohyosousu>", totals, "</h3>", F.col("body"), "</div><h4 class=party>外</h4>"),
    ).otherwise(_put("<style >b{}</STYLE><div id=ContentsBox><TT>第1回国会<BR>", day, "<BR>投票結果</TT><TABLE><TR><TH>案件名：<TD>", title, "</TABLE><B>", totals, "</B>", F.col("body"), "</div>"))
    return pages.select("o_orderkey", page.alias("html"))


def _read(spark: SparkSession, sf_dir: str) -> rollcalls.RollCalls:
    return rollcalls.roll_calls_of_pages(_pages(spark, sf_dir), id_col="o_orderkey", html_col="html")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).votes.select(F.col("id").alias("o_orderkey"), "group", "name", "value")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).groups.select(F.col("id").alias("o_orderkey"), "date", "title", "voted", "group", "size", "yes", "no")


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).refused.select(F.col("id").alias("o_orderkey"), "reason", "note")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order, its cells left open; the last cell of each row holds a table of its own, with a link left open."""
    line = lambda x: _put("<tr><td>", x["l_partkey"].cast("string"), "<td> ", _party(x), " <td><table><tr><th>", x["l_returnflag"], "<td><a href='/s/", x["l_suppkey"].cast("string"), "'>s ", x["l_suppkey"].cast("string"), "</table>")
    pages = _orders(spark, sf_dir).select("l_orderkey", _put("<table>", F.array_join(F.transform("lines", line), ""), "</table>").alias("html"))
    parts = html.page_parts(pages, id_col="l_orderkey", html_col="html")
    return parts.select(F.col("id").alias("l_orderkey"), "kind", "tbl", "line", "cell", "text", "href")


ORDERS = """o AS (SELECT *, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 2 = 1 THEN 'no title' WHEN o_orderpriority = '5-LOW' THEN 'no date' WHEN o_orderkey % 17 = 3 THEN 'no title' WHEN o_orderkey % 19 = 7 THEN 'vote unreadable' WHEN o_orderkey % 13 = 5 THEN 'size differs' END AS reason
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""

QUERIES = {
    "roll_call_votes": (_votes, f"""WITH {ORDERS} SELECT o_orderkey, '会' || (l_suppkey % 4) AS "group", 'S' || l_suppkey || ' P' || l_partkey AS name, CASE l_returnflag WHEN 'A' THEN '賛成' WHEN 'R' THEN '反対' ELSE '投票なし' END AS value
      FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE reason IS NULL"""),
    "roll_call_groups": (_groups, f"""WITH {ORDERS}, g AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, '日程第１　' || o_custkey AS title, '会' || (l_suppkey % 4) AS "group", CAST(count(*) AS integer) AS size,
        CAST(count(*) FILTER (l_returnflag = 'A') AS integer) AS yes, CAST(count(*) FILTER (l_returnflag = 'R') AS integer) AS no FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE reason IS NULL GROUP BY ALL)
      SELECT *, CAST(sum(yes + no) OVER (PARTITION BY o_orderkey) AS integer) AS voted FROM g"""),
    "roll_call_refused": (_refused, f"""WITH {ORDERS} SELECT o_orderkey, reason, CASE WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderkey % 2 = 1 THEN '起立採決により可決されました' ELSE '起立採決により 否決されました' END END AS note FROM o WHERE reason IS NOT NULL"""),
    "page_cells": (_cells, """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r FROM lineitem)
      SELECT l_orderkey, 'cell' AS kind, 0 AS tbl, r AS line, 0 AS cell, CAST(l_partkey AS varchar) AS text, NULL AS href FROM l
      UNION ALL SELECT l_orderkey, 'cell', 0, r, 1, '会' || (l_suppkey % 4), NULL FROM l UNION ALL SELECT l_orderkey, 'cell', 0, r, 2, l_returnflag || 's ' || l_suppkey, NULL FROM l
      UNION ALL SELECT l_orderkey, 'cell', r + 1, 0, 0, l_returnflag, NULL FROM l UNION ALL SELECT l_orderkey, 'cell', r + 1, 0, 1, 's ' || l_suppkey, NULL FROM l
      UNION ALL SELECT l_orderkey, 'link', r + 1, 0, 1, 's ' || l_suppkey, '/s/' || l_suppkey FROM l"""),
}
