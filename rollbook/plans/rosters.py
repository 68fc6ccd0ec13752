"""Headers of minutes and district texts made of orders and their lines, read back by running states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import districts
from rollbook.plans.rollcalls import _orders, _party, _put
from rollbook.session import table
from rollbook.sources import minutes, rosters

W = "　"


def _list(lines: Column, put: Callable[[Column, Column], Column], glue: str = "\n", where: Callable[[Column], Column] | None = None) -> Column:
    """Lines (with their places from 1) put into words and together; ``where`` asks for places."""
    placed = F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n")))
    rows = placed if where is None else F.filter(placed, lambda p: where(p["n"]))
    return F.array_join(F.transform(rows, lambda p: put(p["x"], p["n"])), glue)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting for each order, its members the suppliers of its lines: two a line in even orders, one a line under headings in odd ones. The first line is led by the chair, the second by a director."""
    name = lambda x: _put("S", x["l_suppkey"].cast("string"), W, "君子", x["l_partkey"].cast("string"))
    two = lambda x, n: _put(F.when(n % 2 == 1, "\n" + W * 2).otherwise(W * 3), F.when(n == 1, "委員長").when(n == 2, "理事").otherwise(""), F.when(n == 1, W).otherwise(""), name(x), "君")
    one = lambda x, n: F.when(n == 1, _put(W * 4, "委員長", W * 9, name(x), "君")).otherwise(_put(W * 15, name(x), "君"))
    lead = lambda x, n: _put(F.when(n == 1, W * 7).otherwise(W * 2), "発議者", W * 3, name(x), "君")
    rows = F.col("lines")
    even = _put("会議\n", W, "出席委員", _list(rows, two, ""), "\n", W * 4, "…………\n委員の異動\n", W * 2, "外　君")
    odd = _put(
        "君\n", W * 3, "出席者は左のとおり。\n", _list(rows, one, where=lambda n: n == 1), "\n", W * 4, "理　事\n", _list(rows, one, where=lambda n: n == 2), "\n", W * 4, "──────\n", W * 7, "議長　外君\n", W * 4, "委　員\n", _list(rows, one, where=lambda n: n > 2),
        "\n", W * 3, "衆議院議員\n", W * 15, "外　君\n", _list(rows, lead, where=lambda n: n == 2), "\n", W * 3, "委員以外の議員\n", _list(rows, lead, where=lambda n: n != 2), "\n", W * 2, "本日の会議に付した案件\n○", F.lit("議案"), "（参第", F.translate((F.col("l_orderkey") % 97).cast("string"), "0123456789", "〇一二三四五六七八九"), "号）\n", W * 15, "外　君",
    )
    text = _orders(spark, sf_dir).select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, even).otherwise(odd).alias("speech"))
    header = text.select(F.col("l_orderkey").cast("string").alias("speechID"), F.lit(1).alias("session"), F.when(F.col("l_orderkey") % 2 == 0, "衆議院").otherwise("参議院").alias("nameOfHouse"), F.lit("会").alias("nameOfMeeting"), F.lit("2020-01-01").alias("date"), F.lit(0).alias("speechOrder"), "speech")
    return minutes.headers(header)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rosters.rosters(_lines(spark, sf_dir)).select(F.col("id").cast("long").alias("l_orderkey"), "role", "name")


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rosters.agendas(_lines(spark, sf_dir)).select("id", "bills", F.explode("people").alias("p")).select("id", "p.name", F.explode("bills").alias("b"))
    return both.select(F.col("id").cast("long").alias("l_orderkey"), "name", "b.number", "b.title")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefecture for each order, its districts its suppliers' groups, its units the lines; some texts skip a number, leave a bracket open, or bear another name."""
    unit = lambda x, n: _put("S", x["l_suppkey"].cast("string"), F.when(n % 3 == 0, _put("（P", x["l_partkey"].cast("string"), "、第１区に（属し）ない\n区域）")).when(x["l_partkey"] % 5 == 0, "(の一部)").otherwise(""))
    rows = _orders(spark, sf_dir).select("l_orderkey", F.transform("lines", lambda x, i: F.struct(_party(x).alias("party"), unit(x, i + 1).alias("unit"))).alias("units"))
    number = lambda i: F.translate((i + F.when((F.col("l_orderkey") % 11 == 4) & (i > 0), 2).otherwise(1)).cast("string"), "0123456789", "０１２３４５６７８９")
    parties = F.array_sort(F.array_distinct(F.transform("units", lambda u: u["party"])))
    units = lambda party: F.array_join(F.transform(F.filter("units", lambda u: u["party"] == party), lambda u: u["unit"]), "、")
    body = F.array_join(F.transform(parties, lambda party, i: F.concat(F.lit("\n第"), number(i), F.lit("区\n"), units(party))), "")
    text = rows.select("l_orderkey", _put(F.when(F.col("l_orderkey") % 13 == 6, "別").otherwise(""), "県", F.col("l_orderkey").cast("string"), body, F.when(F.col("l_orderkey") % 7 == 2, "（").otherwise("")).alias("text"))
    return text.select(_put("県", F.col("l_orderkey").cast("string")).alias("pref"), "text")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, _ = districts.district_sections(_texts(spark, sf_dir))
    return units.select("pref", "number", "place", "unit", "area")


def _no_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.district_sections(_texts(spark, sf_dir))[1]


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"
SECTIONS = f"""s AS (SELECT *, '県' || l_orderkey AS pref, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 4) AS number, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4 ORDER BY n) AS place FROM {NUMBERED}),
  j AS (SELECT *, CASE WHEN l_orderkey % 7 = 2 THEN 'brackets left open' WHEN l_orderkey % 13 = 6 THEN 'headed otherwise' WHEN l_orderkey % 11 = 4 AND max(number) OVER (PARTITION BY l_orderkey) > 1 THEN 'numbers not consecutive' END AS detail FROM s)"""

QUERIES = {
    "committee_rosters": (_members, f"""SELECT l_orderkey, CASE n WHEN 1 THEN '委員長' WHEN 2 THEN '理事' ELSE '委員' END AS role, 'S' || l_suppkey || '君子' || l_partkey AS name FROM {NUMBERED}"""),
    "proposers_and_bills": (_bills, f"""SELECT l_orderkey, 'S' || l_suppkey || '君子' || l_partkey AS name, l_orderkey % 97 AS number, '議案' AS title FROM {NUMBERED} WHERE l_orderkey % 2 = 1 AND n <> 2"""),
    "district_sections": (_sections, f"""WITH {SECTIONS} SELECT pref, CAST(number AS integer) AS number, CAST(place AS integer) AS place, 'S' || l_suppkey AS unit, CASE WHEN n % 3 = 0 THEN 'P' || l_partkey || '、第１区に（属し）ない区域' WHEN l_partkey % 5 = 0 THEN 'の一部' END AS area FROM j WHERE detail IS NULL"""),
    "district_texts_refused": (_no_sections, f"""WITH {SECTIONS} SELECT DISTINCT pref AS entity, detail FROM j WHERE detail IS NOT NULL"""),
}
