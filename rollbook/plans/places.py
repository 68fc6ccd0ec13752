"""Units of districts, postal codes, readings and speeches made of parts, lines and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import bills
from rollbook.operators import districts, records
from rollbook.plans.rollcalls import _put
from rollbook.session import table
from rollbook.sources import minutes

LATIN, KANA = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A municipality for each part, and the unit that names it: whole, without its county, with a letter that could not be read, by its end, or by the name it had."""
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    number, first, last = key.cast("string"), F.get(words, F.lit(0)), F.element_at(words, -1)
    city = F.when(key % 2 == 0, _put(F.replace("p_name", F.lit(" "), F.lit("")), number, "市")).otherwise(_put(first, "郡", last, number, "町"))
    parts = table(spark, sf_dir, "part").select(key.alias("code"), _put(F.col("p_size").cast("string"), "県").alias("pref"), city.alias("city"), last.alias("last"))
    former = _put("旧", F.col("code").cast("string"), "村")
    kind = F.col("code") % 4
    unit = F.when(F.col("code") % 10 == 7, former).when(kind == 0, F.col("city")).when(kind == 1, _put(F.col("last"), F.col("code").cast("string"), "町")).when(kind == 2, _put("〓", F.substr("city", F.lit(2)))).otherwise(_put(F.col("code").cast("string"), "町"))
    units = parts.select("pref", (F.col("code") % 5 + 1).alias("number"), unit.alias("unit"), (F.col("code") % 6 == 0).alias("partial"))
    renames = parts.where("code % 10 = 7").select("pref", former.alias("former"), F.col("city").alias("name"), F.lit(None).cast("boolean").alias("partial"))
    munis = parts.select("code", "pref", "city")
    return munis, districts.match_units(units, munis, renames)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[1].select("pref", "number", "unit", "code", "tier", "hits", "partial")


def _zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A postal code for each supplier, over the municipalities of the parts it delivers."""
    munis, matched = _matched(spark, sf_dir)
    postal = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zip"), F.col("l_partkey").alias("code"))
    found = districts.districts_by_zip(postal, districts.municipality_districts(munis, matched))
    return found.select("zip", F.array_join("districts", ",").alias("districts"), F.array_join("municipalities", ",").alias("municipalities"))


def _kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as readings, every third in katakana, in Japanese order."""
    hira = F.translate(F.replace("p_name", F.lit(" "), F.lit("")), LATIN, KANA)
    kata = F.translate(hira, KANA, "".join(chr(ord(c) + 0x60) for c in KANA))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, kata).otherwise(hira).alias("kana"))
    return records.kana_groups(parts, kana="kana", tie="p_partkey").select("p_partkey", "row", "head", "place")


def _speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as landed pages of minutes, read back as speeches: their first turn is the meeting's header."""
    speech = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("speechID"), F.col("conv_id").alias("session"), F.when(F.col("conv_id") % 2 == 0, "参議院").otherwise("衆議院").alias("nameOfHouse"), F.lit("会").alias("nameOfMeeting"), F.lit("2020-01-01").alias("date"),
        F.col("turn").alias("speechOrder"), F.col("role").alias("speaker"), F.when(F.col("role") == "user", "").otherwise("派").alias("speakerGroup"), _put("○", F.col("role"), "　　", F.col("text")).alias("speech"), F.lit("u").alias("speechURL"))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.count("*").alias("numberOfRecords"), F.collect_list(speech).alias("speechRecord"))).alias("value"))
    return minutes.speeches(minutes.records(pages)).select("id", "session", "house", "speaker_text", "group", "excerpt", "chars")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    munis, matched = _matched(spark, sf_dir)
    postal = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zip"), F.col("l_partkey").alias("code"))
    return districts.districts_meta(postal, districts.municipality_districts(munis, matched))


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bills: categories by their number, results written and read back, dates in full-width figures."""
    key = F.col("o_orderkey")
    category = F.element_at(F.array(*[F.lit(x) for x in ("法律案（内閣提出）", "法律案（参法）", "法律案（衆法）（参法）", "予算（一般）", "条約", "国会の承認（甲）", "決算", "決議案（衆法")]), (key % 8 + 1).cast("int"))
    result = records.result_text(F.when(key % 3 == 0, "可決（修正）").when(key % 3 == 1, ""), key % 300, F.col("o_custkey") % 200)
    parts = bills.result_parts(F.when(key % 11 == 4, F.concat(result, F.lit("。"))).otherwise(result))
    digits = lambda c: F.translate(c.cast("string"), "0123456789", "０１２３４５６７８９")
    effective = bills.effective_date(_put("内閣は平成 ", F.when(F.year("o_orderdate") % 7 == 0, "元").otherwise(digits(F.year("o_orderdate") - 1988)), "年", digits(F.month("o_orderdate")), "月 ", digits(F.day("o_orderdate")), "日発足"))
    return table(spark, sf_dir, "orders").select("o_orderkey", bills.bill_kind(category).alias("kind"), parts["decision"].alias("decision"), parts["yes"].alias("yes"), parts["no"].alias("no"), effective["date"].alias("since"), effective["text"].alias("since_text"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names in name cells, some with a letter that no name has, some in conflict, some with a legal name behind a line break."""
    kanji = F.translate(F.col("c_custkey").cast("string"), "0123456789", "一二三四五六七八九十")
    name = _put(kanji, F.when(F.col("c_custkey") % 7 == 2, "□x□").when(F.col("c_custkey") % 7 == 4, "髙　ー々").otherwise("　子"))
    cell = bills.name_and_legal(_put(name, F.when(F.col("c_custkey") % 5 == 0, _put("\n［ ", kanji, "本名 ］")).when(F.col("c_custkey") % 5 == 1, "\n本名").otherwise("")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", cell["name"].alias("name"), cell["legal"].alias("legal"))
    return rows.withColumns({"broken": F.array_join(bills.broken_letters(F.col("name")), ""), "reason": bills.unmatched_reason(F.col("name"), F.col("c_custkey") % 3 == 0)})


UNITS = """
w AS (SELECT p_partkey AS code, p_size || '県' AS pref, string_split(p_name, ' ') AS x, replace(p_name, ' ', '') AS bare FROM part),
m AS (SELECT code, pref, x[-1] AS last, CASE WHEN code % 2 = 0 THEN bare || code || '市' ELSE x[1] || '郡' || x[-1] || code || '町' END AS city FROM w),
u AS (SELECT code AS own, pref, code % 5 + 1 AS number, CASE WHEN code % 10 = 7 THEN '旧' || code || '村' WHEN code % 4 = 0 THEN city WHEN code % 4 = 1 THEN last || code || '町' WHEN code % 4 = 2 THEN '〓' || substr(city, 2) ELSE code || '町' END AS unit, code % 6 = 0 AS partial, city FROM m),
t AS (SELECT u.pref, number, unit, partial, m.code, CASE WHEN m.city LIKE replace(unit, '〓', '_') THEN 1 WHEN regexp_matches(unit, '[町村]$') AND regexp_replace(m.city, '^.*?郡', '') LIKE replace(unit, '〓', '_') THEN 3 WHEN m.city LIKE '%' || replace(unit, '〓', '_') THEN 4 END AS tier FROM u JOIN m ON u.pref = m.pref
  UNION ALL SELECT u.pref, number, unit, partial, m.code, 2 FROM u JOIN m ON u.pref = m.pref AND u.city = m.city WHERE u.own % 10 = 7),
b AS (SELECT *, min(tier) OVER (PARTITION BY pref, number, unit) AS best FROM t WHERE tier IS NOT NULL),
matched AS (SELECT pref, number, unit, code, tier, count(*) OVER (PARTITION BY pref, number, unit) AS hits, partial FROM b WHERE tier = best)
"""

QUERIES = {
    "units_matched": (_units, f"WITH {UNITS} SELECT * FROM matched"),
    "districts_of_zip": (_zips, f"""WITH {UNITS}, good AS (SELECT DISTINCT code, number FROM matched WHERE hits = 1 OR tier = 2), z AS (SELECT DISTINCT l_suppkey AS zip, l_partkey AS code FROM lineitem),
      d AS (SELECT DISTINCT zip, pref, number, m.code, city FROM z JOIN good USING (code) JOIN m USING (code))
      SELECT zip, (SELECT string_agg(replace(pref, '県', '') || number, ',' ORDER BY replace(pref, '県', ''), number) FROM (SELECT DISTINCT pref, number FROM d e WHERE e.zip = d.zip)) AS districts,
        (SELECT string_agg(pref || city, ',' ORDER BY code) FROM (SELECT DISTINCT pref, city, code FROM d e WHERE e.zip = d.zip)) AS municipalities FROM d GROUP BY zip"""),
    "districts_meta": (_meta, f"""WITH {UNITS}, good AS (SELECT DISTINCT code, number FROM matched WHERE hits = 1 OR tier = 2)
      SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS zips, (SELECT count(*) FROM m) AS municipalities, (SELECT count(*) FROM (SELECT code FROM good GROUP BY 1 HAVING count(*) > 1)) AS split_municipalities, (SELECT count(*) FROM (SELECT DISTINCT pref, number FROM good JOIN m USING (code))) AS districts"""),
    "bill_fields": (_bills, """WITH o AS (SELECT *, o_orderkey % 11 = 4 AS odd, (['閣法', '参法', '衆法', '予算', '条約', '承認', 'その他', '決議'])[1 + o_orderkey % 8] AS kind, translate(CAST(month(o_orderdate) AS varchar), '0123456789', '０１２３４５６７８９') AS m, translate(CAST(day(o_orderdate) AS varchar), '0123456789', '０１２３４５６７８９') AS d FROM orders)
      SELECT o_orderkey, kind, CASE WHEN NOT odd AND o_orderkey % 3 = 0 THEN '可決（修正）' END AS decision, CASE WHEN NOT odd THEN o_orderkey % 300 END AS yes, CASE WHEN NOT odd THEN o_custkey % 200 END AS no,
        CASE WHEN year(o_orderdate) % 7 = 0 THEN '1989' ELSE CAST(year(o_orderdate) AS varchar) END || strftime(o_orderdate, '-%m-%d') AS since,
        '平成 ' || CASE WHEN year(o_orderdate) % 7 = 0 THEN '元' ELSE translate(CAST(year(o_orderdate) - 1988 AS varchar), '0123456789', '０１２３４５６７８９') END || '年' || m || '月 ' || d || '日発足' AS since_text FROM o"""),
    "name_cells": (_names, """WITH k AS (SELECT *, translate(CAST(c_custkey AS varchar), '0123456789', '一二三四五六七八九十') AS kanji FROM customer)
      SELECT c_custkey, kanji || CASE c_custkey % 7 WHEN 2 THEN '□x□' WHEN 4 THEN '髙 ー々' ELSE ' 子' END AS name, CASE WHEN c_custkey % 5 = 0 THEN kanji || '本名' END AS legal, CASE WHEN c_custkey % 7 = 2 THEN '□x' ELSE '' END AS broken,
        CASE WHEN c_custkey % 7 = 2 THEN 'brokenGlyph' WHEN c_custkey % 3 = 0 THEN 'sourceConflict' END AS reason FROM k"""),
    "kana_groups": (_kana, f"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '') AS bare FROM part)
      SELECT p_partkey, CASE WHEN bare[1] BETWEEN 'a' AND 'e' THEN 'あ' WHEN bare[1] BETWEEN 'f' AND 'j' THEN 'か' WHEN bare[1] BETWEEN 'k' AND 'o' THEN 'さ' WHEN bare[1] BETWEEN 'p' AND 't' THEN 'た' WHEN bare[1] BETWEEN 'u' AND 'y' THEN 'な' ELSE 'は' END AS row,
        translate(substr(bare, 1, 2), '{LATIN}', '{KANA}') AS head, CAST(row_number() OVER (PARTITION BY substr(bare, 1, 2) ORDER BY bare, p_partkey) AS integer) AS place FROM n"""),
    "speeches_of_minutes": (_speeches, """WITH b AS (SELECT *, trim(regexp_replace(text, '[\\s\\x0b\\x{00a0}\\x{3000}\\x{feff}]+', ' ', 'g')) AS body FROM conversations WHERE turn <> 0)
      SELECT conv_id || '-' || turn AS id, conv_id AS session, CASE WHEN conv_id % 2 = 0 THEN 'sangiin' ELSE 'shugiin' END AS house, role AS speaker_text, CASE WHEN role <> 'user' THEN '派' END AS "group", substr(body, 1, 200) AS excerpt, length(body) AS chars FROM b"""),
}
