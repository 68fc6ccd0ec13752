"""Texts, dates, pages and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import dates, text
from rollbook.operators import loganalytics
from rollbook.session import table
from rollbook.sources import pages as html


def _excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(c).alias("excerpt"), F.length(text.speech_body(c)).alias("chars"))


def _speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "conversations").where("turn <> 0").select("conv_id", "turn", F.col("role").alias("speaker"), text.excerpt(c).alias("excerpt"), F.length(text.speech_body(c)).alias("chars"))


SQUASHED = "trim(regexp_replace(text, '[\\s\\x0b\\x{00a0}\\x{3000}\\x{feff}]+', ' ', 'g'))"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit("日程第"), F.col("p_size").cast("string"), F.lit("　"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "（内閣提出）").otherwise("（第一号）"))
    return table(spark, sf_dir, "part").select("p_partkey", text.bill_title(written).alias("title"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.replace("p_name", F.lit(" "), F.lit("君　")), F.lit("君 外"), F.col("p_size").cast("string"), F.lit("名"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.proposers(written)).alias("pos", "name"))


def _era(spark: SparkSession, sf_dir: str) -> DataFrame:
    era = dates.iso_to_era(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", era.alias("era"), dates.era_to_iso(F.concat(F.lit("（"), era, F.lit("）"))).alias("iso"))


def _kanji(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dates.number_to_kanji(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", c.alias("written"), dates.kanji_number(F.when(F.col("o_orderkey") % 10 == 3, F.concat(c, F.lit("十"))).otherwise(c)).alias("number"))


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "month(o_orderdate) AS m", "1 + o_orderkey % 12 AS sm", "year(o_orderdate) AS y")
    return rows.select("o_orderkey", dates.year_of(F.col("m"), F.col("y"), F.col("sm")).alias("from_six"), dates.year_of(F.col("m"), F.col("y"), F.col("sm"), strict=True).alias("over_six"))


def _zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers written as postal codes, with four digits or more behind the hyphen: longer numbers are none."""
    number = F.col("c_custkey").cast("string")
    written = F.concat(F.lit("〒"), F.translate(F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), "0123456789", "０１２３４５６７８９"), F.lit("－"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), "0"), F.when(F.col("c_custkey") % 9 == 0, "9").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.zip_code(written).alias("zip"))


def _parts_at_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.col("p_name"), F.lit("、町（"), F.col("p_type"), F.lit("、"), F.col("p_brand"), F.lit("）、"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.top_level_parts(written)).alias("pos", "part"))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each page, by its URL; pages are their own referrers' hosts."""
    target = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/?#]*/?", ""))
    line = F.concat(
        F.lit("- - [2"), (F.col("page_id") % 9).cast("string"), F.lit("/Aug/2026:10:00:00 +0900] \""), F.when(F.col("page_id") % 11 == 5, "POST").otherwise("GET"), F.lit(" "), target, F.lit(" HTTP/1.1\" "),
        F.when(F.col("page_id") % 7 == 3, "404").when(F.col("page_id") % 7 == 4, "304").otherwise("200"), F.lit(" 512 \""), F.when(F.col("page_id") % 5 == 0, "-").otherwise(F.col("url")), F.lit("\""),
    )
    return loganalytics.visits(table(spark, sf_dir, "pages").select(line.alias("value")), own="m.example.net")


VIEWS = """
raw AS (SELECT page_id, url, '2026-08-2' || (page_id % 9) AS day, regexp_replace('/' || regexp_replace(url, '^[a-z]+://[^/?#]*/?', ''), '[?#].*$', '') AS path, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS host FROM pages),
views AS (SELECT day, CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END AS page, CASE WHEN page_id % 5 = 0 OR host IN ('', 'm.example.net') THEN '-' ELSE host END AS referrer FROM raw
  WHERE page_id % 11 <> 5 AND page_id % 7 <> 3 AND NOT regexp_matches(path, '^/(assets|data)/') AND NOT regexp_matches(path, '\\.[A-Za-z0-9]+$'))
"""


def _page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loganalytics.page_views(_views(spark, sf_dir))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.createDataFrame([(f"2026-08-{d}",) for d in range(19, 30)], "day string")
    return loganalytics.summary(loganalytics.page_views(_views(spark, sf_dir)), days)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.createDataFrame([(f"2026-08-{d}",) for d in range(19, 30)], "day string")
    return loganalytics.report(loganalytics.page_views(_views(spark, sf_dir)), days)


def _referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where visits say they came from, each page's address as a referrer of another form: with letters that no address may hold, a port, a user, an app's scheme, no path, or the own site."""
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    kind = F.col("page_id") % 9
    sent = (
        F.when(kind == 0, F.concat(F.lit("https://"), rest, F.lit("?q=a|b {c}"))).when(kind == 1, F.concat(F.lit("http://"), host, F.lit(":8080/%zz"))).when(kind == 2, F.concat(F.lit("https://u:p w@"), rest))
        .when(kind == 3, F.concat(F.lit("android-app://"), host, F.lit("/x"))).when(kind == 4, host).when(kind == 5, F.concat(F.lit("https://m.example.net#"), rest)).when(kind == 6, F.lit("-")).when(kind == 7, F.lit("https:///x")).otherwise(F.concat(F.lit("HTTPS://"), host, F.lit("?"), rest))
    )
    return table(spark, sf_dir, "pages").select(loganalytics.referrer_host(sent, "m.example.net").alias("site")).groupBy("site").agg(F.count("*").alias("visits"))


def _daily_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = html.page_parts(table(spark, sf_dir, "pages"), id_col="page_id", html_col="html")
    return parts.where("kind IN ('title', 'h1', 'link')").select(F.col("id").alias("page_id"), "kind", "text", "href")


QUERIES = {
    "excerpt": (_excerpt, f"WITH b AS (SELECT doc_id, {SQUASHED} AS body FROM documents) SELECT doc_id, substr(body, 1, 200) AS excerpt, length(body) AS chars FROM b"),
    "speech_rows": (_speeches, f"WITH b AS (SELECT conv_id, turn, role AS speaker, {SQUASHED} AS body FROM conversations WHERE turn <> 0) SELECT conv_id, turn, speaker, substr(body, 1, 200) AS excerpt, length(body) AS chars FROM b"),
    "title_normalize": (_titles, "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '（第一号）' END AS title FROM part"),
    "name_split": (_names, "SELECT p_partkey, i - 1 AS pos, string_split(p_name, ' ')[i] AS name FROM (SELECT p_partkey, p_name, unnest(range(1, length(string_split(p_name, ' ')) + 1)) AS i FROM part)"),
    "wareki": (_era, """SELECT o_orderkey, '平成' || (year(o_orderdate) - 1988) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS era, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"""),
    "kanji_number": (_kanji, "SELECT o_orderkey, translate(CAST(o_orderkey AS varchar), '0123456789', '〇一二三四五六七八九') AS written, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey END AS number FROM orders"),
    "year_inference": (_years, """WITH r AS (SELECT o_orderkey, month(o_orderdate) AS m, 1 + o_orderkey % 12 AS sm, year(o_orderdate) AS y FROM orders)
      SELECT o_orderkey, CASE WHEN sm - m >= 6 THEN y + 1 ELSE y END AS from_six, CASE WHEN sm - m > 6 THEN y + 1 ELSE y END AS over_six FROM r"""),
    "zip_normalize": (_zip, "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 AND length(CAST(c_custkey AS varchar)) <= 4 THEN lpad(CAST(c_custkey % 1000 AS varchar), 3, '0') || lpad(CAST(c_custkey AS varchar), 4, '0') END AS zip FROM customer"),
    "top_level_split": (_parts_at_top, """SELECT p_partkey, 0 AS pos, p_name AS part FROM part UNION ALL SELECT p_partkey, 1, '町（' || p_type || '、' || p_brand || '）' FROM part UNION ALL SELECT p_partkey, 2, CAST(p_size AS varchar) FROM part"""),
    "page_views": (_page_views, f"WITH {VIEWS} SELECT day, page, referrer, count(*) AS pv FROM views GROUP BY ALL"),
    "page_view_summary": (_summary, f"""WITH {VIEWS}, days AS (SELECT '2026-08-' || unnest(range(19, 30)) AS day)
      SELECT d.day, count(page) AS pv, count(DISTINCT page) AS pages, round(coalesce(count(page) / nullif(count(DISTINCT page), 0), 0.0), 2) AS per_page FROM days d LEFT JOIN views v ON d.day = v.day GROUP BY 1"""),
    "page_view_report": (_report, f"""WITH {VIEWS}, days AS (SELECT '2026-08-' || unnest(range(19, 30)) AS day), c AS (SELECT day, page, referrer, count(*) AS pv FROM views GROUP BY ALL)
      SELECT d.day, 0 AS place, printf('# %s' || chr(9) || 'pv=%d' || chr(9) || 'pages=%d' || chr(9) || 'per-page=%.2f', d.day, count(page), count(DISTINCT page), round(coalesce(count(page) / nullif(count(DISTINCT page), 0), 0.0), 2)) AS line FROM days d LEFT JOIN views v ON d.day = v.day GROUP BY 1
      UNION ALL SELECT day, CAST(row_number() OVER (PARTITION BY day ORDER BY pv DESC, page, referrer) AS integer), concat_ws(chr(9), day, page, referrer, pv) FROM c WHERE day IN (SELECT day FROM days)"""),
    "referrer_sites": (_referrers, """WITH p AS (SELECT page_id % 9 AS kind, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages), h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM p)
      SELECT CASE kind WHEN 0 THEN CASE host WHEN '' THEN '-' ELSE host END WHEN 1 THEN host || ':8080' WHEN 2 THEN 'u:p w@' || host WHEN 3 THEN CASE host WHEN '' THEN '-' ELSE 'android-app://' || host END WHEN 4 THEN CASE host WHEN '' THEN '-' ELSE host END
        WHEN 5 THEN '-' WHEN 6 THEN '-' WHEN 7 THEN '-' ELSE CASE host WHEN '' THEN '-' ELSE 'HTTPS://' || host END END AS site, count(*) AS visits FROM h GROUP BY 1"""),
    "daily_event_types": (_daily_types, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"),
    "html_parts": (_html, None),
}
