"""Agreement, legends, carried rows and publications over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.text import nfkc, no_space
from rollbook.operators import agreement, carried, legends, publication, readapi, resolve
from rollbook.plans import members
from rollbook.plans.rollcalls import _put
from rollbook.session import shared_dir, table
from rollbook.sources import minutes


def _recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of each day's lines as published and as derived again, where some have come to differ, some have gone and some have changed places."""
    lines = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_orderkey", "l_partkey", F.when(F.col("l_partkey") % 3 > 0, F.col("l_returnflag")).alias("mark"))
    again = lines.where("l_orderkey % 991 <> 7").withColumns({"mark": F.when(F.col("l_orderkey") % 983 == 5, "?").otherwise(F.col("mark"))})
    return agreement.differing_groups(lines, again, by=["day"], columns=["l_orderkey", "l_partkey", "mark"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return agreement.differing_pages(rows, doc="doc", page="page", columns=["l_returnflag"])


def _legend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legend lines for each order: marks with colons in even ones, in quotes and with a ditto mark in odd ones; some with a key twice, a line that is none, or a ditto mark that points nowhere."""
    key = F.col("o_orderkey")
    even = F.array(_put("○：", F.col("o_orderstatus"), "×：反対議：", F.col("o_custkey").cast("string")), F.when(key % 10 == 4, "○：又").when(key % 14 == 6, "凡例").otherwise("欠：欠席"))
    odd = F.array(_put("「○」", F.col("o_orderstatus"), "起立（賛成）した者、「×」反対"), F.when(key % 15 == 7, "「●」〃に着席").when(key % 21 == 9, "「○」又").otherwise("「●」〃起立しなかった者、「欠」欠席"))
    lines = F.when(key % 2 == 0, even).otherwise(odd)
    return table(spark, sf_dir, "orders").select(key.alias("doc"), F.posexplode(lines).alias("at", "text"))


def _legend(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _legend_lines(spark, sf_dir)
    items = F.when(F.col("doc") % 2 == 0, legends.colon_items(F.col("text"))).otherwise(legends.quoted_items(F.col("text")))
    return legends.legend(lines, items)


def _legend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legend(spark, sf_dir)[0].select(F.col("doc").alias("o_orderkey"), "key", "meaning")


def _legend_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legend(spark, sf_dir)[1].select(F.col("entity").alias("o_orderkey"), "detail")


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in full-width figures with spaces, held against the list's plain ones."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate") - F.when(F.col("o_orderkey") % 17 == 3, 1).otherwise(0))
    wide = F.translate(F.col("year").cast("string"), "0123456789", "０１２３４５６７８９")
    found = orders.where("o_orderkey % 23 <> 1").select("o_orderkey", _put("第　", wide, " 回 定例会").alias("heading"))
    listed = orders.select("o_orderkey", _put("第", F.year("o_orderdate").cast("string"), "回定例会").alias("label"))
    fold = lambda c: no_space(nfkc(F.col(c)))
    return agreement.sessions_differ(found, listed, doc="o_orderkey", heading=fold("heading"), label=fold("label")).select(F.col("entity").alias("o_orderkey"), "detail")


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders matched by a roster in which some terms ended otherwise and some were missing, matched again by the roster as it is."""
    now, records = members.roster(spark, sf_dir), members.records(spark, sf_dir)
    before = now.where("c_custkey % 97 <> 5").withColumn("until", F.when(F.col("c_custkey") % 50 == 3, F.col("since")).otherwise(F.col("until")))
    how = dict(record="o_orderkey", key="name_key", at="sess", group="grp", date="day", t=members.T, same_group=members._aliases(spark))
    last = resolve.resolve(records, before, **how)
    return carried.match_again(last, before, now, **how).select("o_orderkey", "member", "branch")


def _in_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = members.records(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    held, lost = carried.in_office(entries, members.roster(spark, sf_dir), member="o_custkey", at="sess", date="day", t=members.T)
    return held.select("o_orderkey", F.lit("kept").alias("state")).unionByName(lost.select("o_orderkey", F.lit("fetch").alias("state")))


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of speeches for each conversation, some cut short, some without their list, some with text for a number."""
    speech = F.struct(F.col("conv_id").cast("string").alias("speechID"), F.col("turn").alias("speechOrder"), F.col("role").alias("speaker"), F.col("text").alias("speech"))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.count("*").alias("numberOfRecords"), F.collect_list(speech).alias("speechRecord"))).alias("json"))
    kind = F.col("conv_id") % 13
    value = F.when(kind == 2, F.substr("json", F.lit(1), F.length("json") - 3)).when(kind == 5, F.lit('{"numberOfRecords":4}')).when(kind == 7, F.replace("json", F.lit('"numberOfRecords":'), F.lit('"numberOfRecords":"x","n":'))).when(kind == 9, F.lit(" ")).otherwise(F.col("json"))
    good, faults = minutes.records_or_faults(pages.select("conv_id", value.alias("value")), id_col="conv_id")
    rows = good.select("conv_id", F.col("speechOrder").alias("turn"), "speaker", F.length("speech").alias("chars"), F.lit(None).cast("string").alias("fault"))
    return rows.unionByName(faults.select(F.col("entity").alias("conv_id"), F.lit(None).cast("int").alias("turn"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("int").alias("chars"), F.col("detail").alias("fault")))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the sums of their lines published twice; what a reader of the first version and one of the latest see."""
    path = f"{shared_dir(spark)}/publication-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderstatus")).alias("status"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    first = publication.publish({"orders": orders.where("o_orderkey % 2 = 0"), "lines": lines.where("l_orderkey % 2 = 0")}, path, partitions={"orders": "status"})
    publication.publish({"orders": orders, "lines": lines}, path, partitions={"orders": "status"}, guards={"lost": orders.where("o_orderkey IS NULL")})
    out = None
    for held in (publication.read(spark, path, first.version), publication.read(spark, path)):
        seen = held.table("orders").join(held.table("lines"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("status").agg(F.count("*").alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).withColumn("version", F.lit(held.version))
        out = seen if out is None else out.unionByName(seen)
    return out


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.substring_index("url", "://", 1).alias("scheme"), (F.col("page_id") % 5).alias("grp"), "url")
    return readapi.shown(rows, by=["grp"], source="url")


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years that the orders of each customer name in their titles, where they do; customers whose orders name none have a null scope."""
    names = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, _put("第", F.year("o_orderdate").cast("string"), "回国会 会議録")).otherwise(_put("会議録 第", F.year("o_orderdate").cast("string"), "回")).alias("name"))
    return readapi.source_scope(names, by=["o_custkey"], name="name", pattern="^第(\\d+)回国会")


QUERIES = {
    "recomputed_differs": (_recomputed, """WITH a AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey, l_partkey, CASE WHEN l_partkey % 3 > 0 THEN l_returnflag END AS mark FROM lineitem),
      b AS (SELECT day, l_orderkey, l_partkey, CASE WHEN l_orderkey % 983 = 5 THEN '?' ELSE mark END AS mark FROM a WHERE l_orderkey % 991 <> 7),
      d AS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
      SELECT day, (SELECT count(*) FROM a WHERE a.day = x.day) AS n_published, (SELECT count(*) FROM b WHERE b.day = x.day) AS n_recomputed FROM (SELECT DISTINCT day FROM d) x"""),
    "page_agreement": (_pages, """WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS held FROM lineitem GROUP BY ALL),
      f AS (SELECT *, first_value(held) OVER w AS first_held, first_value(page) OVER w AS first_page FROM p WINDOW w AS (PARTITION BY doc ORDER BY page))
      SELECT doc AS entity, first_page AS page, min(page) AS differs FROM f WHERE held <> first_held GROUP BY ALL"""),
    "legend_pairs": (_legend_pairs, """WITH o AS (SELECT *, o_orderkey % 2 = 0 AS even, (o_orderkey % 2 = 0 AND (o_orderkey % 10 = 4 OR o_orderkey % 14 = 6)) OR (o_orderkey % 2 = 1 AND (o_orderkey % 15 = 7 OR o_orderkey % 21 = 9)) AS bad FROM orders)
      SELECT o_orderkey, '○' AS key, CASE WHEN even THEN o_orderstatus ELSE o_orderstatus || '起立（賛成）した者' END AS meaning FROM o WHERE NOT bad UNION ALL SELECT o_orderkey, '×', '反対' FROM o WHERE NOT bad
      UNION ALL SELECT o_orderkey, '議', CAST(o_custkey AS varchar) FROM o WHERE even AND NOT bad UNION ALL SELECT o_orderkey, '欠', '欠席' FROM o WHERE NOT bad UNION ALL SELECT o_orderkey, '●', o_orderstatus || '起立しなかった者' FROM o WHERE NOT even AND NOT bad"""),
    "legend_refused": (_legend_refused, """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 10 = 4 THEN 'twice ○' WHEN o_orderkey % 2 = 0 AND o_orderkey % 14 = 6 THEN 'a line is no legend' WHEN o_orderkey % 2 = 1 AND o_orderkey % 15 = 7 THEN 'nothing for the ditto mark of ●' WHEN o_orderkey % 2 = 1 AND o_orderkey % 21 = 9 THEN 'twice ○' END AS detail
      FROM orders WHERE (o_orderkey % 2 = 0 AND (o_orderkey % 10 = 4 OR o_orderkey % 14 = 6)) OR (o_orderkey % 2 = 1 AND (o_orderkey % 15 = 7 OR o_orderkey % 21 = 9))"""),
    "session_headings": (_headings, """SELECT o_orderkey, 'listed as 第' || year(o_orderdate) || '回定例会, headed ' || CASE WHEN o_orderkey % 23 = 1 THEN 'nothing' ELSE '第' || (year(o_orderdate) - 1) || '回定例会' END AS detail FROM orders WHERE o_orderkey % 23 = 1 OR o_orderkey % 17 = 3"""),
    "carried_again": (_carried, f"WITH {members.ROSTER}, {members.RECORDS}, {members.RESOLVED} SELECT o_orderkey, member, branch FROM resolved"),
    "carried_in_office": (_in_office, f"""WITH {members.ROSTER}, {members.RECORDS} SELECT r.o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM roster m WHERE m.c_custkey = o.o_custkey AND m.since <= r.sess AND (r.sess <= m.until OR (m.ends <> '' AND m.ends >= r.day))) THEN 'kept' ELSE 'fetch' END AS state
      FROM records r JOIN orders o ON o.o_orderkey = r.o_orderkey"""),
    "minutes_or_faults": (_minutes, """SELECT conv_id, turn, role AS speaker, length(text) AS chars, NULL AS fault FROM conversations WHERE conv_id % 13 NOT IN (2, 5, 7, 9)
      UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, CASE conv_id % 13 WHEN 5 THEN 'no list of records' WHEN 9 THEN 'empty' ELSE 'unreadable' END FROM conversations WHERE conv_id % 13 IN (2, 5, 7, 9)"""),
    "published_versions": (_published, """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderstatus END AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
      SELECT v AS version, status, count(*) AS orders, CAST(sum(n) AS bigint) AS lines FROM o, (VALUES (1), (2)) t(v) WHERE v = 2 OR o_orderkey % 2 = 0 GROUP BY ALL"""),
    "shown_rows": (_shown, "SELECT page_id % 5 AS grp, count(*) FILTER (url LIKE 'https://%') AS shown, count(*) FILTER (coalesce(url, '') NOT LIKE 'https://%') AS suppressed FROM pages GROUP BY 1"),
    "source_scope": (_scope, "SELECT o_custkey, min(year(o_orderdate)) FILTER (o_orderkey % 3 = 0) AS since, max(year(o_orderdate)) FILTER (o_orderkey % 3 = 0) AS until, count(*) FILTER (o_orderkey % 3 = 0) AS sources FROM orders GROUP BY 1"),
}
